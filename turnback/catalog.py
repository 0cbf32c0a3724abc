"""The registered queries and their DuckDB counterparts.

Every query runs an operator or encoder over a whole table; columns that come from float aggregates are rounded to six
places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnback.functions.tokens import tokens
from turnback.operators import arrays, encode, make, masking, packing, text
from turnback.operators.reduce import reduce
from turnback.plans import Categorical, Dataset, Datetime, Flow, Fourier, Multilingual, Numeric, Text
from turnback.plans.encoders import ddl_frame, top_words
from turnback.session import shared_dir
from turnback.sources.records import RecordSource
from turnback.sources.training import train_input
from turnback.streaming.apply import OnlineFit, encode_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
UNIT = 604_800_000_000


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def read(spark: SparkSession, d: str, t: str, *cols: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/{t}.parquet")
    return x.select(*cols) if cols else x


def longest(df: DataFrame, col: str) -> int:
    """The length of the longest array, 1 at least."""
    return max(1, df.agg(F.max(F.size(col))).first()[0] or 1)


def r6(c) -> F.Column:
    return F.round(c, 6)


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
L = ", ".join(LINE)


# arithmetic


@query(f"SELECT {L}, l_extendedprice + l_tax AS added, l_extendedprice - l_discount AS subbed, true AS same FROM lineitem")
def arith_add_sub(spark, d):
    f = Flow()
    a, b, c = f.input("l_extendedprice"), f.input("l_tax"), f.input("l_discount")
    f.name(a + b, "added")
    f.name(a - c, "subbed")
    done = f.forward(read(spark, d, "lineitem", *LINE, "l_extendedprice", "l_tax", "l_discount"))
    x = done.withColumn("b", F.expr("`add_0/kept`")).withColumn("c", F.expr("`sub_0/kept`"))
    back = f.inverse(done).select(*LINE, "l_extendedprice", "l_tax", "l_discount")
    x = x.withColumn("same", F.abs(F.col("added") - F.col("b") - (F.col("subbed") + F.col("c"))) < 1e-6)
    del back
    return x.select(*LINE, "added", "subbed", "same")


@query(f"SELECT {L}, l_extendedprice * l_tax AS target, CASE WHEN l_extendedprice * l_tax = 0 THEN l_extendedprice END AS missing, l_tax AS kept FROM lineitem")
def arith_mul_zero_residual(spark, d):
    x = read(spark, d, "lineitem", *LINE, "l_extendedprice", "l_tax")
    got = make("mul").forward({"a": F.col("l_extendedprice"), "b": F.col("l_tax")})
    return x.select(*LINE, got["target"].alias("target"), got["missing"].alias("missing"), got["kept"].alias("kept"))


@query(f"SELECT {L}, floor((l_partkey - 1000) / 7.0)::BIGINT AS quotient, (l_partkey - 1000) - 7 * floor((l_partkey - 1000) / 7.0)::BIGINT AS remainder, l_partkey - 1000 AS back FROM lineitem")
def arith_floor_div(spark, d):
    op = make("div", {"b": 7}, whole=True)
    x = read(spark, d, "lineitem", *LINE)
    got = op.forward({"a": F.col("l_partkey") - 1000})
    x = x.select(*LINE, *(got[o].alias(o) for o in op.outs))
    return x.select(*LINE, F.col("target").alias("quotient"), "remainder", op.inverse({o: F.col(o) for o in op.outs})["a"].alias("back"))


@query(f"SELECT {L}, CASE WHEN l_tax = 0 THEN (CASE WHEN l_extendedprice > 0 THEN 1e300 ELSE -1 END) ELSE l_extendedprice / l_tax END AS quotient, CASE WHEN l_tax = 0 THEN l_extendedprice END AS missing FROM lineitem")
def arith_float_div_zero(spark, d):
    op = make("div")
    got = op.forward({"a": F.col("l_extendedprice"), "b": F.col("l_tax")})
    x = read(spark, d, "lineitem", *LINE, "l_extendedprice", "l_tax").select(*LINE, got["target"].alias("q"), got["missing"].alias("missing"))
    return x.select(*LINE, F.when(F.col("q") == float("inf"), 1e300).when(F.isnan("q") | (F.col("q") == float("-inf")), -1.0).otherwise(F.col("q")).alias("quotient"), "missing")


# predicates


@query("""SELECT o_orderkey, o_totalprice > 150000 AS gt, o_totalprice >= 150000 AS ge, o_totalprice < 150000 AS lt, o_totalprice <= 150000 AS le,
 o_orderpriority IN ('1-URGENT', '2-HIGH') AS member, o_orderstatus = 'F' AS eq, NOT (o_orderstatus = 'F') AS neg FROM orders""")
def predicates(spark, d):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    one = lambda n, **k: make(n, {"b": 150000.0}).forward({"a": p})["target"]
    eq = make("equals", {"b": "F"}, floating=False).forward({"a": s})["target"]
    return read(spark, d, "orders").select(
        "o_orderkey", one("greater").alias("gt"), one("greater_equal").alias("ge"), one("less").alias("lt"), one("less_equal").alias("le"),
        make("isin", values=["1-URGENT", "2-HIGH"]).forward({"a": F.col("o_orderpriority")})["target"].alias("member"), eq.alias("eq"),
        make("logical_not").forward({"a": eq})["target"].alias("neg"),
    )


@query("""SELECT event_id, event_id % 7 = 0 AS is_nan, event_id % 11 = 0 AS is_nat, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS filled,
 CASE WHEN event_id % 11 = 0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE ts END AS filled_ts FROM events""")
def isnan_isnat(spark, d):
    x = read(spark, d, "events", "event_id", "ts", "value")
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    t = F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    nan, nat = make("isnan").forward({"a": v})["target"], make("isnat").forward({"a": t})["target"]
    fill = make("replace", {"with_": 0.0}).forward({"a": v, "mask": nan})["target"]
    zero = make("replace").forward({"a": t, "mask": nat, "with_": F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))})["target"]
    return x.select("event_id", nan.alias("is_nan"), nat.alias("is_nat"), fill.alias("filled"), zero.alias("filled_ts"))


@query("""SELECT w.doc_id, w.pos, w.word, CASE w.lang WHEN 'en' THEN w.word IN ('the', 'of', 'and') WHEN 'de' THEN w.word IN ('der', 'die') ELSE false END AS member
 FROM (SELECT doc_id, lang, unnest(l) AS word, unnest(range(len(l)))::INTEGER AS pos FROM (SELECT doc_id, lang, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM documents)) w""")
def multi_isin(spark, d):
    w = read(spark, d, "documents", "doc_id", "lang", "text").select("doc_id", "lang", F.posexplode(tokens(F.col("text"), "whitespace")).alias("pos", "word"))
    got = make("multi_isin", values={"en": ["the", "of", "and"], "de": ["der", "die"]}).forward({"a": F.col("word"), "selector": F.col("lang")})
    return w.select("doc_id", "pos", "word", got["target"].alias("member"))


# casts and times


@query("SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS target, round(o_totalprice - trunc(o_totalprice), 6) AS diff, o_totalprice AS back FROM orders")
def cast_diff(spark, d):
    op = make("cast", dtype="bigint")
    got = op.forward({"a": F.col("o_totalprice")})
    x = read(spark, d, "orders").select("o_orderkey", *(got[o].alias(o) for o in op.outs))
    return x.select("o_orderkey", "target", r6("diff").alias("diff"), F.round(op.inverse({o: F.col(o) for o in op.outs})["a"], 2).alias("back"))


@query(f"""SELECT event_id, round(epoch_us(ts) / (2.0 * {UNIT}), 6) AS target, (epoch_us(ts) - {UNIT} * (epoch_us(ts) // {UNIT}))::BIGINT AS diff, ts AS back FROM events""")
def datetime_to_num(spark, d):
    op = make("datetime_to_num", unit="W", num_units=2)
    got = op.forward({"a": F.col("ts")})
    x = read(spark, d, "events", "event_id", "ts").select("event_id", *(got[o].alias(o) for o in op.outs))
    return x.select("event_id", r6("target").alias("target"), "diff", op.inverse({"target": F.col("target"), "diff": F.col("diff")})["a"].alias("back"))


# numeric encoders


def encoded(model, df: DataFrame, keys: list[str], **names: str) -> DataFrame:
    return model.forward(df).select(*keys, *(F.col(f"`{v}`").alias(k) for k, v in names.items()))


@query(f"""WITH s AS (SELECT min(l_quantity) a, max(l_quantity) b, min(l_extendedprice) c, max(l_extendedprice) d FROM lineitem)
SELECT {L}, round((l_quantity - a) / (b - a), 6) AS q, round((l_extendedprice - c) / (d - c), 6) AS p FROM lineitem, s""")
def num_minmax(spark, d):
    x = read(spark, d, "lineitem", *LINE, "l_quantity", "l_extendedprice")
    m = Numeric("n", ["l_quantity", "l_extendedprice"], norm="min_max").fit(x)
    x = encoded(m, x, LINE, q="n/nums/l_quantity", p="n/nums/l_extendedprice")
    return x.select(*LINE, r6("q").alias("q"), r6("p").alias("p"))


@query(f"""WITH s AS (SELECT avg(l_quantity) a, stddev_pop(l_quantity) b FROM lineitem)
SELECT {L}, round((l_quantity - a) / b, 6) AS q FROM lineitem, s""")
def num_meanstd(spark, d):
    x = read(spark, d, "lineitem", *LINE, "l_quantity")
    m = Numeric("n", ["l_quantity"], norm="mean_std").fit(x)
    return encoded(m, x, LINE, q="n/nums/l_quantity").select(*LINE, r6("q").alias("q"))


@query(f"""WITH s AS (SELECT avg(v) a, stddev_pop(v) b FROM (SELECT l_discount v FROM lineitem UNION ALL SELECT l_tax FROM lineitem))
SELECT {L}, round((l_discount - a) / b, 6) AS dn, round((l_tax - a) / b, 6) AS tn FROM lineitem, s""")
def num_pooled_axis(spark, d):
    x = read(spark, d, "lineitem", *LINE, "l_discount", "l_tax")
    m = Numeric("n", ["l_discount", "l_tax"], norm="mean_std", axis=None).fit(x)
    x = encoded(m, x, LINE, a="n/nums/l_discount", b="n/nums/l_tax")
    return x.select(*LINE, r6("a").alias("dn"), r6("b").alias("tn"))


@query(f"""WITH s AS (SELECT *, least(l_quantity, l_extendedprice, l_tax) lo, greatest(l_quantity, l_extendedprice, l_tax) hi FROM lineitem)
SELECT {L}, round((l_quantity - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END), 6) AS q, round((l_tax - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END), 6) AS t FROM s""")
def num_row_axis(spark, d):
    x = read(spark, d, "lineitem", *LINE, "l_quantity", "l_extendedprice", "l_tax")
    m = Numeric("n", ["l_quantity", "l_extendedprice", "l_tax"], norm="min_max", axis=1).fit(x)
    x = encoded(m, x, LINE, a="n/nums/l_quantity", b="n/nums/l_tax")
    return x.select(*LINE, r6("a").alias("q"), r6("b").alias("t"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END v FROM events), s AS (SELECT min(v) m FROM e), f AS (SELECT event_id, coalesce(v, m) w, v IS NULL nan FROM e, s),
t AS (SELECT avg(w) a, stddev_pop(w) b FROM f) SELECT event_id, round((w - a) / b, 6) AS num, nan FROM f, t""")
def num_fill_min(spark, d):
    x = read(spark, d, "events", "event_id", "value").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    m = Numeric("n", ["v"], norm="mean_std", fill="min").fit(x)
    return encoded(m, x, ["event_id"], num="n/nums/v", nan="n/nans/v").select("event_id", r6("num").alias("num"), "nan")


@query("""WITH s AS (SELECT min(epoch_us(o_orderdate) / 86400000000.0) a, max(epoch_us(o_orderdate) / 86400000000.0) b FROM orders)
SELECT o_orderkey, round((epoch_us(o_orderdate) / 86400000000.0 - a) / (b - a), 6) AS num, false AS nat, o_orderdate AS back FROM orders, s""")
def datetime_minmax(spark, d):
    x = read(spark, d, "orders", "o_orderkey", "o_orderdate")
    m = Datetime("t", ["o_orderdate"], norm="min_max").fit(x)
    done = m.forward(x)
    y = m.inverse(done.select("*", F.col("`t/nums/o_orderdate`").alias("num"), F.col("`t/nats/o_orderdate`").alias("nat")))
    return y.select("o_orderkey", r6("num").alias("num"), "nat", F.col("o_orderdate").alias("back"))


# categorical


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE -1 END AS idx, c_mktsegment AS back FROM customer")
def cat_index(spark, d):
    op = make("cat_to_index", values=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    got = op.forward({"cats": F.col("c_mktsegment")})
    x = read(spark, d, "customer", "c_custkey", "c_mktsegment").select("c_custkey", *(got[o].alias(o) for o in op.outs))
    return x.select("c_custkey", F.col("target").alias("idx"), op.inverse({o: F.col(o) for o in op.outs})["cats"].alias("back"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE -1 END AS idx, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS missing FROM customer")
def cat_unknown(spark, d):
    x = read(spark, d, "customer", "c_custkey", "c_mktsegment")
    m = Categorical("c", ["c_mktsegment"], ["BUILDING", "MACHINERY"]).fit(x)
    return encoded(m, x, ["c_custkey"], idx="c/indices/c_mktsegment", missing="c/missing_vals/c_mktsegment")


@query("""SELECT o_orderkey, g.pos::INTEGER AS pos, CASE WHEN g.pos = CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE -1 END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot
 FROM orders, (SELECT unnest(range(5)) pos) g""")
def cat_onehot(spark, d):
    i = make("cat_to_index", values=PRIORITIES).forward({"cats": F.col("o_orderpriority")})["target"]
    one = make("one_hot", length=5).forward({"indices": i})["target"]
    return read(spark, d, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", F.posexplode(one).alias("pos", "hot"))


@query("""WITH c AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) cat, unnest(range(5))::INTEGER pos),
p AS (SELECT pos, cat, (SELECT avg((c_mktsegment = cat)::INT) FROM customer) p FROM c)
SELECT c_custkey, pos, round(((c_mktsegment = cat)::INT - p) / CASE WHEN p * (1 - p) = 0 THEN 1 ELSE sqrt(p * (1 - p)) END, 6) AS hot FROM customer, p""")
def cat_meanstd(spark, d):
    x = read(spark, d, "customer", "c_custkey", "c_mktsegment")
    m = Categorical("c", ["c_mktsegment"], ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], norm="mean_std").fit(x)
    x = encoded(m, x, ["c_custkey"], v="c/one_hots/c_mktsegment").select("c_custkey", F.posexplode("v").alias("pos", "hot"))
    return x.select("c_custkey", "pos", r6("hot").alias("hot"))


@query("""WITH w AS (SELECT doc_id, lang, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS token FROM documents),
n AS (SELECT lang, token, count(*) c FROM w GROUP BY ALL), v AS (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY c DESC, token) - 1 AS i FROM n QUALIFY i < 50)
SELECT w.lang, w.token, coalesce(v.i, -1)::INTEGER AS idx, count(*)::BIGINT AS n FROM w LEFT JOIN v ON w.lang = v.lang AND w.token = v.token GROUP BY ALL""")
def multi_cat_index(spark, d):
    w = read(spark, d, "documents", "lang", "text").select("lang", F.explode(tokens(F.col("text"), "whitespace")).alias("token"))
    v = top_words(w, ["lang"], 50).select("lang", "token", F.expr("row_number() over (partition by lang order by n desc, token) - 1").alias("index"))
    got = encode.encode_by_join(w, v, ["lang", "token"])
    return got.groupBy("lang", "token", F.col("target").cast("int").alias("idx")).agg(F.count("*").alias("n"))


# reductions


@query("""SELECT max(l_quantity) AS mx, min(l_quantity) AS mn, round(sum(l_quantity), 4) AS sm, round(avg(l_quantity), 6) AS me, round(stddev_pop(l_quantity), 6) AS sd, bool_and(l_quantity > 0) AS al, bool_or(l_tax = 0) AS an FROM lineitem""")
def reduce_axis0(spark, d):
    x = read(spark, d, "lineitem", "l_quantity", "l_tax").withColumns({"pos": F.col("l_quantity") > 0, "zero": F.col("l_tax") == 0})
    from turnback.operators.reduce import AGGREGATES as A

    q = F.col("l_quantity")
    return x.agg(A["max"](q).alias("mx"), A["min"](q).alias("mn"), F.round(A["sum"](q), 4).alias("sm"), r6(A["mean"](q)).alias("me"), r6(A["std"](q)).alias("sd"), A["all"](F.col("pos")).alias("al"), A["any"](F.col("zero")).alias("an"))


@query("""SELECT vec_id, list_max(e) AS mx, list_min(e) AS mn, round(list_sum(e), 4) AS sm, round(list_avg(e), 4) AS me, round(list_stddev_pop(e), 4) AS sd, list_bool_and(list_transform(e, lambda x: x <> 0)) AS al, list_bool_or(list_transform(e, lambda x: x > 0)) AS an
 FROM (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings)""")
def reduce_axis1(spark, d):
    x = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = lambda k, c="e": make("reduce", kind=k).forward({"a": F.col(c) if isinstance(c, str) else c})["target"]
    return x.select(
        "vec_id", one("max").alias("mx"), one("min").alias("mn"), F.round(one("sum"), 4).alias("sm"), F.round(one("mean"), 4).alias("me"), F.round(one("std"), 4).alias("sd"),
        one("all", F.transform("e", lambda v: v != 0)).alias("al"), one("any", F.transform("e", lambda v: v > 0)).alias("an"),
    )


@query("""WITH v AS (SELECT l_quantity v FROM lineitem UNION ALL SELECT l_extendedprice FROM lineitem)
SELECT unnest(['max', 'min', 'sum', 'mean', 'std', 'all', 'any']) AS kind, round(unnest([max(v), min(v), sum(v), avg(v), stddev_pop(v), bool_and(v > 0)::INTEGER::DOUBLE, bool_or(v > 1e6)::INTEGER::DOUBLE]), 2) AS target FROM v""")
def reduce_all(spark, d):
    """Every reduction over both axes."""
    cols = ["l_quantity", "l_extendedprice"]
    x = read(spark, d, "lineitem", *cols)
    yes, many = x.select(*((F.col(c) > 0).alias(c) for c in cols)), x.select(*((F.col(c) > 1e6).alias(c) for c in cols))
    each = [reduce(yes if k == "all" else many if k == "any" else x, k, cols).select(F.lit(k).alias("kind"), F.round(F.col("target").cast("int" if k in ("all", "any") else "double").cast("double"), 2).alias("target")) for k in ("max", "min", "sum", "mean", "std", "all", "any")]
    out = each[0]
    for y in each[1:]:
        out = out.unionByName(y)
    return out


# strings


@query("SELECT doc_id, lower(text) AS target, true AS same FROM documents")
def lower_case(spark, d):
    op = make("lower_case")
    got = op.forward({"strings": F.col("text")})
    x = read(spark, d, "documents", "doc_id", "text").select("doc_id", "text", got["target"].alias("target"), got["diff"].alias("diff"))
    return x.select("doc_id", "target", (op.inverse({"target": F.col("target"), "diff": F.col("diff")})["strings"] == F.col("text")).alias("same"))


@query("SELECT page_id, replace(html, '<p>', '<para>') AS target, true AS same FROM pages")
def replace_substring(spark, d):
    op = make("replace_substring", old="<p>", new="<para>")
    got = op.forward({"strings": F.col("html")})
    x = read(spark, d, "pages", "page_id", "html").select("page_id", "html", got["target"].alias("target"), got["diff"].alias("diff"))
    return x.select("page_id", "target", (op.inverse({"target": F.col("target"), "diff": F.col("diff")})["strings"] == F.col("html")).alias("same"))


@query("SELECT item_id, text AS target, true AS same FROM benchmark")
def half_width(spark, d):
    ascii_ = "".join(map(chr, range(33, 127)))
    wide = F.translate("text", ascii_, "".join(chr(ord(c) + 0xFEE0) for c in ascii_))
    op = make("half_width")
    got = op.forward({"strings": F.col("wide")})
    x = read(spark, d, "benchmark").withColumn("wide", wide).select("item_id", "wide", got["target"].alias("target"), got["diff"].alias("diff"))
    return x.select("item_id", "target", (op.inverse({"target": F.col("target"), "diff": F.col("diff")})["strings"] == F.col("wide")).alias("same"))


@query("""WITH t AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM benchmark), m AS (SELECT max(len(l)) AS k FROM t)
SELECT item_id, unnest(range(k))::INTEGER AS pos, unnest(list_resize(l, k, '')) AS token, true AS same FROM t, m""")
def tokenize_pad(spark, d):
    """As many tokens for each text as the longest one has."""
    x = read(spark, d, "benchmark", "item_id", "text")
    op = make("tokenize", tokenizer="whitespace", detokenizer="join", max_len=longest(x.select(tokens(F.col("text"), "whitespace").alias("t")), "t"))
    got = op.forward({"strings": F.col("text")})
    x = x.select("item_id", "text", got["target"].alias("target"), got["diff"].alias("diff"))
    x = x.select("item_id", "target", (op.inverse({"target": F.col("target"), "diff": F.col("diff")})["strings"] == F.col("text")).alias("same"))
    return x.select("item_id", F.posexplode("target").alias("pos", "token"), "same")


@query("""SELECT doc_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS token FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM documents)""")
def flat_tokenize(spark, d):
    return text.flat_tokenize(read(spark, d, "documents", "doc_id", "text"), "text", ["doc_id"]).filter(F.col("token").isNotNull()).select("doc_id", "pos", "token")


@query("SELECT item_id, true AS same FROM benchmark")
def flat_tokenize_roundtrip(spark, d):
    x = read(spark, d, "benchmark")
    back = text.flat_detokenize(text.flat_tokenize(x, "text", ["item_id"]), ["item_id"], "back")
    return x.join(back, "item_id").select("item_id", (F.col("text") == F.col("back")).alias("same"))


@query("""WITH w AS (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS token FROM documents)
SELECT token, count(*)::BIGINT AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 100""")
def vocab_topk(spark, d):
    w = read(spark, d, "documents", "text").select(F.explode(tokens(F.col("text"), "whitespace")).alias("token"))
    return top_words(w, [], 100)


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM documents),
n AS (SELECT token, count(*) c FROM (SELECT unnest(l) AS token FROM w) GROUP BY token ORDER BY c DESC, token LIMIT 199),
v AS (SELECT token, row_number() OVER (ORDER BY token) AS i FROM n),
t AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS token FROM w)
SELECT t.doc_id, t.pos, coalesce(v.i, 0)::INTEGER AS idx, CASE WHEN v.i IS NULL THEN t.token ELSE '' END AS missing
FROM t LEFT JOIN v ON t.token = v.token""")
def string_encode(spark, d):
    x = read(spark, d, "documents", "doc_id", "text")
    m = Text("s", ["text"], max_len=None, max_vocab=200).fit(x)
    y = encoded(m, x, ["doc_id"], i="s/indices/text", m="s/missing_vals/text")
    return y.select("doc_id", F.posexplode(F.arrays_zip("i", "m")).alias("pos", "z")).select("doc_id", "pos", F.col("z.i").alias("idx"), F.col("z.m").alias("missing"))


@query("SELECT doc_id, true AS same FROM documents")
def string_roundtrip(spark, d):
    x = read(spark, d, "documents", "doc_id", "text")
    m = Text("s", ["text"], max_len=None, max_vocab=500, lower=True, half=True).fit(x)
    back = m.inverse(m.forward(x.select("doc_id", F.col("text").alias("orig"), "text")))
    return back.select("doc_id", (F.col("text") == F.col("orig")).alias("same"))


@query("""WITH w AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS l FROM documents),
n AS (SELECT lang, token, count(*) c FROM (SELECT lang, unnest(l) AS token FROM w) GROUP BY ALL), k AS (SELECT lang, token FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, token) <= 99),
v AS (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY token) AS i FROM k),
t AS (SELECT doc_id, lang, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS token FROM w)
SELECT t.doc_id, t.pos, coalesce(v.i, 0)::INTEGER AS idx FROM t LEFT JOIN v ON t.token = v.token AND t.lang = v.lang""")
def multilingual_encode(spark, d):
    langs = ["en", "fr", "de", "es"]
    x = read(spark, d, "documents", "doc_id", "text", "lang")
    m = Multilingual("m", ["text", "lang"], dict.fromkeys(langs, "whitespace"), dict.fromkeys(langs, "join"), max_len=None, max_vocab=100, lower=True).fit(x)
    return encoded(m, x, ["doc_id"], i="m/indices/text").select("doc_id", F.posexplode("i").alias("pos", "idx"))


@query("SELECT doc_id, true AS same FROM documents")
def multilingual_roundtrip(spark, d):
    langs = ["en", "fr", "de", "es"]
    x = read(spark, d, "documents", "doc_id", "text", "lang")
    m = Multilingual("m", ["text", "lang"], dict.fromkeys(langs, "whitespace"), dict.fromkeys(langs, "join"), max_len=None, max_vocab=100, lower=True).fit(x)
    back = m.inverse(m.forward(x.withColumn("orig", F.col("text"))))
    return back.select("doc_id", (F.col("text") == F.col("orig")).alias("same"))


@query("SELECT conv_id, turn, string_agg(CASE WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END, ' ' ORDER BY pos) AS target FROM (SELECT conv_id, turn, unnest(l) w, unnest(range(len(l))) pos FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM conversations)) GROUP BY ALL")
def lemmatize(spark, d):
    x = read(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.posexplode(tokens(F.col("text"), "whitespace")).alias("pos", "w"))
    x = x.withColumn("w", make("lemmatize", lemmatizer="plural").forward({"strings": F.col("w")})["target"])
    g = x.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    return g.select("conv_id", "turn", F.array_join(F.transform("ws", lambda s: s["w"]), " ").alias("target"))


@query("SELECT doc_id, lang, len(l)::INTEGER AS n, true AS same FROM (SELECT doc_id, lang, CASE WHEN lang IN ('en', 'de') THEN list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') ELSE string_split(text, '') END AS l FROM documents)")
def multi_tokenize(spark, d):
    tk = {"en": "whitespace", "de": "whitespace", "fr": "characters", "es": "characters"}
    op = make("multi_tokenize", tokenizers=tk, detokenizers={k: "join" if v == "whitespace" else "concat" for k, v in tk.items()}, max_len=None)
    got = op.forward({"strings": F.col("text"), "selector": F.col("lang")})
    x = read(spark, d, "documents", "doc_id", "lang", "text").select("doc_id", "lang", "text", got["target"].alias("t"), got["diff"].alias("f"))
    back = op.inverse({"target": F.col("t"), "diff": F.col("f"), "selector": F.col("lang")})["strings"]
    return x.select("doc_id", "lang", F.size(F.filter("t", lambda v: v != "")).alias("n"), (back == F.col("text")).alias("same"))


# masks and samples


@query(f"SELECT {L}, l_returnflag = 'R' AS kept FROM lineitem")
def remove_mask(spark, d):
    a, b = masking.remove(read(spark, d, "lineitem", *LINE, "l_returnflag"), F.col("l_returnflag") == "R")
    return masking.restore(a.withColumn("kept", F.lit(True)), b.withColumn("kept", F.lit(False))).select(*LINE, "kept")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_totalprice END AS target, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS replaced FROM orders")
def replace_mask(spark, d):
    got = make("replace", {"with_": -1.0}).forward({"a": F.col("o_totalprice"), "mask": F.col("o_orderstatus") == "F"})
    return read(spark, d, "orders").select("o_orderkey", got["target"].alias("target"), got["replaced"].alias("replaced"))


H = "('0x' || substr(md5({}), 1, 13))::BIGINT"
U = f"({H} / 4503599627370496.0::DOUBLE)"


@query(f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM documents),
p AS (SELECT doc_id, l, list_reverse(list_filter(range(len(l)), lambda i: {U.format("doc_id || '|' || i || '|3'")} < 0.15 AND l[i + 1] <> 'the'))[:20] AS places FROM t)
SELECT doc_id, len(places)::INTEGER AS n, array_to_string(list_transform(l, lambda v, i: CASE WHEN list_contains(places, i - 1) THEN '[MASK]' ELSE v END), ' ') AS target, true AS same FROM p""")
def random_replace(spark, d):
    x = read(spark, d, "documents", "doc_id", "text").select("doc_id", tokens(F.col("text"), "whitespace").alias("t"))
    op = make("random_replace", prob=0.15, max_replace=20, with_="[MASK]", do_not_replace=["the"], seed=3)
    got = op.forward({"a": F.col("t"), "key": F.col("doc_id")})
    y = x.select("doc_id", "t", *(got[o].alias(o) for o in ("target", "positions", "replaced")))
    back = op.inverse({"target": F.col("target"), "positions": F.col("positions"), "replaced": F.col("replaced"), "key": F.col("doc_id")})["a"]
    return y.select("doc_id", F.size("positions").alias("n"), F.array_join("target", " ").alias("target"), (back == F.col("t")).alias("same"))


@query(f"""SELECT c_custkey, array_to_string(list_transform(range(3), lambda i: CASE WHEN {U.format("c_custkey || '|' || i || '|1'")} < 0.5 THEN 'a' WHEN {U.format("c_custkey || '|' || i || '|1'")} < 0.8 THEN 'b' ELSE 'c' END), ',') AS target FROM customer""")
def random_choice(spark, d):
    got = make("random_choice", choices=["a", "b", "c"], p=[0.5, 0.3, 0.2], size=3, seed=1).forward({"key": F.col("c_custkey")})
    return read(spark, d, "customer", "c_custkey").select("c_custkey", F.array_join(got["target"], ",").alias("target"))


@query(f"""WITH c AS (SELECT conv_id || '-' || turn AS key, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
r AS (SELECT key, w, len(w) AS k, max(len(w)) OVER () AS width, count(*) OVER () AS n FROM c WHERE len(w) > 0),
m AS (SELECT *, list_filter(range(1, k + 1), lambda i: i % 8 = 0 OR i = k) AS marks FROM r),
x AS (SELECT *, marks[1 + floor({U.format("key || '|cut|0'")} * len(marks))::BIGINT] AS cut FROM m),
y AS (SELECT *, w[:cut] AS a, w[cut + 1:] AS b FROM x),
pool AS (SELECT {H.format("key || '|0'")} % n AS bucket, min_by(b, {H.format("key || '|1'")}) AS chunk FROM y GROUP BY 1),
tries AS (SELECT key, cut, width, n, unnest(range(1, 11)) AS t FROM y WHERE {U.format("key || '|go|0'")} < 0.5),
best AS (SELECT tries.key, max_by(chunk, len(chunk) * 100 - t) AS chunk FROM tries JOIN pool ON bucket = {H.format("tries.key || '|' || t || '|2'")} % n WHERE len(chunk) + 1 < width + 1 - cut GROUP BY tries.key)
SELECT y.key, chunk IS NOT NULL AS is_random_next, array_to_string(list_resize(['[CLS]'] || a || ['[SEP]'] || coalesce(chunk, b) || ['[SEP]'], width + 3, ''), ' ') AS target, true AS same FROM y LEFT JOIN best ON best.key = y.key""")
def nsp_pairs(spark, d):
    x = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), tokens(F.col("text"), "whitespace").alias("w")).filter(F.size("w") > 0)
    width = longest(x, "w")
    ends = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: ((i % 8) == 0) | (i == F.size("w")))
    x = x.select("key", "w", F.slice(F.concat("w", F.array_repeat(F.lit(""), width)), 1, width).alias("tokens"), F.concat(ends, F.array_repeat(F.lit(False), F.lit(width) - F.size("w"))).alias("ends"))
    y = masking.segment_pairs(x, "key", "tokens", "ends", keep=("w",)).withColumn("back", masking.unsegmented())
    return y.select("key", "is_random_next", F.array_join("target", " ").alias("target"), (F.slice("back", F.lit(1), F.size("w")) == F.col("w")).alias("same"))


# rows, arrays, packs


@query("SELECT o_orderkey, part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) o JOIN (VALUES (0, 10, 200), (1, 0, 50), (2, 400, 500)) p(part, a, b) ON i >= a AND i < b UNION ALL SELECT o_orderkey, -1 FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) o WHERE NOT (i < 200 OR (i >= 400 AND i < 500))")
def partition_ranges(spark, d):
    x = arrays.numbered(read(spark, d, "orders", "o_orderkey"), ["o_orderkey"])
    parts, rest = arrays.partition_ranges(x, [(10, 200), (0, 50), (400, 500)])
    return parts.select("o_orderkey", "part").unionByName(rest.select("o_orderkey", F.lit(-1).alias("part")))


@query(f"SELECT {L}, l_quantity, l_shipdate, (row_number() OVER (ORDER BY {L}, l_extendedprice, l_shipdate) - 1)::INTEGER AS idx FROM lineitem")
def row_numbers(spark, d):
    x = read(spark, d, "lineitem", *LINE, "l_extendedprice", "l_quantity", "l_shipdate")
    return arrays.numbered(x, [*LINE, "l_extendedprice", "l_shipdate"]).drop("l_extendedprice")


@query("SELECT vec_id, embedding[3] AS a, embedding[1] AS b, embedding[64] AS c, len(embedding) - 3 AS rest, true AS same FROM embeddings")
def partition_by_index(spark, d):
    op = make("partition_by_index", indices=[[2, 0], [63, 2]], size=64)
    got = op.forward({"a": F.col("embedding")})
    x = read(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", "embedding", *(got[o].alias(o) for o in op.outs))
    same = op.inverse({o: F.col(o) for o in op.outs})["a"] == F.col("embedding")
    return x.select("vec_id", F.get("t0", 0).alias("a"), F.get("t0", 1).alias("b"), F.get("t1", 0).alias("c"), F.size("rest").cast("long").alias("rest"), same.alias("same"))


@query("SELECT o_orderkey, (CASE WHEN i < 100 THEN 0 WHEN i < 700 THEN 1 ELSE 2 END)::INTEGER AS src FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)")
def split_concat(spark, d):
    x = arrays.numbered(read(spark, d, "orders", "o_orderkey"), ["o_orderkey"])
    return arrays.concatenate_rows(arrays.split_rows(x, [100, 700])).select("o_orderkey", "src")


@query("""SELECT vec_id, i::INTEGER AS pos, j::INTEGER AS col, embedding[j * 8 + i + 1] AS v, 64::INTEGER AS n, true AS same FROM embeddings, (SELECT unnest(range(8)) i), (SELECT unnest(range(8)) j)""")
def array_reshape_transpose_tile(spark, d):
    f = Flow()
    a = f.input("embedding")
    grid = f.add("reshape", a=a, width=8)["target"]
    turned = f.add("transpose", a=grid)["target"]
    x = f.forward(read(spark, d, "embeddings", "vec_id", "embedding").withColumn("was", F.col("embedding")))
    back = f.inverse(x).select("vec_id", (F.col("embedding") == F.col("was")).alias("same"))
    del turned
    flat = make("flatten").forward({"a": F.col("`transpose_0/target`")})["target"]
    tiled = make("tile", reps=2).forward({"a": flat})["target"]
    n = make("dim_size").forward({"a": flat})["target"]
    y = x.select("vec_id", F.slice(tiled, 65, 64).alias("t"), n.alias("n")).join(back, "vec_id")
    return y.select("vec_id", F.posexplode("t").alias("k", "v"), "n", "same").select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("pos"), (F.col("k") % 8).cast("int").alias("col"), "v", "n", "same")


@query("SELECT vec_id, embedding[5] AS item, embedding[2] + 0 AS first_of_slice, len(embedding[2:9])::INTEGER AS n, 64::INTEGER AS size FROM embeddings")
def array_getitem_shape(spark, d):
    e = F.col("embedding")
    part = make("getitem", key=1, stop=9).forward({"a": e})["target"]
    return read(spark, d, "embeddings", "vec_id", "embedding").select(
        "vec_id", make("getitem", key=4).forward({"a": e})["target"].alias("item"), F.get(part, 0).alias("first_of_slice"), F.size(part).alias("n"),
        F.get(make("shape").forward({"a": e})["target"], 0).alias("size"),
    )


@query("SELECT doc_id, len(l)::INTEGER AS n FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l FROM documents)")
def effective_length(spark, d):
    t = make("tokenize", tokenizer="whitespace", detokenizer="join", max_len=None).forward({"strings": F.col("text")})["target"]
    n = make("effective_length", default="").forward({"a": F.concat(t, F.array_repeat(F.lit(""), 5))})["target"]
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", n.alias("n"))


GROUP = 4
PACK_SQL = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INTEGER AS n, max(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) OVER () AS width, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT conv_id, turn, k, n, 0 AS pack, 0 AS slot, 0 AS start FROM t WHERE k = 1
 UNION ALL SELECT t.conv_id, t.turn, t.k, t.n, CASE WHEN p.start + p.n + t.n > t.width OR p.slot + 1 = {GROUP} THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.start + p.n + t.n > t.width OR p.slot + 1 = {GROUP} THEN 0 ELSE p.slot + 1 END, CASE WHEN p.start + p.n + t.n > t.width OR p.slot + 1 = {GROUP} THEN 0 ELSE p.start + p.n END
 FROM p JOIN t ON t.conv_id = p.conv_id AND t.k = p.k + 1)"""


def _turns(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """All words of each turn, padded to as many as the longest turn has; and how many that is."""
    w = tokens(F.col("text"), "whitespace")
    x = read(spark, d, "conversations").select("conv_id", "turn", "role", w.alias("words"))
    width = longest(x, "words")
    return x.withColumn("values", F.slice(F.concat("words", F.array_repeat(F.lit(""), width)), 1, width)), width


@query(PACK_SQL + ' SELECT conv_id, pack::INTEGER AS pack, slot::INTEGER AS slot, turn AS row, start::INTEGER AS start, (start + n)::INTEGER AS "end" FROM p')
def pack_sequences(spark, d):
    x, width = _turns(spark, d)
    return packing.pack(x, "conv_id", "turn", "values", width, GROUP, "")[1]


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS back FROM conversations")
def pack_roundtrip(spark, d):
    x, width = _turns(spark, d)
    packs, where = packing.pack(x, "conv_id", "turn", "values", width, GROUP, "")
    back = packing.unpack(packs, where, "conv_id", width, "", "turn", "back")
    return back.select("conv_id", "turn", F.array_join(F.filter("back", lambda v: v != ""), " ").alias("back"))


@query(PACK_SQL + " SELECT p.conv_id, p.pack::INTEGER AS pack, rtrim(string_agg(c.role, ',' ORDER BY p.slot)) AS roles FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn GROUP BY ALL")
def pack_row_map(spark, d):
    x, width = _turns(spark, d)
    _, where = packing.pack(x, "conv_id", "turn", "values", width, GROUP, "")
    got = packing.pack_with_row_map(x, where, "conv_id", "turn", "role", GROUP, "")
    return got.select("conv_id", "pack", F.array_join(F.filter("target", lambda v: v != ""), ",").alias("roles"))


# plumbing


@query("SELECT c_custkey, c_acctbal AS a, c_acctbal * 2 AS b, c_nationkey + 1 AS c, true AS same FROM customer")
def plumbing(spark, d):
    f = Flow()
    bal, nat = f.input("c_acctbal"), f.input("c_nationkey")
    both = f.add("iter_list", a=f.add("port_list", n=2, a0=bal, a1=bal)["target"], num_entries=2)
    one = f.add("merge_equal", n=2, a0=f.add("do_nothing", a=both["t0"])["target"], a1=both["t1"], test_equal=True)["target"]
    copies = f.add("clone", a=one)
    f.name(copies["t0"], "a")
    f.name(copies["t1"] * 2.0, "b")
    f.name(f.add("print_val", a=nat)["target"] + 1, "c")
    x = read(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey").withColumn("was", F.col("c_acctbal"))
    done = f.forward(x)
    back = f.inverse(done).select("c_custkey", (F.col("c_acctbal") == F.col("was")).alias("same"))
    return done.join(back, "c_custkey").select("c_custkey", "a", "b", "c", "same")


@query("SELECT c_custkey, c_acctbal AS a, c_acctbal + 1 AS b, c_acctbal * 3 AS c, c_nationkey AS d, c_acctbal AS back, c_nationkey AS back_nation FROM customer")
def plumbing_lists(spark, d):
    """clone_many and iter_dict, forward and back."""
    f = Flow()
    parts = f.add("iter_dict", a=f.input("both"), keys=["bal", "nation"])
    many = f.add("clone_many", a=parts["bal"], num=3)
    f.name(many["t0"], "a")
    f.name(many["t1"] + 1.0, "b")
    f.name(many["t2"] * 3.0, "c")
    f.name(f.add("do_nothing", a=parts["nation"])["target"], "d")
    x = read(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey").select("c_custkey", F.struct(F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation")).alias("both"))
    done = f.forward(x)
    back = f.inverse(done).select("c_custkey", F.col("both.bal").alias("back"), F.col("both.nation").alias("back_nation"))
    return done.join(back, "c_custkey").select("c_custkey", "a", "b", "c", "d", "back", "back_nation")


@query("SELECT item_id, list_concat(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ['end'])[1:3] AS head, true AS same FROM benchmark")
def array_concat_split(spark, d):
    """concatenate and split on array cells, forward and back."""
    x = read(spark, d, "benchmark", "item_id", "text").select("item_id", tokens(F.col("text"), "whitespace").alias("w"), F.array(F.lit("end")).alias("e"))
    cat, cut = make("concatenate", n=2), make("split", indices=[3])
    got = cat.forward({"a0": F.col("w"), "a1": F.col("e")})
    x = x.select("item_id", "w", "e", got["target"].alias("t"), got["sizes"].alias("s"))
    parts = cut.forward({"a": F.col("t")})
    x = x.select("item_id", "w", "e", "s", parts["t0"].alias("t0"), parts["t1"].alias("t1"))
    back = cat.inverse({"target": cut.inverse({"t0": F.col("t0"), "t1": F.col("t1")})["a"], "sizes": F.col("s")})
    return x.select("item_id", F.col("t0").alias("head"), ((back["a0"] == F.col("w")) & (back["a1"] == F.col("e"))).alias("same"))


# Fourier


@query("""SELECT vec_id, k::INTEGER AS k, round(label * w - floor(label * w), 6) AS phase, floor(label * w) AS whole FROM embeddings, (VALUES (0, 0.3::DOUBLE), (1, 1.7::DOUBLE), (2, 2.9::DOUBLE)) f(k, w)""")
def phase_decomp(spark, d):
    got = make("phase_decomp", freqs=[0.3, 1.7, 2.9]).forward({"a": F.col("label").cast("double")})
    x = read(spark, d, "embeddings", "vec_id", "label").select("vec_id", F.posexplode(F.arrays_zip(got["target"].alias("p"), got["div"].alias("d"))).alias("k", "z"))
    return x.select("vec_id", "k", r6("z.p").alias("phase"), F.col("z.d").alias("whole"))


@query("""WITH b AS (SELECT min(ts) a, max(ts) z FROM events), t AS (SELECT (epoch_us(ts) - epoch_us(a)) / (epoch_us(z) - epoch_us(a))::DOUBLE AS t, value FROM events, b)
SELECT k::INTEGER AS k, round(avg(value * cos(2 * pi() * k * t)), 5) AS re, round(-avg(value * sin(2 * pi() * k * t)), 5) + 0.0 AS im FROM t, (SELECT unnest(range(6)) k) GROUP BY k""")
def fourier_fit(spark, d):
    x = read(spark, d, "events", "event_id", "ts", "value")
    lo, hi = x.agg(F.min("ts"), F.max("ts")).first()
    m = Fourier("f", ["ts", "value"], zero=str(lo), end=str(hi), frequencies=6).fit(x)
    rows = [(k, float(re), float(im)) for k, (re, im) in enumerate(m.state["coefficients"])]
    return spark.createDataFrame(rows, "k int, re double, im double").select("k", F.round("re", 5).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


@query("SELECT event_id, epoch_us(ts) // 10 AS tens FROM events")
def fourier_roundtrip(spark, d):
    """The times that come back, to ten microseconds (rounded up by half of one)."""
    x = read(spark, d, "events", "event_id", "ts", "value")
    lo, hi = x.agg(F.min("ts"), F.max("ts")).first()
    m = Fourier("f", ["ts", "value"], zero=str(lo), end=str(hi), frequencies=5, top=3).fit(x)
    back = m.inverse(m.forward(x))
    return back.select("event_id", F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(10).cast("long")).alias("tens"))


# datasets, pipelines, schemas


def orders_model(x: DataFrame) -> Dataset:
    keep = ["o_orderpriority", "o_orderdate", "o_totalprice"]
    children = [
        Categorical("cat", ["o_orderpriority"], PRIORITIES, norm="mean_std"), Datetime("date", ["o_orderdate"], norm="min_max"),
        Numeric("mm", ["o_totalprice"], norm="min_max"), Numeric("ms", ["o_totalprice"], norm="mean_std"),
    ]
    return Dataset("ds", keep, children).fit(x)


@query("""WITH s AS (SELECT min(o_totalprice) a, max(o_totalprice) b, avg(o_totalprice) m, stddev_pop(o_totalprice) sd, min(epoch_us(o_orderdate) / 86400000000.0) t0, max(epoch_us(o_orderdate) / 86400000000.0) t1 FROM orders)
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE -1 END AS priority,
 round((epoch_us(o_orderdate) / 86400000000.0 - t0) / (t1 - t0), 6) AS date_num, (epoch_us(o_orderdate) % 86400000000)::BIGINT AS date_diff, round((o_totalprice - a) / (b - a), 6) AS price_mm, round((o_totalprice - m) / sd, 6) AS price_ms FROM orders, s""")
def dataset_encode(spark, d):
    x = read(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    y = encoded(orders_model(x), x, ["o_orderkey"], priority="ds/cat/indices/o_orderpriority", date_num="ds/date/nums/o_orderdate", date_diff="ds/date/diff/o_orderdate", price_mm="ds/mm/nums/o_totalprice", price_ms="ds/ms/nums/o_totalprice")
    return y.select("o_orderkey", "priority", r6("date_num").alias("date_num"), "date_diff", r6("price_mm").alias("price_mm"), r6("price_ms").alias("price_ms"))


@query("SELECT o_orderkey, o_orderpriority, o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM orders")
def dataset_roundtrip(spark, d):
    x = read(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    m = orders_model(x)
    return m.inverse(m.forward(x)).withColumn("o_totalprice", F.round("o_totalprice", 2)).select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity, l_returnflag, l_shipdate FROM lineitem")
def dataset_roundtrip_lineitem(spark, d):
    x = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    m = Dataset("ds", ["l_quantity", "l_returnflag", "l_shipdate"], [Numeric("q", ["l_quantity"], norm="mean_std"), Categorical("f", ["l_returnflag"], ["A", "N"]), Datetime("t", ["l_shipdate"], norm="mean_std")]).fit(x)
    return m.inverse(m.forward(x)).select("l_orderkey", "l_linenumber", F.round("l_quantity", 4).alias("l_quantity"), "l_returnflag", "l_shipdate")


@query("""WITH e AS (SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'), r AS (SELECT e.*, k::INTEGER AS epoch, row_number() OVER (ORDER BY k, event_id) - 1 AS i FROM e, (SELECT unnest(range(2)) k))
SELECT event_id, event_type, value, epoch, (i // 64)::BIGINT AS batch, (i % 64)::INTEGER AS place, 1::INTEGER AS weight FROM r""")
def train_pipeline(spark, d):
    return train_input(read(spark, d, "events"), ["event_id"], epochs=2, keep=["event_id", "event_type", "value"], filters={"event_type": lambda c: c != "error"}, batch_size=64, constants={"weight": 1})


@query("SELECT event_id, value, 0::INTEGER AS epoch FROM events ORDER BY event_id LIMIT 500")
def train_take(spark, d):
    return train_input(read(spark, d, "events"), ["event_id"], take=500, keep=["event_id", "value"])


@query("SELECT * FROM (VALUES ('o_orderpriority', 'VARCHAR(15)'), ('o_orderdate', 'TIMESTAMP'), ('o_totalprice', 'FLOAT')) v(\"column\", type)")
def schema_ddl(spark, d):
    return ddl_frame(spark, orders_model(read(spark, d, "orders")))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/turnback-{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT o_orderkey, o_orderpriority, o_totalprice::FLOAT::DOUBLE AS price, o_orderkey % 7 AS a, o_orderkey % 5 AS b FROM orders")
def records_roundtrip(spark, d):
    """Orders written as record files and read again (floats are all the format has)."""
    spark.dataSource.register(RecordSource)
    path = scratch(spark, "records")
    x = read(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice").withColumn("l", F.array(F.col("o_orderkey") % 7, F.col("o_orderkey") % 5))
    x.write.format("examples").mode("append").save(path)
    y = spark.read.format("examples").schema("o_orderkey bigint, o_orderpriority string, o_totalprice float, l array<bigint>").load(path)
    return y.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("price"), F.get("l", 0).alias("a"), F.get("l", 1).alias("b"))


def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.readStream.schema(read(spark, d, table).schema).parquet(f"{d}/{table}.parquet*")


@query("WITH s AS (SELECT avg(value) a, stddev_pop(value) b FROM events) SELECT event_id, round((value - a) / b, 6) AS num FROM events, s")
def stream_encode(spark, d):
    """A model fitted on a stream, then applied to it: the file source, and Parquet as the sink."""
    fit = OnlineFit(Numeric("n", ["value"], norm="mean_std"))
    out = scratch(spark, "stream")
    q = fit.attach(_stream(spark, d, "events").select("event_id", "value")).option("checkpointLocation", f"{out}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    y = encode_stream(_stream(spark, d, "events").select("event_id", "value"), fit.model)
    y = y.select("event_id", r6("`n/nums/value`").alias("num"))
    q = y.writeStream.format("parquet").option("checkpointLocation", f"{out}/c2").trigger(availableNow=True).start(f"{out}/rows")
    q.awaitTermination()
    return spark.read.schema("event_id bigint, num double").parquet(f"{out}/rows")
