"""What tables of many gigabytes ask for: work in proportion to the input, and batches that stay small in Python."""

import io
import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from turnback import catalog
from turnback.functions import lots
from turnback.functions import tokens as T
from turnback.functions.diff import patch, script
from turnback.operators import make, masking
from turnback.plans import Multilingual
from turnback.sources import records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_multi_tokenize_characters_stay_in_the_jvm(spark):
    """characters were made in Python, for the rows of all languages."""
    df = spark.createDataFrame([(0, "日本 𝔘é", "fr"), (1, "a  b", "en"), (2, "", "fr"), (3, None, "fr"), (4, "", "en")], "id int, s string, lang string")
    op = make("multi_tokenize", tokenizers={"en": "whitespace", "fr": "characters"}, detokenizers={"en": "join", "fr": "concat"}, max_len=None)
    got = op.forward({"strings": F.col("s"), "selector": F.col("lang")})
    tokens = df.select("id", got["target"].alias("t"))
    assert "Python" not in plan(tokens) and "Arrow" not in plan(tokens)
    assert {r.id: r.t for r in tokens.collect()} == {0: list("日本 𝔘é"), 1: ["a", "b"], 2: [], 3: [], 4: []}
    x = df.select("id", "s", "lang", got["target"].alias("t"), got["diff"].alias("d"))
    back = op.inverse({"target": F.col("t"), "diff": F.col("d"), "selector": F.col("lang")})["strings"]
    assert all(r.s == r.back for r in x.select("s", back.alias("back")).collect())


def test_multi_tokenize_functions_see_their_own_rows(spark):
    T.register("__strict", lambda s: [s] if s == "mine" else 1 / 0)
    df = spark.createDataFrame([("mine", "a"), ("other", "b")], "s string, lang string")
    op = make("multi_tokenize", tokenizers={"a": "__strict", "b": "whitespace"}, detokenizers={"a": "join", "b": "join"}, max_len=None)
    assert sorted(r.t for r in df.select(op.forward({"strings": F.col("s"), "selector": F.col("lang")})["target"].alias("t")).collect()) == [["mine"], ["other"]]


def test_flat_tokenize_has_no_row_for_texts_without_words(spark, tmp_path):
    """the query gave them a row without a token, its SQL gives none."""
    df = spark.createDataFrame([(0, "a b"), (1, ""), (2, " \n"), (3, None)], "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, catalog.flat_tokenize(spark, str(tmp_path)).collect())) == [(0, 0, "a"), (0, 1, "b")]


def test_scripts_take_time_in_proportion(spark):
    """texts of other lengths went to difflib, or were replaced as a whole."""
    words = [f"Wörd{i % 97}" for i in range(600)]
    s, t = " ".join(words), "\n\n".join(words)
    began = time.perf_counter()
    for _ in range(50):
        e = script(s, t)
    assert time.perf_counter() - began < 2 and patch(s, e) == t and len(json.loads(e)) == 599
    page = "<div><p>some words</p>\n</div>" * 2000
    e = script(page.replace("<p>", "<para>"), page)
    assert patch(page.replace("<p>", "<para>"), e) == page and len(json.loads(e)) == 2000
    for a, b in (("x " * 300, " y" * 300), ("x " * 300, "x" * 300), (" " * 300, ""), ("", "\n" * 300), ("a\x1fb " * 100, "a b\x1f " * 100), ("é\xa0" * 200, "é " * 200)):
        assert patch(a, script(a, b)) == b and patch(b, script(b, a)) == a


def test_lots(spark):
    """Python held whole batches as objects."""
    x = pa.array(["x" * 5000] * 3000 + [None])
    sizes = [len(a) for a, _ in lots.lots(x, x)]
    assert sum(sizes) == 3001 and max(sizes) * 10_000 <= lots.BYTES
    assert lots.by_lot(lambda a: a, x).equals(x) and lots.by_lot(lambda a: a, x.slice(0, 0)).equals(x.slice(0, 0))


def test_texts_are_encoded_in_one_function(spark):
    """tokens were split again for each output and looked up in every language's words."""
    rows = [(0, "The  CAT ﬁts\n", "en"), (1, "Ça va ΑΣ", "fr"), (2, None, "fr"), (3, "", "en"), (4, "a\x1cb", "en"), (5, "x " * 400 + "Ⅷ\n\nY", "en")]
    df = spark.createDataFrame(rows, "id int, s string, lang string")
    names = ["en", "fr"]
    m = Multilingual("m", ["s", "lang"], dict.fromkeys(names, "whitespace"), dict.fromkeys(names, "join"), max_len=None, max_vocab=70, lower=True, half=True).fit(df)
    y = m.forward(df)
    shown = plan(y)
    assert shown.count("ArrowEvalPython") == 1 and "(?U)" not in shown
    assert sorted(map(tuple, m.inverse(y).select("id", "s", "lang").collect())) == rows
    got = {r.id: r for r in y.collect()}
    assert [m.state["words"]["en"][i] for i in got[0]["m/indices/s"]] == ["the", "cat", "fits"] and len(got[5]["m/indices/s"]) == 402
    with pytest.raises(Exception, match="no tokenizer for"):
        Multilingual("m", ["s", "lang"], {"en": "whitespace"}, {"en": "join"}, max_vocab=9).fit(df)


def test_random_replace_draws_no_more_than_it_needs(spark):
    """all positions were drawn, once for each output."""
    op = make("random_replace", prob=0.3, max_replace=4, with_="#", do_not_replace=["k"], seed=3)
    df = spark.createDataFrame([(i, [("k", "a", "b", None)[(i + j) % 4] for j in range(i)]) for i in range(40)] + [(99, None)], "id int, a array<string>")
    got = op.forward({"a": F.col("a"), "key": F.col("id")})
    y = df.select("id", "a", *(got[o].alias(o) for o in ("target", "positions", "replaced")))
    draws = df.select("id", F.posexplode("a").alias("pos", "v")).withColumn("u", masking.hashed_uniform(F.col("id"), F.col("pos"), F.lit(3)))
    want = {}
    for r in draws.filter((F.col("u") < 0.3) & (F.col("v") != "k")).orderBy("id", F.desc("pos")).collect():
        want.setdefault(r.id, []).append(r.pos)
    for r in y.collect():
        if r.a is not None:
            assert r.positions == want.get(r.id, [])[:4] and r.replaced == [r.a[i] for i in r.positions]
            assert r.target == ["#" if i in r.positions else v for i, v in enumerate(r.a)]
    back = op.inverse({"target": F.col("target"), "positions": F.col("positions"), "replaced": F.col("replaced"), "key": F.col("id")})["a"]
    assert all(r.a == r.b for r in y.select("a", back.alias("b")).collect())
    assert plan(y).count("aggregate(") == 1 or plan(y.select("target")).count("md5(") == 1


def test_nsp_pairs_computes_its_segments_once(spark, sf):
    """F8: tokens were split again for each place of a row, by filters pushed into the lambdas."""
    assert "(?U)" not in plan(catalog.nsp_pairs(spark, sf))


def test_record_heads_cost_little():
    """each record's head was checked by itself with arrays of one element."""
    assert all(records._masked_one(x) == records.masked([x])[0] for x in (b"", b"\0" * 8, b"\xff" * 8, bytes(range(8))))
    schema = StructType([StructField("id", LongType()), StructField("s", StringType()), StructField("l", ArrayType(LongType()))])
    encode, decode = records.encoder(schema), records.decoder(schema)
    rows = [(i * 7**9 - 5, None if i % 3 else "é" * (i % 200), [i, -i][: i % 3]) for i in range(5000)]
    stream = b"".join(records.frames([encode(r) for r in rows[k : k + 512]]) for k in range(0, 5000, 512))
    assert [decode(m) for m in records.unframe(io.BytesIO(stream))] == rows
    began = time.perf_counter()
    n = sum(1 for _ in records.unframe(io.BytesIO(stream)))
    assert n == 5000 and time.perf_counter() - began < 0.4
    for at in (3, 9, 20):
        with pytest.raises(ValueError, match="damaged record at byte 0"):
            list(records.unframe(io.BytesIO(stream[:at] + bytes([stream[at] ^ 1]) + stream[at + 1 :])))
