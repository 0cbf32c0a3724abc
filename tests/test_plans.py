import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from turnback.functions import tokens
from turnback.plans import Categorical, Dataset, Datetime, Encoder, Flow, Fourier, Multilingual, Numeric, Text
from turnback.plans.encoders import register_fill
from turnback.streaming.apply import OnlineFit, encode_stream

NAN = float("nan")


def close(a, b):
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(close, a, b))
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) < 1e-6
    return a == b


def both_ways(df, model, keys=("id",)):
    """The encoded rows by id; and the round trip gives the rows back, from the saved model too, on any partitioning."""
    rows = lambda x: [tuple(r) for r in x.select(*df.columns).orderBy(*keys).collect()]
    want = rows(df)
    assert close(rows(model.inverse(model.forward(df))), want)
    again = Encoder.from_dict(__import__("json").loads(__import__("json").dumps(model.to_dict())))
    assert close(rows(again.inverse(again.forward(df.repartition(3)))), want)
    assert model.inverse(model.forward(df.limit(0))).count() == 0
    return model.forward(df).orderBy(*keys).collect()


@pytest.fixture(scope="module")
def num(spark):
    return spark.createDataFrame([(0, 1.0, 2.0, NAN), (1, 4.0, NAN, NAN), (2, 7.0, 8.0, None), (3, 10.0, 11.0, NAN)], "id int, a double, b double, c double")


@pytest.mark.parametrize("norm", [None, "mean_std", "min_max"])
@pytest.mark.parametrize("axis", [0, 1, None])
@pytest.mark.parametrize("fill", [0.0, "mean"])
def test_numeric(num, norm, axis, fill):
    both_ways(num, Numeric("n", ["a", "b", "c"], norm, axis, fill).fit(num))


def test_numeric_goldens(num):
    got = both_ways(num, Numeric("n", ["a", "b", "c"], "min_max").fit(num))
    assert close([r["n/nums/b"] for r in got], [2 / 11, 0.0, 8 / 11, 1.0]) and [r["n/nans/b"] for r in got] == [False, True, False, False]
    assert [r["n/nums/c"] for r in got] == [0.0] * 4
    m = Numeric("n", ["a"], "mean_std").fit(num)
    assert close(m.state["shift"], [5.5]) and close(m.state["scale"], [math.sqrt(11.25)])
    parts = [Numeric("n", ["a", "b"], "mean_std", None).fit(num.filter(f)) for f in ("id < 1", "id >= 1")]
    assert close(parts[0].merge(parts[1]).state["scale"], Numeric("n", ["a", "b"], "mean_std", None).fit(num).state["scale"])
    both_ways(num, Numeric("n", ["a", "b"], "mean_std", exact=True).fit(num).fitted(Numeric("n", ["a", "b"], "mean_std").fit(num).state))


def test_parameters_are_checked(num):
    for e in (Numeric("n", [], None), Numeric("n", ["a"], "zscore"), Numeric("n", ["a"], axis=2), Numeric("n", ["a"], fill="median"), Categorical("c", ["a"]), Categorical("c", ["a"], ["x", "x"]),
              Categorical("c", ["a"], ["x"], norm="min_max"), Datetime("d", ["a"], unit="Y"), Text("t", ["a"]), Fourier("f", ["a"]), Fourier("f", ["a", "b"], end="2020-01-01", top=9),
              Multilingual("m", ["a"], max_vocab=3), Multilingual("m", ["a", "b"], vocab={"en": ["x"]}), Numeric("n", ["zzz"])):
        with pytest.raises(ValueError):
            e.fit(num)
    with pytest.raises(ValueError):
        Numeric("n", ["a"]).forward(num)


def test_categorical(spark):
    df = spark.createDataFrame([(0, "a", "b"), (1, "b", None), (2, "c", "b"), (3, "a", "c")], "id int, x string, y string")
    got = both_ways(df, Categorical("c", ["x", "y"], ["a", "b"]).fit(df))
    assert [r["c/indices/x"] for r in got] == [0, 1, -1, 0] and [r["c/missing_vals/x"] for r in got] == [None, None, "c", None]
    assert got[2]["c/one_hots/x"] == [0.0, 0.0]
    three = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "a")], "id int, x string")
    got = both_ways(three, Categorical("c", ["x"], ["a", "b", "c"], norm="mean_std").fit(three))
    assert close(got[1]["c/one_hots/x"], [-1.0, 1.7320508075688774, -0.5773502691896258])


def test_datetime(spark):
    t = lambda *a: dt.datetime(*a)
    df = spark.createDataFrame([(0, t(2019, 1, 1), None), (1, t(2019, 1, 2, 3, 4, 5, 678901), None), (2, t(1950, 2, 3, 4, 5, 6, 7), t(2019, 2, 1)), (3, None, t(2019, 3, 1))], "id int, x timestamp_ntz, y timestamp_ntz")
    for norm in (None, "mean_std", "min_max"):
        for axis in (0, 1, None):
            both_ways(df, Datetime("t", ["x", "y"], norm, axis).fit(df))
    got = both_ways(df, Datetime("t", ["x"], unit="W", num_units=2).fit(df))
    assert close(got[0]["t/nums/x"], 1278.357142857143) and got[0]["t/diff/x"] == 5 * 86400 * 10**6


SENTENCES = ["So be it, so be it.", "we've been there and we've gone", "Tea isn't green; it's Black. Yes.", "Stop!", "Nobody was waiting at the old gates.", "", "   ", None, "tab\tand  two  spaces ", "１００ Ｙｅｎ 𝔘"]


@pytest.mark.parametrize("how", [{}, {"lower": True}, {"half": True, "lower": True}, {"lemmatizer": "plural", "lower": True, "half": True}, {"max_vocab": 500}])
def test_text(spark, how):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, s string")
    for tok, detok in (("whitespace", "join"), ("words", "join_all"), ("characters", "concat")):
        both_ways(df, Text("t", ["s"], 8, tok, detok, **({"max_vocab": 20} | how)).fit(df))


def test_text_goldens(spark):
    df = spark.createDataFrame([(0, "b a a c"), (1, "a c d")], "id int, s string")
    m = Text("t", ["s"], 5, max_vocab=3).fit(df)
    assert m.state["words"] == ["[UNK]", "a", "c"]
    got = both_ways(df, m)
    assert got[0]["t/indices/s"] == [0, 1, 1, 2, -1] and got[0]["t/missing_vals/s"] == ["b", "", "", "", ""]
    m = Text("t", ["s"], 2, vocab=["[UNK]", "a"]).fit(df)
    assert both_ways(df, m)[1]["t/indices/s"] == [1, 0]


def test_multilingual(spark):
    rows = [(0, "The cat", "en"), (1, "日本語だ", "ja"), (2, "A cat and a dog", "en"), (3, None, "ja")]
    df = spark.createDataFrame(rows, "id int, s string, lang string")
    m = Multilingual("m", ["s", "lang"], {"en": "whitespace", "ja": "characters"}, {"en": "join", "ja": "concat"}, 4, max_vocab=3, lower=True, half=True).fit(df)
    assert m.state["words"] == {"en": ["[UNK]", "a", "cat"], "ja": ["[UNK]", "だ", "日"]}
    assert both_ways(df, m)[0]["m/indices/s"] == [0, 2, -1, -1]
    with pytest.raises(Exception, match="no tokenizer for"):
        m.forward(df.withColumn("lang", F.lit("xx"))).collect()


def test_fourier(spark):
    t = dt.datetime
    df = spark.createDataFrame([(0, t(2019, 1, 1), 1.3), (1, None, 2.0), (2, t(2019, 2, 1), 1.7), (3, t(2019, 3, 1), 2.0)], "id int, t timestamp_ntz, amp double")
    m = Fourier("f", ["t", "amp"], end="2019-03-01 00:00:00", frequencies=3).fit(df)
    got = both_ways(df, m)
    k = m.state["order"]
    start, end = t(1970, 1, 1), t(2019, 3, 1)
    for r, (at, _) in zip(got, [(t(2019, 1, 1), 0), (start, 0), (t(2019, 2, 1), 0), (end, 0)]):
        x = (at - start) / (end - start)
        assert close([r["f/nums/t"][k.index(i)] for i in range(3)], [i * x % 1 for i in range(3)])
        assert [r["f/div/t"][k.index(i)] for i in range(3)] == [i * x // 1 for i in range(3)]
    both_ways(df, Fourier("f", ["t", "amp"], end="2019-03-01", frequencies=3, top=1).fit(df))


def test_dataset(spark, num, tmp_path):
    df = num.withColumn("k", F.when(F.col("id") == 1, "b").when(F.col("id") == 2, "c").otherwise("a")).withColumn("s", F.lit("Who, me?"))
    ds = Dataset("DT", ["a", "b", "k", "s"]).add(Numeric("NUM", ["a", "b"], "min_max")).add(Categorical("CAT", ["k"], ["a", "b", "c"], "mean_std")).add(Numeric("TOO", ["a"], "mean_std")).add(Text("S", ["s"], 4, max_vocab=9))
    with pytest.raises(ValueError):
        ds.add(Numeric("NUM", ["a"]))
    m = ds.fit(df)
    got = both_ways(df, m)
    assert close(got[0]["DT/CAT/one_hots/k"], [1.0, -0.5773502691896258, -0.5773502691896258]) and close(got[1]["DT/NUM/nums/a"], 1 / 3)
    assert m.ddl() == {"a": "FLOAT", "b": "FLOAT", "k": "VARCHAR(1)", "s": "VARCHAR(255)"}
    assert m.create_table("t").startswith('CREATE TABLE "t" (example_id INTEGER PRIMARY KEY')
    assert {f.name for f in m.schema(df)} == set(m.encode()) and m.default_rows(spark, 3).count() == 3
    m.save(str(tmp_path / "m.json"))
    assert Encoder.load(str(tmp_path / "m.json")).to_dict() == m.to_dict()
    with pytest.raises(ValueError):
        Dataset("d", ["a", "b"], [Numeric("n", ["a"])]).fit(df)
    plan = m.forward(df.drop("s").withColumn("s", F.lit(None).cast("string")))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_fit_is_one_aggregation(spark, num):
    ds = Dataset("d", ["a", "b"], [Numeric("x", ["a"], "min_max"), Numeric("y", ["b"], "mean_std")])
    plan = num.agg(*[e for c in ds.children for e in c.fit_exprs(num)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def graph():
    f = Flow("p.")
    x, y = f.input("x"), f.input("y")
    f.name((x - 3.0) / y, "scaled")
    f.name(x * 0.0, "zero")
    f.add("greater", a=x, b=1.0)
    f.name(f.add("lower_case", strings=f.input("s"))["target"], "low")
    return f


def test_flow(spark, tmp_path):
    f = graph()
    df = spark.createDataFrame([(0, 1.0, 2.0, "Ab"), (1, -1.5, 0.0, None), (2, None, 4.0, ""), (3, float("inf"), 1.0, "ZZ")], "id int, x double, y double, s string")
    done = f.forward(df)
    assert {"p.scaled", "p.zero", "p.low"} <= set(done.columns)
    rows = lambda d: [tuple(r) for r in d.select("id", "x", "y", "s").orderBy("id").collect()]
    assert close(rows(f.inverse(done)), rows(df))
    f.save(str(tmp_path / "f.json"))
    g = Flow.load(str(tmp_path / "f.json"))
    assert g.to_json() == f.to_json() and g.forward(df).columns == done.columns
    assert close(rows(g.inverse(g.forward(df.repartition(3)))), rows(df))
    plugged = f.forward(df.drop("y"), plugs={"y": lambda c: c["input/x"] + 1.0})
    assert plugged.filter("id = 0").first()["p.scaled"] == -1.0
    with pytest.raises(ValueError):
        f.forward(df.drop("y"))
    with pytest.raises(ValueError):
        f.forward(df, plugs={"y": 1.0})
    with pytest.raises(ValueError):
        f.inverse(df)
    with pytest.raises(ValueError):
        f.input("x")
    with pytest.raises(ValueError):
        f.add("add", a=f.input("q"))


def test_list_ports(spark):
    f = Flow()
    a, b = f.input("a"), f.input("b")
    both = f.add("port_list", n=2, a0=a, a1=b)["target"]
    parts = f.add("iter_list", a=both, num_entries=2)
    f.name(parts["t0"] + parts["t1"], "sum")
    df = spark.createDataFrame([(7.0, 9.0)], "a double, b double")
    done = f.forward(df)
    assert done.first()["sum"] == 16.0 and tuple(f.inverse(done).select("a", "b").first()) == (7.0, 9.0)


def test_streams(spark, num, tmp_path):
    num.select("id", "a").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, a double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model = Numeric("n", ["a"], "mean_std").fit(num)
    q = encode_stream(stream, model).writeStream.format("memory").queryName("encoded").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert close(sorted(r["n/nums/a"] for r in spark.table("encoded").collect()), sorted(r["n/nums/a"] for r in model.forward(num).collect()))
    fit = OnlineFit(Numeric("n", ["a"], "mean_std"))
    q = fit.attach(stream).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert close(fit.model.state["shift"], model.state["shift"]) and close(fit.model.state["scale"], model.state["scale"])
    fit.update(num, 0)  # a batch handed over again counts once
    assert close(fit.model.state["shift"], model.state["shift"])
    with pytest.raises(ValueError):
        encode_stream(num, model)


def test_registered_tokenizer(spark):
    tokens.register("commas", lambda s: s.split(","))
    df = spark.createDataFrame([(0, "a,b")], "id int, s string")
    both_ways(df, Text("t", ["s"], 3, "commas", "join", max_vocab=5).fit(df))


def test_registered_fills(spark):
    x = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0), (4, 5.0), (5, float("nan"))], "id int, v double")
    for fill, want in (("mode", 5.0), ("median", 5.0), (register_fill("low_and_high", lambda c: (F.min(c) + F.max(c)) / 2), 3.0)):
        m = Numeric("n", ["v"], fill=fill).fit(x)
        assert [r[0] for r in m.forward(x).orderBy("id").select("`n/nums/v`").collect()] == [1.0, want, 5.0, 5.0, want]
        back = [r.v for r in m.inverse(m.forward(x)).orderBy("id").collect()]
        assert back[:4] == [1.0, None, 5.0, 5.0] and back[4] != back[4]
    with pytest.raises(ValueError):
        Numeric("n", ["v"], fill="unheard of").fit(x)


def test_batches_fit_as_the_whole(spark):
    x = spark.range(100).selectExpr("id", "cast(id * id as double) as v", "concat('w', id % 7) as s")
    parts = [x.filter(f"id % 3 = {k}") for k in range(3)]
    for m in (Numeric("n", ["v"], norm="mean_std"), Numeric("n", ["v"], norm="min_max", fill="median"), Text("t", ["s"], max_len=2, max_vocab=5)):
        a, b = m.fit(x), m.fit_batches(iter(parts))
        rows = lambda e: sorted(map(str, e.forward(x).collect()))
        if isinstance(m, Text):
            assert rows(a) == rows(b)
        else:
            assert abs(a.state["shift"][0] - b.state["shift"][0]) < 1e-6 and abs(a.state["scale"][0] / b.state["scale"][0] - 1) < 1e-9
        assert sum(y.count() for y in b.forward_batches(iter(parts))) == 100


def test_plugs_on_both_ends(spark):
    f = Flow()
    x, y = f.input("x"), f.input("y")
    f.name(x * y, "z")
    df = spark.createDataFrame([(1, 2.0), (2, 0.0)], "id int, x double")
    f.plug("y", 3.0)
    done = f.forward(df)
    assert [r.z for r in done.orderBy("id").collect()] == [6.0, 0.0]
    f.unplug("y")
    with pytest.raises(ValueError):
        f.forward(df)
    with pytest.raises(ValueError):
        f.unplug("y")
    whole = f.forward(df, plugs={"y": 3.0})
    lost = next(n for n in f.outputs.values() if n != "z")
    assert {"x", "y"} <= set(f.inverse(whole).columns)
    f.plug(lost, lambda have: have["z"] * 0)
    assert f.inverse(whole.drop(lost)).count() == 2
