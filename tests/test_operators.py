"""Goldens and round trips of the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from turnback.functions.diff import patch, script
from turnback.operators import OPS, arrays, masking, make, packing, text
from turnback.operators.encode import encode_by_join
from turnback.operators.reduce import reduce

INF, NAN = float("inf"), float("nan")


def eq(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) < 1e-9
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(eq, a, b))
    return a == b


def run(spark, op, schema, rows):
    """(outputs by name, inputs after the inverse) for rows of the operator's free inputs."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {schema}")
    got = op.forward({i: F.col(i) for i in op.free})
    out = df.select("id", *(got[o].alias(f"o_{o}") for o in op.outs))
    back = op.inverse({o: F.col(f"o_{o}") for o in op.outs})
    done = out.select("*", *(back[i].alias(f"b_{i}") for i in op.free)).orderBy("id").collect()
    outs = {o: [plain(r[f"o_{o}"]) for r in done] for o in op.outs}
    return outs, [tuple(plain(r[f"b_{i}"]) for i in op.free) for r in done]


def plain(v):
    if isinstance(v, list):
        return [plain(x) for x in v]
    return tuple(v) if isinstance(v, tuple) else v


CASES = [
    ("add", {}, {}, "a bigint, b bigint", [(1, 3), (2, 4)], {"target": [4, 6]}),
    ("add", {"b": 2}, {}, "a bigint", [(1,), (2,)], {"target": [3, 4]}),
    ("add", {}, {"keep": "a"}, "a double, b double", [(1.0, 3.5), (None, 1.0)], {"target": [4.5, None]}),
    ("sub", {}, {"keep": "a"}, "a bigint, b bigint", [(1, 3), (2, 5)], {"target": [-2, -3]}),
    ("sub", {"a": 10}, {}, "b bigint", [(3,), (4,)], {"target": [7, 6]}),
    ("sub", {"b": 10.0}, {}, "a double", [(3.0,), (INF,)], {"target": [-7.0, INF]}),
    ("mul", {}, {}, "a double, b double", [(0.0, 3.0), (2.0, 0.0), (4.0, 2.5)], {"target": [0.0, 0.0, 10.0], "missing": [0.0, 2.0, None]}),
    ("mul", {"b": 0.0}, {}, "a double", [(1.0,), (4.0,)], {"target": [0.0, 0.0], "missing": [1.0, 4.0]}),
    ("div", {}, {"whole": True}, "a bigint, b bigint", [(1, 2), (7, -3), (-7, 2), (-7, -2), (6, -3)], {"target": [0, -3, -4, 3, -2], "remainder": [1, -2, 1, -1, 0]}),
    ("div", {}, {"whole": True, "keep": "a"}, "a bigint, b bigint", [(7, 3), (7, 4)], {"target": [2, 1]}),
    ("div", {}, {}, "a double, b double", [(0.0, 3.0), (2.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (3.0, 2.0)], {"target": [0.0, INF, NAN, -INF, 1.5], "missing": [None, 2.0, 0.0, -1.0, None]}),
    ("div", {"b": 4.0}, {}, "a double", [(2.0,), (NAN,), (None,)], {"target": [0.5, NAN, None]}),
    ("mul", {}, {}, "a double, b double", [(NAN, 2.0), (2.0, NAN), (INF, 0.5), (2.0, INF), (None, 1.0), (1.0, None)], {}),
    ("add", {}, {}, "a double, b double", [(NAN, 2.0), (2.0, NAN), (INF, 0.5), (2.0, INF), (None, 1.0), (1.0, None)], {}),
    ("div", {}, {}, "a double, b double", [(NAN, 2.0), (2.0, NAN), (INF, 0.5), (2.0, INF), (None, 1.0), (1.0, None)], {}),
    ("phase_decomp", {}, {"freqs": [3.0, 1.4]}, "a double", [(-0.25,), (0.7,), (10.1,)], {"target": [[0.25, 0.65], [0.1, 0.98], [0.3, 0.14]], "div": [[-1.0, -1.0], [2.0, 0.0], [30.0, 14.0]]}),
    ("phase_decomp", {}, {"freqs": [0.0]}, "a double", [(1.4,)], {"target": [[0.0]]}),
    ("isnan", {}, {}, "a double", [(1.0,), (NAN,), (None,)], {"target": [False, True, True]}),
    ("isnat", {}, {}, "a timestamp_ntz", [(dt.datetime(2019, 1, 1),), (None,)], {"target": [False, True]}),
    ("greater", {}, {}, "a double, b double", [(1.0, 0.0), (NAN, 0.0), (0.0, NAN), (NAN, NAN), (None, 1.0)], {"target": [True, False, False, False, False]}),
    ("greater_equal", {}, {}, "a double, b double", [(1.0, 1.0), (NAN, NAN), (0.0, -0.0)], {"target": [True, False, True]}),
    ("less", {}, {}, "a double, b double", [(1.0, 2.0), (1.0, NAN)], {"target": [True, False]}),
    ("less_equal", {"b": 2.0}, {}, "a double", [(2.0,), (3.0,), (NAN,)], {"target": [True, False, False]}),
    ("equals", {}, {}, "a double, b double", [(1.0, 1.0), (NAN, NAN), (None, None)], {"target": [True, False, False]}),
    ("equals", {}, {"floating": False}, "a string, b string", [("x", "x"), ("x", "y"), (None, "x")], {"target": [True, False, False]}),
    ("isin", {}, {"values": ["a", "b"]}, "a string", [("a",), ("c",), (None,)], {"target": [True, False, False]}),
    ("isin", {}, {"values": [f"v{i}" for i in range(100)]}, "a string", [("v7",), ("c",)], {"target": [True, False]}),
    ("multi_isin", {}, {"values": {"en": ["a"], "de": ["b"]}}, "a string, selector string", [("a", "en"), ("a", "de"), ("b", "de"), ("b", "fr")], {"target": [True, False, True, False]}),
    ("logical_not", {}, {}, "a boolean", [(True,), (False,), (None,)], {"target": [False, True, None]}),
    ("reduce", {}, {"kind": "std"}, "a array<double>", [([1.0, 3.0],)], {"target": [1.0]}),
    ("reduce", {}, {"kind": "min"}, "a array<double>", [([1.0, NAN],), ([2.0, 1.0],)], {"target": [NAN, 1.0]}),
    ("reduce", {}, {"kind": "max"}, "a array<double>", [([1.0, 4.0, 2.0],)], {"target": [4.0]}),
    ("reduce", {}, {"kind": "sum"}, "a array<double>", [([1.0, 4.0],), ([],)], {"target": [5.0, 0.0]}),
    ("reduce", {}, {"kind": "mean"}, "a array<double>", [([1.0, 4.0],)], {"target": [2.5]}),
    ("reduce", {}, {"kind": "all"}, "a array<boolean>", [([True, False],), ([True],)], {"target": [False, True]}),
    ("reduce", {}, {"kind": "any"}, "a array<boolean>", [([True, False],), ([False],)], {"target": [True, False]}),
    ("cat_to_index", {}, {"values": ["a", "b", "c", "d"]}, "cats string", [("a",), ("e",), ("d",), (None,)], {"target": [0, -1, 3, -1], "missing": [None, "e", None, None]}),
    ("cat_to_index", {}, {"values": [1.0, NAN]}, "cats double", [(1.0,), (NAN,), (2.0,)], {"target": [0, 1, -1], "missing": [None, None, 2.0]}),
    ("multi_cat_to_index", {}, {"values": {"en": ["a", "b"], "de": ["b"]}}, "cats string, selector string", [("b", "en"), ("b", "de"), ("a", "de"), ("a", "fr")], {"target": [1, 0, -1, -1], "missing": [None, None, "a", "a"]}),
    ("one_hot", {}, {"length": 3}, "indices int", [(2,), (3,), (-1,), (None,)], {"target": [[0.0, 0.0, 1.0], [0.0] * 3, [0.0] * 3, [0.0] * 3], "missing": [None, 3, -1, None]}),
    ("cast", {}, {"dtype": "bigint"}, "a double", [(1.5,), (-1.7,), (NAN,), (INF,), (None,)], {"target": [1, -1, None, None, None], "diff": [0.5, -0.7, None, None, None]}),
    ("cast", {}, {"dtype": "boolean"}, "a double", [(0.5,), (0.0,)], {"target": [True, False], "diff": [-0.5, 0.0]}),
    ("cast", {}, {"dtype": "bigint", "source": "string"}, "a string", [("7",), ("x",), ("07",)], {"target": [7, None, 7], "missing": [None, "x", "07"]}),
    ("datetime_to_num", {}, {"unit": "W", "num_units": 2}, "a timestamp_ntz", [(dt.datetime(2019, 1, 1),), (dt.datetime(2019, 2, 1),), (None,), (dt.datetime(1969, 12, 30, 1, 2, 3, 4),)], {"diff": [5 * 86400 * 10**6, 86400 * 10**6, None, -(2 * 86400 - 3723) * 10**6 + 4]}),
    ("lower_case", {}, {}, "strings string", [("Whatever, Bob's mad",), (None,), ("",), ("ÀİΣ 𝔘",)], {"target": ["whatever, bob's mad", None, "", "ài̇ς 𝔘"]}),
    ("half_width", {}, {}, "strings string", [("１００ yen",), ("plain",), (None,)], {"target": ["100 yen", "plain", None], "diff": ['[["i", 0, 3, "\\uff11\\uff10\\uff10"]]', "[]", None]}),
    ("replace_substring", {}, {"old": "is", "new": "xy"}, "strings string", [("this is his",), ("",)], {"target": ["thxy xy hxy", ""]}),
    ("lemmatize", {}, {"lemmatizer": "plural"}, "strings string", [("cats",), ("glass",), (None,)], {"target": ["cat", "glass", None]}),
    ("tokenize", {}, {"tokenizer": "whitespace", "detokenizer": "join_all", "max_len": 10}, "strings string", [("so be it then",)], {"target": [["so", "be", "it", "then"] + [""] * 6], "diff": ['[["d", 13, 19, ""]]']}),
    ("tokenize", {}, {"tokenizer": "words", "detokenizer": "join", "max_len": 3}, "strings string", [("Hey, you  there!",), ("",), ("  ",), (None,)], {"target": [["Hey", ",", "you"], [""] * 3, [""] * 3, [""] * 3]}),
    ("multi_tokenize", {}, {"tokenizers": {"en": "whitespace", "ja": "characters"}, "detokenizers": {"en": "join", "ja": "concat"}, "max_len": 2}, "strings string, selector string", [("a b c", "en"), ("日本語", "ja")], {"target": [["a", "b"], ["日", "本"]]}),
    ("replace", {"with_": 0.0}, {}, "a double, mask boolean", [(1.0, True), (2.0, False), (None, True)], {"target": [0.0, 2.0, 0.0], "replaced": [1.0, None, None]}),
    ("random_replace", {}, {"prob": 0.5, "max_replace": 2, "with_": "x", "do_not_replace": ["keep"]}, "a array<string>, key int", [(["a", "b", "keep", "c", "d", "e"], i) for i in range(20)], {}),
    ("random_choice", {}, {"choices": ["a", "b"], "p": [1.0, 0.0], "size": 2}, "key int", [(1,), (2,)], {"target": [["a", "a"]] * 2}),
    ("concatenate", {}, {"n": 2}, "a0 array<int>, a1 array<int>", [([1], [2, 3]), ([], [4])], {"target": [[1, 2, 3], [4]]}),
    ("split", {}, {"indices": [1, 3]}, "a array<int>", [([1, 2, 3, 4],), ([1],)], {"t0": [[1], [1]], "t1": [[2, 3], []], "t2": [[4], []]}),
    ("split", {}, {"parts": 2, "size": 4}, "a array<int>", [([1, 2, 3, 4],)], {"t0": [[1, 2]], "t1": [[3, 4]]}),
    ("partition_by_index", {}, {"indices": [[1], [0, 1], [4]], "size": 7}, "a array<int>", [(list(range(7)),)], {"t0": [[1]], "t1": [[0, 1]], "t2": [[4]], "rest": [[2, 3, 5, 6]]}),
    ("flatten", {}, {}, "a array<array<int>>", [([[1, 2], [], [3]],)], {"target": [[1, 2, 3]], "sizes": [[2, 0, 1]]}),
    ("reshape", {}, {"width": 3}, "a array<int>", [(list(range(6)),), ([],)], {"target": [[[0, 1, 2], [3, 4, 5]], []]}),
    ("transpose", {}, {}, "a array<array<int>>", [([[1, 2, 3], [4, 5, 6]],)], {"target": [[[1, 4], [2, 5], [3, 6]]]}),
    ("tile", {}, {"reps": 2}, "a array<int>", [([1, 2],)], {"target": [[1, 2, 1, 2]]}),
    ("getitem", {}, {"key": -1}, "a array<int>", [([1, 2],), ([],)], {"target": [2, None]}),
    ("getitem", {}, {"key": 1, "stop": 3}, "a array<int>", [([1, 2, 3, 4],)], {"target": [[2, 3]]}),
    ("shape", {}, {"rank": 2}, "a array<array<int>>", [([[1, 2, 3], [4, 5, 6]],)], {"target": [[2, 3]]}),
    ("dim_size", {}, {"axis": 1}, "a array<array<int>>", [([[1, 2, 3], [4, 5, 6]],)], {"target": [3]}),
    ("effective_length", {}, {"default": 0}, "a array<int>", [([1, 0, 3, 0, 0],), ([0, 0],), ([],)], {"target": [3, 0, 0]}),
    ("clone", {}, {}, "a int", [(1,)], {"t0": [1], "t1": [1]}),
    ("clone_many", {}, {"num": 3}, "a int", [(1,)], {"t2": [1]}),
    ("merge_equal", {}, {"n": 2, "test_equal": True}, "a0 int, a1 int", [(1, 1), (None, None)], {"target": [1, None]}),
    ("do_nothing", {}, {}, "a int", [(1,)], {"target": [1]}),
    ("print_val", {}, {}, "a int", [(1,)], {"target": [1]}),
    ("iter_list", {}, {"num_entries": 2}, "a array<int>", [([5, 6],)], {"t0": [5], "t1": [6]}),
    ("iter_dict", {}, {"keys": ["x", "y"]}, "a struct<x:int,y:int>", [((1, 2),)], {"x": [1], "y": [2]}),
    ("iter_dict", {}, {"keys": ["x"], "map": True}, "a map<string,int>", [({"x": 1},)], {"x": [1]}),
    ("port_list", {}, {"n": 2}, "a0 int, a1 int", [(1, 2)], {"target": [[1, 2]]}),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_golden_and_round_trip(spark, case):
    name, bound, params, schema, rows, want = case
    outs, back = run(spark, make(name, bound, **params), schema, rows)
    for o, v in want.items():
        assert eq(outs[o], v), (o, outs[o])
    assert eq(back, [tuple(plain(v) for v in r) for r in rows]), back


def test_every_operator_has_a_case():
    assert set(OPS) == {c[0] for c in CASES}


def test_random_replace_respects_its_limits(spark):
    case = next(c for c in CASES if c[0] == "random_replace")
    outs, _ = run(spark, make(case[0], **case[2]), case[3], case[4])
    for t, p in zip(outs["target"], outs["positions"]):
        assert len(p) <= 2 and t[2] == "keep" and p == sorted(p, reverse=True) and all(t[i] == "x" for i in p)
    assert 10 <= sum(map(len, outs["positions"])) <= 40


@pytest.mark.parametrize("depth,schema,rows", [(1, "a array<double>, b array<double>", [([1.0, 0.0], [2.0, 5.0])]), (2, "a array<array<double>>, b array<array<double>>", [([[1.0], [3.0, 4.0]], [[2.0], [0.0, 1.0]])])])
def test_arrays_of_any_depth(spark, depth, schema, rows):
    for name in ("add", "sub", "mul", "div"):
        outs, back = run(spark, make(name, depth=depth), schema, rows)
        assert eq(back, rows)
    outs, _ = run(spark, make("cat_to_index", values=[1.0, 2.0], depth=depth), schema.split(",")[0].replace("a ", "cats ", 1) if depth == 1 else "cats array<array<double>>", [(rows[0][0],)])
    assert eq(outs["target"], [[0, -1]] if depth == 1 else [[[0], [-1, -1]]])


def test_errors(spark):
    df = spark.createDataFrame([(1, 0)], "a bigint, b bigint")
    with pytest.raises(Exception, match="division by zero"):
        df.select(make("div", whole=True).forward({"a": F.col("a"), "b": F.col("b")})["target"]).collect()
    with pytest.raises(Exception, match="differ"):
        df.select(make("merge_equal", n=2, test_equal=True).forward({"a0": F.col("a"), "a1": F.col("b")})["target"]).collect()
    for name, params in (("cat_to_index", {"values": ["a", "a"]}), ("datetime_to_num", {"unit": "M"}), ("datetime_to_num", {"unit": "ns"}), ("iter_list", {}), ("iter_dict", {})):
        with pytest.raises(ValueError):
            make(name, **params)
    with pytest.raises(ValueError):
        make("nothing")
    with pytest.raises(ValueError):
        make("add", {"z": 1})


def test_diff_golden():
    s, t = "One Two; three", "One two threes"
    assert script(s, t) == '[["i", 4, 5, "t"], ["d", 7, 8, ""], ["i", 14, 14, "s"]]'
    for a, b in ((s, t), ("", "x"), ("x", ""), ("a" * 9000 + "b" + "c" * 9000, "a" * 9000 + "c" * 9001), ("Ab" * 3000, "aB" * 3000), ("A" + "b" * 999, "a" + "b" * 999)):
        assert patch(a, script(a, b)) == b
    assert script(None, "x") is None and patch("x", None) == "x"


def test_reductions(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, NAN)], "x double, y double")
    assert eq(tuple(reduce(df, "min", ["x", "y"], 0).first()), (1.0, NAN))
    assert eq(tuple(reduce(df, "std", ["x"], 0).first()), (1.0,))
    assert eq(reduce(df, "max", ["x", "y"]).first()[0], NAN)
    assert [r.target for r in reduce(df.select("x"), "sum", ["x"], 1).orderBy("x").collect()] == [1.0, 3.0]
    assert reduce(df, "mean", ["x"], (0, 1)).first()[0] == 2.0
    b = spark.createDataFrame([(True,), (False,)], "b boolean")
    assert [reduce(b, k, ["b"]).first()[0] for k in ("all", "any")] == [False, True]
    with pytest.raises(ValueError):
        reduce(df, "median", ["x"])


def test_encode_by_join(spark):
    df = spark.createDataFrame([("en", "a"), ("de", "a"), (None, "a"), ("en", None)], "lang string, tok string")
    d = spark.createDataFrame([("en", "a", 5)], "lang string, tok string, index int")
    got = {(r.lang, r.tok): (r.target, r.missing) for r in encode_by_join(df, d, ["lang", "tok"]).collect()}
    assert got == {("en", "a"): (5, None), ("de", "a"): (-1, "a"), (None, "a"): (-1, "a"), ("en", None): (-1, None)}


def test_flat_tokenize(spark):
    rows = [(1, "a  b c"), (2, ""), (3, None), (4, "  "), (5, "x")]
    df = spark.createDataFrame(rows, "id int, s string")
    flat = text.flat_tokenize(df, "s", ["id"])
    assert [(r.pos, r.token) for r in flat.filter("id = 1").orderBy("pos").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert sorted((r.id, r.s) for r in text.flat_detokenize(flat, ["id"], "s").collect()) == rows


def test_rows(spark):
    x = arrays.numbered(spark.range(0, 70, 10).toDF("k").repartition(3), ["k"])
    assert [r.idx for r in x.orderBy("k").collect()] == list(range(7))
    parts, rest = arrays.partition_ranges(x, [(1, 2), (0, 2), (4, 5)])
    assert sorted((r.part, r.idx) for r in parts.collect()) == [(0, 1), (1, 0), (1, 1), (2, 4)]
    assert sorted(r.idx for r in rest.collect()) == [2, 3, 5, 6]
    assert sorted(map(tuple, arrays.unpartition(parts, rest).collect())) == sorted(map(tuple, x.select(*rest.columns).collect()))
    cut = arrays.split_rows(x, [2, 5])
    assert [c.count() for c in cut] == [2, 3, 2]
    whole = arrays.concatenate_rows(cut)
    assert [p.count() for p in arrays.separate_rows(whole, 3)] == [2, 3, 2]
    assert arrays.tile_rows(x, 2).count() == 14
    assert tuple(arrays.frame_shape(x).first()) == (7, 2)
    a, b = masking.remove(x, F.col("idx") > 3)
    assert (a.count(), b.count(), masking.restore(a, b).count()) == (3, 4, 7)
    t = arrays.transpose_frame(spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "k int, x int, y int"), "k", ["x", "y"], [0, 1])
    assert sorted(map(tuple, t.collect())) == [("x", 1, 3), ("y", 2, 4)]
    assert arrays.numbered(x.drop("idx").limit(0), ["k"]).count() == 0


def test_replace_listed(spark):
    df = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate([(0, True), (1, False), (2, True), (3, True)])], "id int, v int, m boolean")
    vals = spark.createDataFrame([(0, 6), (1, 7)], "pos int, value int")
    got = masking.replace_listed(df, "v", F.col("m"), vals, ["id"]).orderBy("id").collect()
    assert [(r.target, r.replaced) for r in got] == [(6, 0), (1, None), (7, 2), (3, 3)]


LENGTHS = [3, 2, 5, 1, 6, 2, 2]
PACKED = [[10 + k] * n + [0] * (6 - n) for k, n in enumerate(LENGTHS)]
PACKED[2][2] = 0  # a default value inside a row


def test_pack(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(PACKED)] + [("t", 0, [9] + [0] * 5), ("t", 1, [0] * 6)], "sl string, row int, v array<int>")
    packs, where = packing.pack(df.repartition(3), "sl", "row", "v", 6, 2, 0)
    got = [(r.pack, r.slot, r.row, r.start, r.end) for r in where.filter("sl = 's'").orderBy("row").collect()]
    assert got == [(0, 0, 0, 0, 3), (0, 1, 1, 3, 5), (1, 0, 2, 0, 5), (1, 1, 3, 5, 6), (2, 0, 4, 0, 6), (3, 0, 5, 0, 2), (3, 1, 6, 2, 4)]
    rows = packs.filter("sl = 's'").orderBy("pack").collect()
    assert [r.target for r in rows] == [[10] * 3 + [11] * 2 + [0], [12, 12, 0, 12, 12, 13], [14] * 6, [15] * 2 + [16] * 2 + [0] * 2]
    assert [[i for i, e in enumerate(r.ends) if e] for r in rows] == [[2, 4], [4, 5], [5], [1, 3]]
    back = packing.unpack(packs, where, "sl", 6, 0, values="v").orderBy("sl", "row").collect()
    assert [r.v for r in back] == [*PACKED, [9] + [0] * 5, [0] * 6]
    comp = packing.pack_with_row_map(df.withColumn("w", F.col("row") * 10), where, "sl", "row", "w", 2, -1)
    assert [r.target for r in comp.filter("sl = 's'").orderBy("pack").collect()] == [[0, 10], [20, 30], [40, -1], [50, 60]]
    assert packing.unpack_with_row_map(comp, where, "sl").count() == 9
    fold = packing.plan_column(F.array(*(F.struct(F.lit(i).alias("row"), F.lit(n).alias("len")) for i, n in enumerate(LENGTHS))), 6, 2)
    assert [tuple(x) for x in spark.range(1).select(fold.alias("m")).first().m] == got


def test_segment_pairs(spark):
    rows = []
    for i in range(40):
        n = 1 + i % 9
        rows.append((i, [f"w{i}_{j}" for j in range(n)] + [""] * (10 - n), [j % 3 == 1 and j < n or j == n - 1 for j in range(10)]))
    df = spark.createDataFrame(rows, "key int, tokens array<string>, ends array<boolean>")
    y = masking.segment_pairs(df.repartition(3), "key", "tokens", "ends")
    got = {r.key: r for r in y.collect()}
    again = {r.key: r for r in masking.segment_pairs(df, "key", "tokens", "ends").collect()}
    assert got == again
    for r in got.values():
        cut = r.target.index("[SEP]")
        assert len(r.target) == len(r.segment_ids) == len(r.removed) == 13 and r.target[0] == "[CLS]" and r.target.count("[SEP]") == 2
        assert r.segment_ids == [0] * (cut + 1) + [1] * (12 - cut)
        assert (r.removed.count("[NA]") < 13) == r.is_random_next
    assert 5 < sum(r.is_random_next for r in got.values()) < 35
    back = {r.key: r.tokens for r in masking.unsegment_pairs(y, "key").collect()}
    assert back == {r[0]: r[1] for r in rows}


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("parts", ["2", "16", "200"])
def test_numbers_are_dense_and_in_order(spark, aqe, parts):
    x = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").repartition(8)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        y = arrays.numbered(x, ["l_orderkey", "l_linenumber"])
        n, most, rows, keys, every = y.selectExpr("count(distinct idx)", "max(idx)", "count(*)", "count(distinct idx, l_orderkey)", "sum(l_quantity)").first()
        assert (n, most, rows, keys) == (600_000, 599_999, 600_000, 600_000)
        assert every == x.selectExpr("sum(l_quantity)").first()[0]
        steps = y.filter("idx % 1000 = 0").orderBy("idx").toPandas()
        assert steps.l_orderkey.is_monotonic_increasing
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_numbers_of_odd_frames(spark):
    x = spark.createDataFrame([(None, 1), (3, 2), (3, 2), (None, 5)], "k int, __pid int")
    got = arrays.numbered(x, ["k"]).orderBy("idx").collect()
    assert [r.idx for r in got] == [0, 1, 2, 3] and [r.k for r in got] == [None, None, 3, 3] and got[0].asDict().keys() == {"k", "__pid", "idx"}
    assert arrays.numbered(x.limit(0), ["k"]).count() == 0


def test_replace_listed_beyond_one_partition(spark):
    x = spark.range(40).selectExpr("id", "id * 2 as a").repartition(5)
    values = spark.createDataFrame([(i, -i) for i in range(15)], "pos long, value long")
    got = {r.id: (r.target, r.replaced) for r in masking.replace_listed(x, "a", F.col("id") % 2 == 0, values, ["id"]).collect()}
    assert got == {i: ((-(i // 2) if i // 2 < 15 else 2 * i, 2 * i) if i % 2 == 0 else (2 * i, None)) for i in range(40)}
