import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("part", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n", T.StringType()),
])


def rows():
    """Nulls in every column, empty and blank texts, long texts, ties, copies, repeated rows; clashing extra columns."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["th", "on", "er", "É", "ß", "日", "a", "Q", "7"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(70))
    long = " ".join(word() for _ in range(30_000))
    texts = [None, "", " \t\n\x0b", "one", "one two", "\x1f\x1c odd", "🙂 MIT  License 🙂", long, long + " end", passage, "x y z\n" + passage + "\nmore", passage + " tail",
             "a b c " * 300, "Same line.\nSame line.\nother\n\nSame line.", "Licensed under the Apache License, Version 2.0.", "<|endoftext|> here " + word()]
    texts += [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(40)]
    texts += [texts[20]] * 6 + [texts[21] + " extra"] * 2
    out = []
    for i, t in enumerate(texts):
        out.append((i * 3 % len(texts) if len(texts) % 3 else i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 4}", None, "k", "f", "z", "p", None, "q", "n"))
    out += [out[10], out[10], out[3]]  # repeated rows
    out += [(out[12][0], "the same id, another text " + passage, *out[12][2:]), (None, "no id at all", *out[5][2:]), (None, None, *out[5][2:])]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    return [(r[0], r[1], r[3]) for r in rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
