"""Turns longer than any fixed width go through the queries whole."""

import pytest
from pyspark.sql import functions as F

from turnback import catalog


@pytest.fixture(scope="module")
def long_turns(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("turns"))
    rows = [(c, t, "user", " ".join(f"w{i}" for i in range(n))) for c in range(2) for t, n in enumerate([3, 299, 130, 0, 70])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def test_nsp_pairs(spark, long_turns):
    got = catalog.nsp_pairs(spark, long_turns).collect()
    assert len(got) == 8 and all(r["same"] for r in got)
    assert all(len(r["target"].split(" ")) == 299 + 3 for r in got)


def test_pack_roundtrip(spark, long_turns, monkeypatch):
    whole = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{long_turns}/conversations.parquet").collect()}
    assert {(r["conv_id"], r["turn"]): r["back"] for r in catalog.pack_roundtrip(spark, long_turns).collect()} == whole
    unpack = catalog.packing.unpack
    monkeypatch.setattr(catalog.packing, "unpack", lambda *a: unpack(*a).withColumn("back", F.slice("back", 1, 128)))
    assert sum(whole[r["conv_id"], r["turn"]] != r["back"] for r in catalog.pack_roundtrip(spark, long_turns).collect()) == 4


def test_packs_hold_whole_turns(spark, long_turns):
    got = catalog.pack_sequences(spark, long_turns).collect()
    assert sorted(r["end"] - r["start"] for r in got) == sorted([3, 299, 130, 0, 70] * 2)
