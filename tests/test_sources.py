import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnback.sources import files, records
from turnback.sources.training import rows, train_input


def test_checksum_and_framing():
    assert records.crc32c(b"123456789") == 0xE3069283
    many = [b"abc", b"", *(bytes(range(k % 256)) * (k % 3) for k in range(1200))]
    assert records.checksums(many).tolist() == [records.crc32c(m) for m in many]
    data = records.frames(many)
    assert list(records.unframe(io.BytesIO(data))) == many and list(records.unframe(io.BytesIO(b""))) == []
    for bad in (data[:12] + b"x" + data[13:], b"\x04" + data[1:], data[:-1], data[:30]):
        with pytest.raises(ValueError):
            list(records.unframe(io.BytesIO(bad)))


def test_records(spark, tmp_path):
    spark.dataSource.register(records.RecordSource)
    schema = "id bigint, x float, s string, b boolean, a array<int>, t array<string>, e array<float>"
    data = [(1, 1.5, "é", True, [1, -2], ["p", "q"], [0.5]), (-7, None, "", False, [], None, [float("inf")]), (2**62, 0.0, None, None, [3], [""], [])]
    df = spark.createDataFrame(data, schema)
    path = str(tmp_path / "r")
    df.repartition(2).write.format("examples").mode("append").save(path)
    back = spark.read.format("examples").load(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert [r.id for r in spark.read.format("examples").schema("id bigint").load(path).orderBy("id").collect()] == [-7, 1, 2**62]
    df.limit(1).write.format("examples").mode("overwrite").save(path)
    assert spark.read.format("examples").load(path).count() == 1
    with pytest.raises(Exception, match="only numbers"):
        df.select(F.create_map("s", "s").alias("m")).write.format("examples").mode("append").save(str(tmp_path / "q"))


def test_training_input(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.lit("x").alias("s"))
    x = train_input(df, ["id"], shuffle_seed=4, epochs=2, drop=["s"], filters={"k": lambda c: c != 0}, batch_size=10, constants={"w": 1.0})
    got = x.orderBy("batch", "place").collect()
    assert x.columns == ["id", "k", "epoch", "batch", "place", "w"] and len(got) == 132 and got[0].place == 0 and got[-1].batch == 13
    assert {r.epoch for r in got[:66]} == {0} and [r.id for r in got[:66]] != sorted(r.id for r in got[:66])
    assert sorted(r.id for r in got[:66]) == sorted(r.id for r in got[66:])
    again = train_input(df.repartition(7), ["id"], shuffle_seed=4, epochs=2, drop=["s"], filters={"k": lambda c: c != 0}, batch_size=10, constants={"w": 1.0})
    assert again.orderBy("batch", "place").collect() == got
    assert [r.id for r in rows(train_input(df, ["id"], take=5))] == list(range(5))
    with pytest.raises(ValueError):
        train_input(df, ["id"], take=5, shuffle_seed=1)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, s string")
    for ext in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / f"t.{ext}")
        files.write(df, path, files=1)
        assert sorted(map(str, files.read(spark, path, "x int, s string").collect())) == sorted(map(str, df.collect()))
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    assert [tuple(r) for r in files.read(spark, str(tmp_path / "a.npy")).orderBy("row_id").collect()] == [(0.0, 1.0, 0), (2.0, 3.0, 1), (4.0, 5.0, 2)]
    for bad in ("x.h5", "x.pkl"):
        with pytest.raises(ValueError):
            files.read(spark, bad)
