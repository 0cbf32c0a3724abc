"""Tables in memory and in files by extension."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_READ = {".parquet": "parquet", ".orc": "orc", ".json": "json", ".csv": "csv"}


def read(spark: SparkSession, path: str, schema: str | None = None, **options: Any) -> DataFrame:
    """A table by its extension; .npy goes through memory (one array of one or two axes)."""
    ext = Path(path).suffix
    if ext == ".npy":
        return from_array(spark, np.load(path, allow_pickle=False))
    if ext == ".tfrecord":
        r = spark.read.format("examples")
    elif ext in _READ:
        r = spark.read.format(_READ[ext])
    else:
        raise ValueError(f"can't read {ext!r}: one of {sorted([*_READ, '.npy', '.tfrecord'])}")
    if ext == ".csv":
        options = {"header": True} | options
    return (r.schema(schema) if schema else r).options(**options).load(path)


def write(df: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """A table by its extension, in ``files`` files if given."""
    ext = Path(path).suffix
    if ext not in _READ:
        raise ValueError(f"can't write {ext!r}: one of {sorted(_READ)}")
    w = (df.repartition(files) if files else df).write.mode(mode)
    (w.option("header", True) if ext == ".csv" else w).format(_READ[ext]).save(path)


def from_array(spark: SparkSession, a: np.ndarray | pd.DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of a table in memory with their number ``row_id``; columns of an array are c0, c1, ..."""
    if not isinstance(a, pd.DataFrame):
        a = np.asarray(a)
        if a.ndim not in (1, 2):
            raise ValueError("an array of one or two axes is needed")
        a = a.reshape(len(a), -1)
        a = pd.DataFrame(a, columns=columns or [f"c{i}" for i in range(a.shape[1])])
    return spark.createDataFrame(a.assign(row_id=np.arange(len(a), dtype=np.int64)))
