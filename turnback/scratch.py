"""Tables written once to the shared folder, where a plan must not be computed twice."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from turnback.session import shared_dir

_made: list[tuple[SparkSession, str]] = []


def place(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/turnback-{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: later plans see the same rows, whatever is recomputed or lost."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cleanup() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone already
            pass


atexit.register(_cleanup)
