"""Scratch tables in the folder that all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again, so a
lost executor never costs more than the stages since the last table.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from turnback.session import shared_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def table(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder (in folders by the columns ``by``) and return the written table."""
    return waves([df], name, *by)


def waves(dfs: list[DataFrame], name: str, *by: str) -> DataFrame:
    """One table of several DataFrames, written one after another: each one's shuffle files go before the next begins."""
    spark = dfs[0].sparkSession
    path = f"{shared_dir(spark)}/turnback-{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # these plans run once: their shuffle files can go when the table stands
    try:
        for df in dfs:
            w = df.write.mode("append").option("compression", "zstd")
            (w.partitionBy(*by) if by else w).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(dfs[0].schema).parquet(path)
    out._scratch_path = path
    return out


def free(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that aren't taken."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out


def tidy() -> None:
    """In a Python worker: give memory that the last piece of work freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not the GNU library
        pass


def drop(df: DataFrame, part: str = "") -> None:
    """Delete a table made by :func:`table`, or one folder of it, that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, f"{path}/{part}" if part else path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _cleanup() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone already
            pass


atexit.register(_cleanup)
