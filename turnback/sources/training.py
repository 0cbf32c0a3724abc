"""The training input pipeline: take or shuffle and repeat, choose features, filter, batch, add constants."""

from __future__ import annotations

from collections.abc import Callable, Iterator


from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from turnback.operators.arrays import numbered


def train_input(
    df: DataFrame, key: list[str], take: int | None = None, shuffle_seed: int | None = None, epochs: int = 1, keep: list[str] | None = None,
    drop: list[str] | None = None, filters: dict[str, Callable[[Column], Column]] | None = None, batch_size: int | None = None, constants: dict | None = None,
) -> DataFrame:
    """Rows of ``df`` as a model reads them, with ``epoch``, and ``batch`` and ``place`` when they are batched.

    ``take`` (the first rows by ``key``) and shuffling exclude each other. Shuffling orders by a hash of key, epoch and
    seed, so it is the same on every run. Feature selection and filters come first in the plan wherever they can, so
    they reach the scan.
    """
    if take is not None and shuffle_seed is not None:
        raise ValueError("take or shuffle, not both")
    if keep is not None and drop is not None:
        raise ValueError("keep or drop, not both")
    x = df
    if take is not None:
        x = x.orderBy(*key).limit(take)
    if filters:
        for c, f in filters.items():
            x = x.filter(f(F.col(c)))
    names = [c for c in x.columns if (keep is None or c in keep) and c not in (drop or [])]
    x = x.select(*dict.fromkeys([*names, *key]))
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = ["epoch", *key]
    if shuffle_seed is not None:
        x = x.withColumn("__o", F.xxhash64(*key, "epoch", F.lit(shuffle_seed)))
        order = ["epoch", "__o", *key]
    if batch_size:
        x = numbered(x, order, "__i")
        x = x.withColumn("batch", F.floor(F.col("__i") / batch_size).cast("long")).withColumn("place", (F.col("__i") % batch_size).cast("int"))
    elif shuffle_seed is not None:
        x = x.orderBy(*order)
    for c, v in (constants or {}).items():
        x = x.withColumn(c, F.lit(v))
    extra = ["batch", "place"] if batch_size else []
    return x.select(*names, "epoch", *extra, *(constants or {}))


def rows(df: DataFrame) -> Iterator[Row]:
    """Rows of a DataFrame on the driver, one partition at a time."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield row
