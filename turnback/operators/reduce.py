"""Reductions: max, min, sum, mean, std, all, any over rows (axis 0), columns or array cells (axis 1), or everything.

NaN propagates as in array libraries (Spark's own min would skip it); std is the population's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnback.functions.scalars import let

from .base import Op


def _nan_min(c: Column) -> Column:
    return F.when(F.max(F.isnan(c)), F.lit(float("nan"))).otherwise(F.min(c))


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "max": lambda c: F.max(c), "min": _nan_min, "sum": lambda c: F.sum(c), "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_pop(c),
    "all": lambda c: F.bool_and(c.cast("boolean")), "any": lambda c: F.bool_or(c.cast("boolean")),
}


def lift_agg(name: str, fn: Callable[[Column], Column]) -> None:
    """Add an aggregate under ``name`` for axis 0 and for everything."""
    AGGREGATES[name] = fn


def _array(kind: str, a: Column) -> Column:
    zero = F.lit(0.0)
    total = F.aggregate(a, zero, lambda s, x: s + x)
    n = F.size(a)
    if kind == "max":
        return F.array_max(a)
    if kind == "min":
        return F.when(F.exists(a, lambda x: F.isnan(x)), F.lit(float("nan"))).otherwise(F.array_min(a))
    if kind == "sum":
        return total
    if kind == "mean":
        return total / n
    if kind == "std":
        return F.sqrt(let(total / n, lambda m: F.aggregate(a, zero, lambda s, x: s + (x - m) * (x - m))) / n)
    if kind in ("all", "any"):
        return (F.forall if kind == "all" else F.exists)(a, lambda x: x.cast("boolean"))
    raise ValueError(f"no reduction {kind!r}")


class RowReduce(Op):
    """Axis 1: a reduction of an array cell; the array is the residual."""

    name = "reduce"
    ins = ("a",)
    outs = ("target", "a")

    def forward(self, cols):
        a = self.args(cols)["a"]
        return {"target": _array(self.params["kind"], a), "a": a}

    def inverse(self, cols):
        return {"a": cols["a"]}


def reduce(df: DataFrame, kind: str, columns: list[str], axis: int | tuple[int, ...] = ()) -> DataFrame:
    """Axis 0: one row, a value a column. Axis 1: a column ``target`` beside the others. () or (0, 1): one value ``target``.

    Axis 0 and everything are one partial and one final aggregation; only the partial values shuffle.
    """
    if kind not in AGGREGATES:
        raise ValueError(f"no reduction {kind!r}")
    if axis == 0:
        return df.agg(*(AGGREGATES[kind](F.col(c)).alias(c) for c in columns))
    if axis == 1:
        return df.withColumn("target", _array(kind, F.array(*columns)))
    if axis in ((), (0, 1), (1, 0)):
        return df.select(F.explode(F.array(*columns)).alias("v")).agg(AGGREGATES[kind](F.col("v")).alias("target"))
    raise ValueError(f"axis {axis!r}")
