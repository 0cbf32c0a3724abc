"""Column expressions with the array-library semantics that the operators need under Spark's ANSI mode."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_US = {"W": 604_800_000_000, "D": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}


def missing(c: Column, floating: bool = True) -> Column:
    """NULL, and NaN for floating columns."""
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def ordered(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A comparison of doubles in which NaN compares false (Spark itself orders NaN last)."""
    return lambda a, b: F.coalesce(op(a, b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")), F.lit(False))


def floor_div(a: Column, b: Column) -> tuple[Column, Column]:
    """Whole quotient rounded down and the remainder with the divisor's sign; a zero divisor raises."""
    safe = F.when(b == 0, F.raise_error(F.lit("integer division by zero")).cast("long")).otherwise(b)
    r = a.cast("long") % safe.cast("long")
    down = ((r != 0) & ((r < 0) != (b < 0))).cast("long")
    q = _whole(a, safe) - down
    return q, a - q * b


def _whole(a: Column, b: Column) -> Column:
    """The quotient truncated toward zero, exact for all longs."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def true_div(a: Column, b: Column) -> Column:
    """a / b with signed infinities and NaN for a zero divisor."""
    a, b = a.cast("double"), b.cast("double")
    sign = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, sign).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def micros_since(ts: Column, zero: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", zero, ts)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, for use inside the lambdas of array functions."""
    return F.get(F.transform(F.array(value), fn), 0)


def nested(fn: Callable[..., Column], depth: int, cols: Sequence[Column], flat: frozenset[int] = frozenset()) -> Column:
    """``fn`` on every element of arrays nested ``depth`` deep; positions in ``flat`` are scalars for all elements."""
    if not depth:
        return fn(*cols)
    lead = next(i for i in range(len(cols)) if i not in flat)

    def at(x: Column, i: Column) -> Column:
        return nested(fn, depth - 1, [c if k in flat else x if k == lead else F.get(c, i) for k, c in enumerate(cols)], flat)

    return F.transform(cols[lead], at)


def hashed_long(*parts: Column) -> Column:
    """A number of 52 bits from values, by md5 of their texts: the same on every run, partitioning and retry, and in SQL."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from values, as :func:`hashed_long`."""
    return hashed_long(*parts) / F.lit(float(1 << 52))
