"""One-pass column statistics that merge: the state that encoders are fitted from.

Count, missing, mean, sum of squared deviations, minimum and maximum of the values that are there. Filling in missing
values, pooling columns and adding batches are arithmetic on these, so a fit is a single aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    n: int = 0
    missing: int = 0
    mean: float = 0.0
    m2: float = 0.0
    low: float = math.inf
    high: float = -math.inf

    @staticmethod
    def exprs(c: Column, gone: Column, prefix: str) -> list[Column]:
        v = F.when(~gone, c.cast("double"))
        return [
            F.count(v).alias(f"{prefix}_n"), F.count_if(gone).alias(f"{prefix}_missing"), F.avg(v).alias(f"{prefix}_mean"),
            F.var_pop(v).alias(f"{prefix}_var"), F.min(v).alias(f"{prefix}_low"), F.max(v).alias(f"{prefix}_high"),
        ]

    @staticmethod
    def of(row, prefix: str) -> Stats:
        n = row[f"{prefix}_n"]
        if not n:
            return Stats(0, row[f"{prefix}_missing"])
        return Stats(n, row[f"{prefix}_missing"], row[f"{prefix}_mean"], row[f"{prefix}_var"] * n, row[f"{prefix}_low"], row[f"{prefix}_high"])

    def __add__(self, o: Stats) -> Stats:
        n = self.n + o.n
        if not n:
            return Stats(0, self.missing + o.missing)
        d = o.mean - self.mean if self.n and o.n else 0.0
        mean = (self.mean * self.n + o.mean * o.n) / n
        return Stats(n, self.missing + o.missing, mean, self.m2 + o.m2 + d * d * self.n * o.n / n, min(self.low, o.low), max(self.high, o.high))

    def filled(self, value: float) -> Stats:
        """With every missing value replaced by ``value``."""
        return Stats(self.n, 0, self.mean, self.m2, self.low, self.high) + (Stats(self.missing, 0, value, 0.0, value, value) if self.missing else Stats())

    @property
    def std(self) -> float:
        return math.sqrt(self.m2 / self.n) if self.n else 0.0


def shift_scale(s: Stats, norm: str | None) -> tuple[float, float]:
    """What to subtract and to divide by: (mean, std, 1 for 0) or (min, max - min, 1 for 0)."""
    if norm is None or not s.n:
        return 0.0, 1.0
    if norm == "mean_std":
        return s.mean, s.std or 1.0
    return s.low, (s.high - s.low) or 1.0
