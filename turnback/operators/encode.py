"""Dictionary and one-hot encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnback.functions.scalars import let
from turnback.functions.tokens import lookup

from .base import Elementwise, Op


class CatToIndex(Elementwise):
    """Index of a value in ``values``; unknown ones are -1 and kept in ``missing``."""

    name = "cat_to_index"
    ins = ("cats",)
    outs = ("target", "missing")

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        if len(set(self.params["values"])) != len(self.params["values"]):
            raise ValueError("values must be one to one")

    def fwd(self, cats):
        i = lookup(cats, list(self.params["values"]))
        return {"target": i, "missing": F.when(i == -1, cats)}

    def inv(self, target, missing):
        values = F.array(*map(F.lit, self.params["values"]))
        return {"cats": F.when(target < 0, missing).otherwise(F.get(values, target))}


class MultiCatToIndex(Elementwise):
    """The same with a list for each value of ``selector`` (an unlisted selector: all unknown)."""

    name = "multi_cat_to_index"
    ins = ("cats", "selector")

    @property
    def outs(self):
        return ("target", "missing", "selector")

    def fwd(self, cats, selector):
        i = F.lit(-1)
        for key, values in self.params["values"].items():
            i = F.when(selector == F.lit(key), lookup(cats, list(values))).otherwise(i)
        return {"target": i, "missing": F.when(i == -1, cats), "selector": selector}

    def inv(self, target, missing, selector):
        v = missing
        for key, values in self.params["values"].items():
            v = F.when((selector == F.lit(key)) & (target >= 0), F.get(F.array(*map(F.lit, values)), target)).otherwise(v)
        return {"cats": v, "selector": selector}


def encode_by_join(df: DataFrame, dictionary: DataFrame, columns: list[str], index: str = "index", target: str = "target", missing: str = "missing") -> DataFrame:
    """Dictionary encoding by a left join on ``columns`` (value, or selector and value), for dictionaries of any size:
    Spark broadcasts one under its threshold and shuffles both sides beyond."""
    d = dictionary.select(*[F.col(c).alias(f"__{c}") for c in columns], F.col(index).alias("__index"))
    on = [df[c] == d[f"__{c}"] for c in columns]
    x = df.join(d, on, "left")
    i = F.coalesce(F.col("__index"), F.lit(-1))
    return x.select(*[df[c] for c in df.columns], i.alias(target), F.when(i == -1, df[columns[-1]]).alias(missing))


class OneHot(Op):
    """An array of ``length`` zeros with 1.0 at the index; an index out of range gives zeros and is kept in ``missing``."""

    name = "one_hot"
    ins = ("indices",)
    outs = ("target", "missing")

    def forward(self, cols):
        i, d = self.args(cols)["indices"], int(self.params["length"])
        ok = (i >= 0) & (i < d)
        return {"target": hot(i, d), "missing": F.when(~ok | i.isNull(), i)}

    def inverse(self, cols):
        at = F.array_position(cols["target"], F.lit(1.0))
        return {"indices": F.when(at > 0, (at - 1).cast("int")).otherwise(cols["missing"])}


def hot(i: Column, length: int) -> Column:
    return let(i, lambda v: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.when(k == v, F.lit(1.0)).otherwise(F.lit(0.0))))
