"""Shape operators: on array cells, on columns, and on rows in a declared order."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnback import scratch

from .base import Op


class Concatenate(Op):
    """Array cells end to end; ``sizes`` is the residual."""

    name = "concatenate"

    @property
    def inputs(self):
        return tuple(f"a{i}" for i in range(self.params["n"]))

    outs = ("target", "sizes")

    def forward(self, cols):
        parts = list(self.args(cols).values())
        return {"target": F.concat(*parts), "sizes": F.array(*map(F.size, parts))}

    def inverse(self, cols):
        out, start = {}, F.lit(1)
        for i in range(self.params["n"]):
            n = F.get(cols["sizes"], i)
            out[f"a{i}"] = F.slice(cols["target"], start, n)
            start = start + n
        return {k: v for k, v in out.items() if k in self.free}


class Split(Op):
    """An array cell cut at ``indices``, or into ``parts`` equal parts of its ``size``."""

    name = "split"
    ins = ("a",)

    @property
    def cuts(self) -> list[int]:
        if "indices" in self.params:
            return list(self.params["indices"])
        size, parts = self.params["size"], self.params["parts"]
        if size % parts:
            raise ValueError("the parts aren't equal")
        return [size // parts * i for i in range(1, parts)]

    @property
    def outs(self):
        return tuple(f"t{i}" for i in range(len(self.cuts) + 1))

    def forward(self, cols):
        a, at = self.args(cols)["a"], [0, *self.cuts]
        ends = [F.lit(c) for c in at[1:]] + [F.size(a)]
        return {f"t{i}": F.slice(a, F.lit(s + 1), F.greatest(e - F.lit(s), F.lit(0))) for i, (s, e) in enumerate(zip(at, ends))}

    def inverse(self, cols):
        return {"a": F.concat(*(cols[o] for o in self.outs))}


class PartitionByIndex(Op):
    """Elements of an array cell at lists of ``indices`` (they may overlap); the others go to ``rest``."""

    name = "partition_by_index"
    ins = ("a",)

    @property
    def outs(self):
        return (*(f"t{i}" for i in range(len(self.params["indices"]))), "rest")

    def _left(self) -> list[int]:
        used = {i for part in self.params["indices"] for i in part}
        return [i for i in range(self.params["size"]) if i not in used]

    def forward(self, cols):
        a = self.args(cols)["a"]
        pick = lambda ix: F.array(*(F.get(a, i) for i in ix)) if ix else F.slice(a, 1, 0)
        return {f"t{k}": pick(ix) for k, ix in enumerate(self.params["indices"])} | {"rest": pick(self._left())}

    def inverse(self, cols):
        where = {i: (f"t{k}", j) for k, ix in enumerate(self.params["indices"]) for j, i in enumerate(ix)} | {i: ("rest", j) for j, i in enumerate(self._left())}
        return {"a": F.array(*(F.get(cols[where[i][0]], where[i][1]) for i in range(self.params["size"])))}


class Flatten(Op):
    """One level of nesting less; ``sizes`` is the residual."""

    name = "flatten"
    ins = ("a",)
    outs = ("target", "sizes")

    def forward(self, cols):
        a = self.args(cols)["a"]
        return {"target": F.flatten(a), "sizes": F.transform(a, lambda r: F.size(r))}

    def inverse(self, cols):
        t, n = cols["target"], cols["sizes"]
        start = lambda i: F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda s, x: s + x)
        return {"a": F.transform(n, lambda k, i: F.slice(t, start(i) + 1, k))}


class Reshape(Op):
    """A flat array cell as rows of ``width`` and back."""

    name = "reshape"
    ins = ("a",)
    outs = ("target",)

    def forward(self, cols):
        a, k = self.args(cols)["a"], int(self.params["width"])
        n = F.floor(F.size(a) / k).cast("int")
        return {"target": F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n), lambda i: F.slice(a, i * k + 1, k))}

    def inverse(self, cols):
        return {"a": F.flatten(cols["target"])}


class Transpose(Op):
    """Rows and columns of a nested array cell exchanged; its own inverse."""

    name = "transpose"
    ins = ("a",)
    outs = ("target",)

    @staticmethod
    def _turn(a: Column) -> Column:
        n = F.coalesce(F.size(F.get(a, 0)), F.lit(0))
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: j < n), lambda j: F.transform(a, lambda r: F.get(r, j)))

    def forward(self, cols):
        return {"target": self._turn(self.args(cols)["a"])}

    def inverse(self, cols):
        return {"a": self._turn(cols["target"])}


class Tile(Op):
    """An array cell repeated ``reps`` times; the inverse takes the first block."""

    name = "tile"
    ins = ("a",)
    outs = ("target",)

    def forward(self, cols):
        return {"target": F.flatten(F.array_repeat(self.args(cols)["a"], int(self.params["reps"])))}

    def inverse(self, cols):
        t = cols["target"]
        return {"a": F.slice(t, F.lit(1), (F.size(t) / F.lit(int(self.params["reps"]))).cast("int"))}


class GetItem(Op):
    """An element (a position, or a name of a struct or map), or with ``stop`` a slice; the whole value is the residual."""

    name = "getitem"
    ins = ("a",)
    outs = ("target", "a")

    def forward(self, cols):
        a, key = self.args(cols)["a"], self.params["key"]
        if "stop" in self.params:
            t = F.slice(a, key + 1, max(0, self.params["stop"] - key))
        elif isinstance(key, int):
            t = F.get(a, key) if key >= 0 else F.when(F.size(a) >= -key, F.try_element_at(a, F.lit(key)))
        else:
            t = a[key]
        return {"target": t, "a": a}

    def inverse(self, cols):
        return {"a": cols["a"]}


class Shape(Op):
    """The sizes of a nested array cell, ``rank`` of them; the value is the residual."""

    name = "shape"
    ins = ("a",)
    outs = ("target", "a")

    def forward(self, cols):
        a = self.args(cols)["a"]
        sizes, x = [], a
        for _ in range(int(self.params.get("rank", 1))):
            sizes.append(F.coalesce(F.size(x), F.lit(0)))
            x = F.get(x, 0)
        return {"target": F.array(*sizes), "a": a}

    def inverse(self, cols):
        return {"a": cols["a"]}


class DimSize(Shape):
    """One of the sizes of :class:`Shape`."""

    name = "dim_size"

    def forward(self, cols):
        a = x = self.args(cols)["a"]
        for _ in range(int(self.params.get("axis", 0))):
            x = F.get(x, 0)
        return {"target": F.coalesce(F.size(x), F.lit(0)), "a": a}


class EffectiveLength(Op):
    """Position after the last element other than ``default`` (0 without one); the array is the residual."""

    name = "effective_length"
    ins = ("a",)
    outs = ("target", "a")

    def forward(self, cols):
        a = self.args(cols)["a"]
        return {"target": effective_length(a, self.params.get("default")), "a": a}

    def inverse(self, cols):
        return {"a": cols["a"]}


def effective_length(a: Column, default: object = None) -> Column:
    real = (lambda x: x.isNotNull()) if default is None else (lambda x: ~x.eqNullSafe(F.lit(default)))
    return F.coalesce(F.array_max(F.transform(a, lambda x, i: F.when(real(x), i + 1))), F.lit(0))


def frame_shape(df: DataFrame) -> DataFrame:
    """rows, columns of a DataFrame, lazily."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Row numbers from 0 in a declared order, without one task for all rows: counts of range partitions are summed up.

    The range partitions are written once and read twice (for their counts and for the rows): a range partitioning that a
    plan runs twice may sample other bounds the second time. Rows that agree in ``order`` are numbered in any order. An
    empty frame gives an empty one; columns of any other name than ``name`` are kept.
    """
    had = df.columns
    pid, inside, start = (_free(k, had) for k in ("__pid", "__in", "__start"))
    x = scratch.table(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()), "numbered")
    sizes = x.groupBy(pid).agg(F.count("*").alias(inside))
    before = F.coalesce(F.sum(inside).over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(pid, before.alias(start))  # a row for each partition
    x = x.withColumn(inside, F.row_number().over(Window.partitionBy(pid).orderBy(*order)) - 1)
    keep = [c for c in had if c != name]
    return x.join(F.broadcast(starts), pid).select(*(f"`{c}`" for c in keep), (F.col(start) + F.col(inside)).alias(name))


def _free(name: str, taken: list[str]) -> str:
    """A column name that isn't taken."""
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def partition_ranges(df: DataFrame, ranges: list[tuple[int, int]], idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(parts, rest): rows of each [start, end) with ``part``; ranges may overlap. rest: rows in none.

    A row's parts are an array expression over the listed ranges, so nothing is joined or shuffled.
    """
    hits = F.filter(F.array(*(F.when((F.col(idx) >= a) & (F.col(idx) < b), F.lit(k)) for k, (a, b) in enumerate(ranges))) if ranges else F.array().cast("array<int>"), lambda p: p.isNotNull())
    x = df.withColumn("__parts", hits)
    return x.withColumn("part", F.explode("__parts")).drop("__parts"), x.filter(F.size("__parts") == 0).drop("__parts")


def unpartition(parts: DataFrame, rest: DataFrame, idx: str = "idx") -> DataFrame:
    """The rows again, one for each index."""
    cols = rest.columns
    first = parts.groupBy(idx).agg(F.min_by(F.struct(*cols), "part").alias("r")).select("r.*")
    return first.select(*cols).unionByName(rest)


def split_rows(df: DataFrame, indices: list[int], idx: str = "idx") -> list[DataFrame]:
    """Rows cut at ``indices`` of their number."""
    at = [None, *indices, None]
    return [df.filter((F.lit(True) if a is None else F.col(idx) >= a) & (F.lit(True) if b is None else F.col(idx) < b)) for a, b in zip(at, at[1:])]


def concatenate_rows(frames: list[DataFrame], source: str = "src") -> DataFrame:
    """Frames one below the other with the number of their source."""
    return fold(DataFrame.unionByName, (f.withColumn(source, F.lit(i)) for i, f in enumerate(frames)))


def separate_rows(df: DataFrame, n: int, source: str = "src") -> list[DataFrame]:
    return [df.filter(F.col(source) == i).drop(source) for i in range(n)]


def tile_rows(df: DataFrame, reps: int, rep: str = "rep") -> DataFrame:
    """Every row ``reps`` times."""
    return df.withColumn(rep, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def transpose_frame(df: DataFrame, key: str, columns: list[str], keys: list) -> DataFrame:
    """Columns as rows (``name``) and the listed keys as columns."""
    long = df.unpivot([key], columns, "name", "value")
    return long.groupBy("name").pivot(key, keys).agg(F.first("value"))
