"""Greedy first-fit packing in order: rows are appended to a pack until the next one doesn't fit or the group is full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnback.functions.scalars import let

from .arrays import effective_length

ROW_MAP = "pack int, slot int, row bigint, start int, end int"


def plan_column(lengths: Column, width: int, max_group: int) -> Column:
    """The row map of one slice as an array, from an array of (row, len) in order of row."""
    zero = F.struct(F.lit(0).alias("pack"), F.lit(0).alias("used"), F.lit(0).alias("n"), F.array().cast("array<struct<pack:int,slot:int,row:bigint,start:int,end:int>>").alias("out"))

    def add(s: Column, r: Column) -> Column:
        new = (s["used"] + r["len"] > width) | (s["n"] == max_group)
        pack = F.when(new, s["pack"] + 1).otherwise(s["pack"])
        used = F.when(new, F.lit(0)).otherwise(s["used"])
        n = F.when(new, F.lit(0)).otherwise(s["n"])
        item = F.struct(pack.alias("pack"), n.alias("slot"), r["row"].cast("bigint").alias("row"), used.cast("int").alias("start"), (used + r["len"]).cast("int").alias("end"))
        return F.struct(pack.cast("int").alias("pack"), (used + r["len"]).cast("int").alias("used"), (n + 1).cast("int").alias("n"), F.concat(s["out"], F.array(item)).alias("out"))

    return F.aggregate(lengths, zero, add, lambda s: s["out"])


def plan(df: DataFrame, slice_col: str, row: str, length: str, width: int, max_group: int) -> DataFrame:
    """(slice, pack, slot, row, start, end): where each row goes. The fold depends on order within a slice only; a slice's
    rows stream through one task in order as two integers each, sorted by the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, pack, used, n = None, 0, 0, 0
        for b in batches:
            out = np.zeros((len(b), 4), np.int64)
            for i, (s, m) in enumerate(zip(b["s"].tolist(), b["m"].tolist())):
                if s != cur:
                    cur, pack, used, n = s, 0, 0, 0
                elif used + m > width or n == max_group:
                    pack, used, n = pack + 1, 0, 0
                out[i] = pack, n, used, used + m
                used, n = used + m, n + 1
            yield pd.DataFrame({"s": b["s"], "pack": out[:, 0], "slot": out[:, 1], "row": b["r"], "start": out[:, 2], "end": out[:, 3]})

    checked = F.when(F.col(length) > width, F.raise_error(F.lit("a row is longer than the width"))).otherwise(F.col(length))
    x = df.select(F.col(slice_col).alias("s"), F.col(row).cast("bigint").alias("r"), checked.cast("int").alias("m"))
    kind = x.schema["s"].dataType.simpleString()
    x = x.repartition("s").sortWithinPartitions("s", "r").mapInPandas(run, f"s {kind}, pack int, slot int, row bigint, start int, end int")
    return x.withColumnRenamed("s", slice_col)


def pack(df: DataFrame, slice_col: str, row: str, values: str, width: int, max_group: int, default: object, length: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(packs, row map): packs has (slice, pack, target, ends), arrays of ``width``; ends marks each row's last place."""
    n = F.col(length) if length else effective_length(F.col(values), default)
    x = df.select(slice_col, row, values).withColumn("__n", n)
    where = plan(x, slice_col, row, "__n", width, max_group)
    rows = where.join(x.withColumnRenamed(row, "row"), [slice_col, "row"])
    item = F.struct("start", "end", F.slice(F.col(values), F.lit(1), F.col("__n")).alias("v"))
    g = rows.groupBy(slice_col, "pack").agg(F.array_sort(F.collect_list(item)).alias("rs"))  # at most max_group rows
    flat = F.flatten(F.transform("rs", lambda r: r["v"]))
    target = F.slice(F.concat(flat, F.array_repeat(F.lit(default), width)), 1, width)
    last = F.transform(F.filter("rs", lambda r: r["end"] > r["start"]), lambda r: r["end"])
    ends = let(last, lambda e: F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.array_contains(e, i)))
    return g.select(slice_col, "pack", target.alias("target"), ends.alias("ends")), where


def unpack(packs: DataFrame, row_map: DataFrame, slice_col: str, width: int, default: object, row: str = "row", values: str = "values") -> DataFrame:
    """The rows again, padded to ``width``."""
    x = row_map.join(packs, [slice_col, "pack"])
    v = F.slice(F.col("target"), F.col("start") + 1, F.col("end") - F.col("start"))
    return x.select(slice_col, F.col("row").alias(row), F.slice(F.concat(v, F.array_repeat(F.lit(default), width)), 1, width).alias(values))


def pack_with_row_map(companion: DataFrame, row_map: DataFrame, slice_col: str, row: str, value: str, max_group: int, default: object) -> DataFrame:
    """(slice, pack, target): one companion value for each slot of a pack, ``default`` where there is none."""
    c = companion.select(F.col(slice_col), F.col(row).cast("bigint").alias("row"), F.col(value).alias("__v"))
    x = row_map.join(c, [slice_col, "row"], "left")
    g = x.groupBy(slice_col, "pack").agg(F.array_sort(F.collect_list(F.struct("slot", F.coalesce("__v", F.lit(default)).alias("v")))).alias("vs"))
    vals = F.transform("vs", lambda s: s["v"])
    return g.select(slice_col, "pack", F.slice(F.concat(vals, F.array_repeat(F.lit(default), max_group)), 1, max_group).alias("target"))


def unpack_with_row_map(packed: DataFrame, row_map: DataFrame, slice_col: str, row: str = "row", value: str = "value") -> DataFrame:
    x = row_map.join(packed, [slice_col, "pack"])
    return x.select(slice_col, F.col("row").alias(row), F.get("target", F.col("slot")).alias(value))
