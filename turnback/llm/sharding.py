"""Sharding by extendible hashing: a directory indexed by hash-prefix bits in which only oversized buckets split.

The bits are those of md5 of the document's id. The bytes of all prefixes up to a depth are summed in one grouped
pass; a document's shard is the shortest of its prefixes whose bytes fit the limit. Prefixes that don't fit even at
that depth go on for more bits alone. All of it is grouped sums and joins; the driver never holds the directory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import work

BITS = 60
SHARD_BYTES = 4 << 20


def key_of(ids: Column) -> Column:
    """The first 60 bits of md5 of an id (null: of the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def bytes_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def directory(slim: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """cell, cell_depth, depth, shard_bytes: for each prefix ``cell`` of ``cell_depth`` bits, its shard's depth and bytes."""
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    done, lo = None, 0
    hi = min(BITS, max(1, math.ceil(math.log2(max(2.0, total / shard_bytes))) + 3))
    left = slim
    while True:
        cells = left.groupBy(F.shiftright("key", BITS - hi).alias("cell")).agg(F.sum("n_bytes").alias("b"))
        cells = work.table(cells, "cells")
        up = cells.withColumn("d", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("prefix", F.expr(f"shiftright(cell, {hi} - d)"))
        fits = up.groupBy("d", "prefix").agg(F.sum("b").alias("bytes")).filter((F.col("bytes") <= shard_bytes) | (F.col("d") == BITS))
        at = up.join(fits, ["d", "prefix"]).groupBy("cell").agg(F.min(F.struct("d", "bytes")).alias("m"))
        found = at.select("cell", F.lit(hi).alias("cell_depth"), F.col("m.d").alias("depth"), F.col("m.bytes").alias("shard_bytes"))
        found = work.table(found, "directory")
        done = found if done is None else done.unionByName(found)
        over = cells.join(found, "cell", "left_anti")
        if hi == BITS or over.isEmpty():
            return done
        left = left.join(over.select(F.col("cell").alias("o")), F.shiftright("key", BITS - hi) == F.col("o"), "left_semi")
        lo, hi = hi + 1, min(BITS, hi + 8)


def assign(x: DataFrame, key: str, n_bytes: str, row: str, shard_bytes: int, names: list[str]) -> DataFrame:
    """A written table ``x`` with four more columns ``names``: shard, depth, the shard's bytes, page.

    ``key`` and ``n_bytes`` as in :func:`key_of` and :func:`bytes_of`; ``row`` is a number of its own for each row.
    """
    shard_, depth, total, page = names
    cell, other, at = work.free([*x.columns, *names], "cell", "other", "at")
    where = directory(x.select(F.col(key).alias("key"), F.col(n_bytes).alias("n_bytes")), shard_bytes)
    where = where.select(F.col("cell").alias(other), "cell_depth", F.col("depth").cast("int").alias(depth), F.col("shard_bytes").alias(total))
    depths = [r[0] for r in where.select("cell_depth").distinct().collect()]  # a few levels of the directory
    parts = [x.withColumn(cell, F.shiftright(key, BITS - d)).join(where.filter(F.col("cell_depth") == d).drop("cell_depth"), F.col(cell) == F.col(other)) for d in depths or [1]]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    bits = F.expr(f"substring(lpad(conv(cast(`{key}` as string), 10, 2), {BITS}, '0'), 1, `{depth}`)")
    got = got.withColumn(shard_, bits).select(*x.columns, shard_, depth, total)
    over = (F.col(depth) == BITS) & (F.col(total) > shard_bytes)
    if where.filter(over).isEmpty():
        return got.withColumn(page, F.lit(0).cast("long"))
    # a page opens every half limit, and a document over the half has one of its own: running sums by range partitions
    half = shard_bytes / 2
    small = F.when(F.col(n_bytes) <= half, F.col(n_bytes)).otherwise(F.lit(0))
    wide = (F.col(n_bytes) > half).cast("long")
    rows = got.filter(over).select(F.col(key).alias("k"), F.col(row).alias("r"), small.alias("s"), wide.alias("w"), F.floor(F.col(total) / half).alias("f"))
    rows = work.table(rows.repartitionByRange("k", "r").withColumn("pid", F.spark_partition_id()), "overflow")
    up = Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("k", "pid").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))  # a partition holds few keys, a key few partitions
    starts = starts.select("k", "pid", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("s0"), F.coalesce(F.sum("w").over(up), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("k", "pid").orderBy("r")
    rows = rows.withColumns({"before": F.sum("s").over(inside) - F.col("s"), "nth": F.sum("w").over(inside)}).join(starts, ["k", "pid"])
    pages = rows.select(F.col("r").alias(at), F.when(F.col("w") == 0, F.floor((F.col("s0") + F.col("before")) / half)).otherwise(F.col("f") + F.col("w0") + F.col("nth")).cast("long").alias(page))
    return got.join(pages, F.col(row) == F.col(at), "left").withColumn(page, F.coalesce(page, F.lit(0))).drop(at)


def shard(docs: DataFrame, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (its prefix as text of 0 and 1), depth, shard_bytes (the shard's), page; a row per document.

    A shard's bytes are at most the limit unless its documents agree in all 60 bits (repeated ids, or one text that is
    itself over the limit): such a bucket keeps depth 60 and is cut into overflow pages of at most the limit, one
    document at least; elsewhere page is 0. Null and empty texts: 0 bytes; a null id hashes as the empty string; rows
    that repeat are rows of their own. Texts of any length are measured whole. An empty table gives an empty result.
    Extra columns are ignored.
    """
    slim = docs.select(docs[id_col].alias("doc_id"), bytes_of(docs[text_col]).alias("n_bytes"), key_of(docs[id_col]).alias("key"), F.monotonically_increasing_id().alias("row"))
    return assign(work.table(slim, "keys"), "key", "n_bytes", "row", shard_bytes, ["shard", "depth", "shard_bytes", "page"]).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "page")


def write_shards(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, folders: tuple[str, str] = ("in_shard", "in_page"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` with all its columns below ``path``, a folder for each shard and page, and return the written rows.

    Every row is written once, whatever its id: rows carry their shard with them and are never joined by id. Null and
    repeated ids, null, empty and long texts as in :func:`shard`. ``folders`` name the folder columns; a name that
    ``docs`` has already gets an underscore. An empty table writes no folder and returns no row.
    """
    folders = work.free(docs.columns, *folders)
    key, n_bytes, row, depth, total = work.free([*docs.columns, *folders], "key", "n_bytes", "row", "depth", "shard_bytes")
    x = work.table(docs.withColumns({key: key_of(docs[id_col]), n_bytes: bytes_of(docs[text_col]), row: F.monotonically_increasing_id()}), "rows")
    x = assign(x, key, n_bytes, row, shard_bytes, [folders[0], depth, total, folders[1]]).drop(key, n_bytes, row, depth, total)
    x.repartition(*folders).write.partitionBy(*folders).parquet(path)
    schema = T.StructType([*docs.schema.fields, T.StructField(folders[0], T.StringType()), T.StructField(folders[1], T.LongType())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_7 = f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
l AS (SELECT unnest(range(0, {BITS + 1}))::INTEGER AS depth),
s AS (SELECT l.depth, d.key >> ({BITS} - l.depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM d, l GROUP BY ALL HAVING sum(n_bytes) <= {SHARD_BYTES}),
f AS (SELECT d.doc_id, d.n_bytes, d.key, min(s.depth) AS depth FROM d JOIN l ON true JOIN s ON s.depth = l.depth AND s.prefix = d.key >> ({BITS} - l.depth) GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, substr(lpad(bin(f.key), {BITS}, '0'), 1, f.depth) AS shard, f.depth, s.shard_bytes, 0::BIGINT AS page
FROM f JOIN s ON s.depth = f.depth AND s.prefix = f.key >> ({BITS} - f.depth)
"""
