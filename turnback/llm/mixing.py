"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same number of expected copies, r = target / source size. Documents are put
in order of size, their expected copies summed up, one random offset added, and a document is emitted once for each
integer that its stretch of the sum crosses. As neighbours in that order have nearly the same size, the words taken
differ from the target by less than the largest document, and no document is taken more than ceil(r) <= 3 times.

A document's place in the order comes from a range partitioning of (source, size, md5 of id, id) and the counts
of the partitions before it, so that a source with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3


def row_hash(docs: DataFrame) -> Column:
    """Equal for rows that agree in every column."""
    return F.xxhash64(*(docs[c] for c in docs.columns))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size in words (null text: 0), h (a hash of the whole row)."""
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size.alias("size"), row_hash(docs).alias("h"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with a row per source.

    The sources share the total by weight. A target stops at ``most`` times its source's size; what is over is shared
    again among the others by weight until none is above. In order of most * size / weight, a source is capped
    exactly if its cap is below its part of what the sources before it leave.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    x = x.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio")
    before = F.coalesce(F.sum("cap").over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0)) - F.sum("cap").over(Window.partitionBy("ratio"))
    x = x.withColumn("part", (F.sum("source_size").over(Window.partitionBy()).cast("double") - before) / F.sum("weight").over(up.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    x = x.withColumn("capped", F.col("ratio") <= F.col("part"))
    # the water level is the part of the first source that isn't capped, which is the largest among those
    level = F.max(F.when(~F.col("capped"), F.col("part"))).over(Window.partitionBy())
    return x.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def ranked(slim: DataFrame) -> DataFrame:
    """``slim`` with ``k``: the number of rows of the same source before this one by (size, md5 of id, id)."""
    spark = slim.sparkSession
    keys = [F.col("source").asc_nulls_last(), "size", "tie", "doc_id"]
    x = slim.withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    x = work.table(x.repartitionByRange(*keys).withColumn("pid", F.spark_partition_id()), "mix")
    counts = x.groupBy("source", "pid").agg(F.count("*").alias("n"))  # a partition holds few sources, a source few partitions
    start = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("source").alias("s"), F.col("pid").alias("p"), start.alias("start"))
    inside = F.row_number().over(Window.partitionBy("source", "pid").orderBy("size", "tie", "doc_id"))
    x = x.withColumn("i", inside)
    return x.join(starts, x["source"].eqNullSafe(starts["s"]) & (x["pid"] == starts["p"])).select("doc_id", "source", "size", "h", (F.col("start") + F.col("i") - 1).alias("k"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, h, source_size, target, copies of every document.

    Null texts and ids, empty texts: size 0 for a text without words; such rows get copies as any other of their
    source (and take no words); a null source is a source of its own, last in order. A source without any words has
    target 0 and no copies. Repeated rows are rows of their own. Extra columns are ignored. The offset of a source
    comes from md5 of seed and source, so reruns agree.
    """
    slim = work.table(measured(docs, id_col, text_col, source_col), "sizes")
    per = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    goal = targets(per, weights, most)
    hex5 = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("\x00"))).cast("binary")), 1, 5)
    goal = goal.select(
        F.col("source").alias("s"), "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.conv(hex5, 16, 10).cast("double") / F.lit(1048576.0)).alias("u"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("r"),
    )
    x = ranked(slim).join(goal, F.col("source").eqNullSafe(F.col("s")))
    copies = F.floor(F.col("u") + F.col("r") * (F.col("k") + 1)) - F.floor(F.col("u") + F.col("r") * F.col("k"))
    return x.select("doc_id", "source", "size", "h", "source_size", "target", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 6) -> DataFrame:
    """The mixed corpus: each row of ``docs`` (columns doc_id, text, source and any others) once per copy.

    Documents meet their copies by id, source and a hash of all columns. Rows that agree in all of them are
    interchangeable: one of them stands for the copies of all, so a row that repeats without bound is a count and never
    a list. Null ids, texts and sources, empty texts, ties and long texts as in :func:`mix`; an empty table gives an
    empty result; columns may have any names.
    """
    cols = docs.columns
    d, s, h, k, total, n, e = work.free(cols, "d", "s", "h", "k", "total", "n", "e")
    one = mix(docs, weights, most, seed).groupBy(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("h").alias(h))
    one = one.agg(F.sum("copies").alias(total), F.count("*").alias(n)).filter(F.col(total) > 0)
    x = docs.withColumn(k, row_hash(docs))
    x = x.join(one, x["doc_id"].eqNullSafe(one[d]) & x["source"].eqNullSafe(one[s]) & (x[k] == one[h]))
    x = x.filter(F.col(n) == 1).unionByName(x.filter(F.col(n) > 1).dropDuplicates([d, s, h]))
    step = 1000  # copies are spread in two steps, so that no list grows with their number
    x = x.withColumn(e, F.explode(F.sequence(F.lit(0), F.floor((F.col(total) - 1) / step))))
    return x.withColumn(e, F.explode(F.sequence(F.lit(1), F.least(F.lit(step), F.col(total) - F.col(e) * step)))).select(*(f"`{c}`" for c in cols))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return x.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap FROM p),
r AS (SELECT *, cap / weight AS ratio FROM w),
x AS (SELECT a.source, a.source_size, a.weight, a.cap, a.ratio,
        ((SELECT sum(source_size)::DOUBLE FROM p) - coalesce((SELECT sum(b.cap) FROM r b WHERE b.ratio < a.ratio), 0)) / (SELECT sum(b.weight) FROM r b WHERE b.ratio >= a.ratio) AS part FROM r a),
g AS (SELECT source, source_size, CASE WHEN ratio <= part THEN cap ELSE weight * (SELECT max(part) FROM x WHERE ratio > part) END AS target,
        ('0x' || substr(md5('6|' || coalesce(source, chr(0))), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM x),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM g),
k AS (SELECT d.*, h.source_size, h.target, h.u, h.r, row_number() OVER (PARTITION BY d.source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS k
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, ((floor(u + r * (k + 1)) - floor(u + r * k)) * size)::BIGINT AS taken FROM k
"""
