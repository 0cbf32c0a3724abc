"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: a graph of at most so many edges is labelled in one task (16 bytes an edge)
ONE_TASK = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges and the least node of each one's component."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        n, r = union_find(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(r)], names=["node", "root"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest with the components of a partition's edges: every node with the least of its component there."""
    for out in _label(batches):
        n, r = out.column(0).to_numpy(), out.column(1).to_numpy()
        k = n != r
        yield pa.RecordBatch.from_arrays([pa.array(n[k]), pa.array(r[k])], names=["a", "b"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the least node of its component.

    Small graphs (a checked number of edges) are labelled in one task. Larger ones alternate two steps that never
    gather a node's neighbours: each partition contracts its own edges to a forest, and every node hangs its edges on
    the least neighbour it has; both keep the components, and the edges become stars.
    """
    e = work.table(edges.select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    while e.count() > one_task:
        least = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))
        small = e.select(F.greatest("a", "b").alias("u2"), F.least("a", "b").alias("v2")).join(least, F.col("u2") == F.col("u")).select(F.col("v2").alias("a"), F.col("m").alias("b"))
        keep = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        new = hung.unionByName(small).unionByName(keep).filter("a != b").distinct().mapInArrow(_contract, "a long, b long").distinct()
        new = work.table(new, "edges")
        done = new.count() == e.count() and new.exceptAll(e).isEmpty()
        work.drop(e)
        e = new
        if done:  # only stars are left
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return work.table(e.repartition(1).mapInArrow(_label, "node long, root long"), "components")
