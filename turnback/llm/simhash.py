"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most six bits share at least two
of them: the guaranteed minimum of matches. The index is therefore keyed by pairs of byte positions (28 postings of
each distinct fingerprint), so that meeting in a posting list is having two matches already. Inside a list, pairs are
not multiplied out: pairs with three matches meet at a third byte, pairs with exactly two must differ in exactly one
bit of each other byte and so meet at complementary byte parities. The tally of shared bytes of a pair tells the one
place where it is counted, and its Hamming distance verifies it.

Equal fingerprints are one node with a count, whatever the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .components import components

COMBOS = list(combinations(range(8), 2))
#: for each set of matching bytes (as bits), its two lowest positions' combo and the third lowest position (8: none)
_FIRST = np.full(256, -1, np.int16)
_THIRD = np.full(256, 8, np.int16)
for _m in range(256):
    _at = [i for i in range(8) if _m >> i & 1]
    if len(_at) >= 2:
        _FIRST[_m] = COMBOS.index((_at[0], _at[1]))
        _THIRD[_m] = _at[2] if len(_at) > 2 else 8
#: a longer list is spread by its sub-lists; a longer sub-list by blocks of as many
SPLIT, BLOCK = 1 << 15, 2048
_PARITY = np.array([bin(i).count("1") & 1 for i in range(256)], np.uint8)


def fingerprint(text: bytes | None) -> bytes:
    """The eight bytes (most significant first) of a text's fingerprint."""
    w = (text or b"").lower().split()  # on bytes: A-Z alone, and 0x20 and 0x09-0x0D
    if not w:
        return bytes(8)
    shingles = map(b" ".join, zip(w, w[1:])) if len(w) > 1 else w
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    n = len(h)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        total += np.unpackbits(h[i : i + 65536], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tid (a hash of the text), fp (the fingerprint as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join([fingerprint(t) for t in b.column(2).to_pylist()])
            fp = np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "tid", "fp"])

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("tid"), docs[text_col].cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, tid long, fp long")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        x = fp.view(np.uint64)
        for c, (i, j) in enumerate(COMBOS):
            key = (c << 16) | (((x >> np.uint64(8 * i)) & np.uint64(255)) << np.uint64(8) | (x >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), b.column(0), b.column(1)], names=["key", "fp", "n"])


def sublists(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(third, rows, sub): the sub-lists in which the pairs of a list meet."""
    x = fp.view(np.uint64)
    octets = np.stack([((x >> np.uint64(8 * p)) & np.uint64(255)).astype(np.uint8) for p in range(8)], axis=1)
    lo, hi = np.array(COMBOS)[(key >> 16).astype(np.int64)].T
    parity = _PARITY[octets]
    rest = np.zeros(len(x), np.int64)  # the parities of the six other bytes
    for p in range(8):
        other = (p != lo) & (p != hi)
        rest = np.where(other, rest << 1 | parity[:, p], rest)
    yield 8, np.arange(len(x)), np.minimum(rest, 63 - rest)
    for p in range(2, 8):
        i = np.flatnonzero(hi < p)
        yield p, i, octets[i, p].astype(np.int64)


def matches(key: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all fingerprints within ``bits`` that this part of the index has to report (each pair once)."""
    x = fp.view(np.uint64)
    combo = (key >> 16).astype(np.int64)
    for third, rows, sub in sublists(key, fp):
        full = key[rows].astype(np.int64) << 8 | sub
        order = rows[np.argsort(full, kind="stable")]
        full = np.sort(full, kind="stable")
        a = np.arange(len(full) - 1)
        step = 1
        while True:  # neighbours at growing distance in their list
            a = a[a + step < len(full)]
            a = a[full[a] == full[a + step]]
            if not len(a):
                break
            i, j = order[a], order[a + step]
            near = np.bitwise_count(x[i] ^ x[j]) <= bits
            i, j = i[near], j[near]
            yield from _mine(x, i, j, combo[i], third)
            step += 1


def _tally(found: Iterator[tuple[np.ndarray, np.ndarray]], fp: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (fp, near, other) of linked pairs of rows: counts by fingerprint, and a forest of the components."""
    near = np.zeros(len(fp), np.int64)
    root = np.arange(len(fp))
    for i, j in found:
        np.add.at(near, i, n[j])
        np.add.at(near, j, n[i])
        while True:  # join the components that these pairs link
            ri, rj = root[i], root[j]
            if (ri == rj).all():
                break
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while not np.array_equal(up := root[root], root):
                root = up
    u, inv = np.unique(fp, return_inverse=True)
    total = np.bincount(inv, near, len(u)).astype(np.int64)
    k = total > 0
    yield pa.RecordBatch.from_arrays([pa.array(u[k]), pa.array(total[k]), pa.nulls(int(k.sum()), pa.int64())], names=["fp", "near", "other"])
    k = root != np.arange(len(root))
    e = np.unique(np.stack([fp[k], fp[root[k]]], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(np.zeros(len(e), np.int64)), pa.array(e[:, 1])], names=["fp", "near", "other"])


def _thirds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of long lists in their sub-lists: by a third byte, or (third 8) by the parities of the other six."""
    for b in batches:
        key, fp, n = (b.column(k).to_numpy() for k in ("key", "fp", "n"))
        for third, rows, sub in sublists(key, fp):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(np.full(len(rows), third, np.int32)), pa.array(sub.astype(np.int32)), pa.array(fp[rows]), pa.array(n[rows])], names=["key", "third", "sub", "fp", "n"])


def _unit_pairs(key: np.ndarray, third: np.ndarray, units: np.ndarray, left: np.ndarray, right: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each unit's left and right rows (the same rows: each pair once) that it has to report."""
    x = fp.view(np.uint64)
    for a, z in zip(units[:-1].tolist(), units[1:].tolist()):
        rows = np.arange(a, z)
        one, two = rows[left[a:z]], rows[right[a:z]]
        i, j = np.nonzero(np.bitwise_count(x[one][:, None] ^ x[two]) <= bits)
        i, j = one[i], two[j]
        k = i < j if np.array_equal(one, two) else i != j
        i, j = i[k], j[k]
        yield from _mine(x, i, j, (key[a] >> 16), third[a])


def _mine(x: np.ndarray, i: np.ndarray, j: np.ndarray, combo: np.ndarray | int, third: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of near pairs those that are counted at this combo and third byte: the first places that they share."""
    d = x[i] ^ x[j]
    m = np.zeros(len(d), np.int64)
    for p in range(8):
        m |= (((d >> np.uint64(8 * p)) & np.uint64(255)) == 0).astype(np.int64) << p
    mine = (_FIRST[m] == combo) & (_THIRD[m] == third)
    if mine.any():
        yield i[mine], j[mine]


def links(nodes: DataFrame, bits: int = 6, parts: int | None = None, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """Of distinct fingerprints (fp long, n long): rows (fp, near, other). near: counts of linked nodes, to be summed by
    fp; other: a node of the same component (a spanning forest by part of the index), or null.

    A list of more than ``split`` entries is spread by its sub-lists, and a sub-list of more than ``block`` by blocks, each
    two of which are compared apart: no list is in one task, whatever its length, and every pair is compared all the same.
    """
    if not 0 <= bits <= 6:
        raise ValueError("two shared bytes are guaranteed up to 6 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            key, fp, n = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(3))
            yield from _tally(matches(key, fp, bits), fp, n)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([(k, "ascending") for k in ("key", "third", "sub", "i", "j", "fp")])
        c = {k: t.column(k).to_numpy() for k in t.column_names}
        new = np.ones(len(t), bool)
        new[1:] = np.any([c[k][1:] != c[k][:-1] for k in ("key", "third", "sub", "i", "j")], axis=0)
        yield from _tally(_unit_pairs(c["key"], c["third"], np.append(np.flatnonzero(new), len(t)), c["block"] == c["i"], c["block"] == c["j"], c["fp"], bits), c["fp"], c["n"])

    out = "fp long, near long, other long"
    posted = nodes.select("fp", "n").mapInArrow(_postings, "key int, fp long, n long")
    long = work.table(posted.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > split).select("key"), "long")
    if long.isEmpty():
        return (posted.repartition(parts, "key") if parts else posted.repartition("key")).mapInArrow(run, out)
    rest = posted.join(long, "key", "left_anti").select("key", "fp", "n")
    heavy = posted.join(long, "key", "left_semi").select("key", "fp", "n").mapInArrow(_thirds, "key int, third int, sub int, fp long, n long")
    sizes = heavy.groupBy("key", "third", "sub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    x = heavy.join(sizes, ["key", "third", "sub"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("key", "third", "sub", "fp", "n", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    light = (rest.repartition(parts, "key") if parts else rest.repartition("key")).mapInArrow(run, out)
    return light.unionByName(x.repartition("key", "third", "sub", "i", "j").mapInArrow(units, out))


def near_duplicates(docs: DataFrame, bits: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tid, fingerprint, n_near, component_id of every row.

    n_near counts the other rows whose fingerprint differs in at most ``bits`` bits (equal ones too); component_id is
    the least doc_id that links reach. Null and empty texts have fingerprint zero and link like any other; repeated
    rows count each; texts of any length are read whole; a null id is a row of its own that never names a component
    unless all its ids are null. An empty table gives an empty result. Extra columns are ignored.
    """
    fps = work.table(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = work.table(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "nodes")
    found = work.table(links(nodes, bits), "links")
    near = found.groupBy("fp").agg(F.sum("near").alias("near"))
    comp = components(found.filter("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    comp = comp.select(F.col("node").alias("fp"), "root")
    x = nodes.join(near, "fp", "left").join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = x.groupBy("root").agg(F.min("least").alias("component_id"))
    per = x.join(ids, "root").select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "component_id")
    return fps.join(per, "fp").select("doc_id", "tid", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def survivors(docs: DataFrame, bits: int = 6) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one row of each component: that of the least id and, among
    rows of one id, the least text hash; rows that repeat both are one.

    A component of null ids alone keeps one row, too. Null and empty texts have fingerprint zero and are one
    component with whatever is near it; texts of any length are read whole; an empty table stays empty; columns may have any names.
    """
    cols = docs.columns
    h, d, t, n = work.free(cols, "h", "d", "t", "n")
    near = near_duplicates(docs, bits)
    known = near.groupBy("component_id", F.when(near["component_id"].isNull(), near["fingerprint"]).alias("alone"), "doc_id", "tid").agg(F.count("*").alias("n"))
    best = known.groupBy("component_id", "alone").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid", "n")).alias("m"))
    best = work.table(best.select(F.col("m.doc_id").alias(d), F.col("m.tid").alias(t), F.col("m.n").alias(n)), "survivors")
    x = docs.withColumn(h, F.xxhash64("text"))
    x = x.join(best, x["doc_id"].eqNullSafe(best[d]) & (x[h] == best[t]))
    if best.filter(F.col(n) > 1).isEmpty():
        return x.select(*(f"`{c}`" for c in cols))
    again = x.filter(F.col(n) > 1).dropDuplicates(["doc_id", h])
    return x.filter(F.col(n) == 1).unionByName(again).select(*(f"`{c}`" for c in cols))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tid")
