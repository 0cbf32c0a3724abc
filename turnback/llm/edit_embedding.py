"""Document fingerprints by randomised edit embedding.

A random walk shared by all documents goes over a text's characters: at step j it emits the character it stands on and
moves on if a random bit of (j, character) says so. Two texts at a small edit distance fall into step again soon after
each edit, so the walks' outputs differ in few places: edit distance becomes Hamming distance. The fingerprint samples
256 places of the walk, each the place with the least random priority among all steps that the text's walk takes, and
keeps eight bits of a hash of the place and the character there. So it covers a text of any length, and texts of nearly
the same length sample nearly the same places.

All walks of a batch go on together, one numpy step for all documents. For near-duplicates, bands sample the bits of a
few places; fingerprints that share a band's bits are candidates, and whatever candidates connect is verified on
the whole fingerprints, every pair of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buf, work
from .components import components

PLACES = 256
#: fingerprints of a group that are compared in one piece of work; larger groups are cut into blocks of as many
BLOCK = 2048
_K1, _K2, _K3 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x9E3779B1)


def scatter(x: np.ndarray) -> np.ndarray:
    """A bijective 32-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint32(16))) * _K1
        x = (x ^ (x >> np.uint32(13))) * _K2
    return x ^ (x >> np.uint32(16))


class Walk:
    """The shared randomness: moves by (step, character) and the steps at which a place is sampled anew."""

    def __init__(self, seed: int = 4, places: int = PLACES):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.places = places
        self.seed = int(rng.integers(0, 2**63))
        self.salt = rng.integers(0, 2**32, places, dtype=np.uint32)
        self._rng = rng
        self._low = np.ones(places)
        self._next = np.zeros(places)
        self._known = 0
        self.at: dict[int, np.ndarray] = {}

    def until(self, steps: int) -> None:
        """Extend the sampling steps: place s is sampled at the record lows of its priorities over the steps."""
        while self._known < steps:
            self._known = max(1 << 12, 2 * self._known)
            found: dict[int, list[int]] = {}
            for s in range(self.places):
                while self._next[s] < self._known:
                    found.setdefault(int(self._next[s]), []).append(s)
                    self._low[s] *= self._rng.random() or 0.5
                    self._next[s] += 1 + np.floor(np.log(self._rng.random() or 0.5) / np.log1p(-self._low[s])) if self._low[s] < 1 else 1
            self.at.update({k: np.array(v) for k, v in found.items()})

    def embed(self, texts: list[str]) -> np.ndarray:
        """The fingerprints of texts as rows of bytes; an empty text has all zeros."""
        out = np.zeros((len(texts), self.places), np.uint8)
        lens = np.array([len(t) for t in texts], np.int64)
        if not lens.sum():
            return out
        code = scatter(np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32))
        ends = np.cumsum(lens + 1) - 1
        rows = np.flatnonzero(lens)
        pos, end = (ends - lens)[rows], ends[rows]
        j = 0
        with np.errstate(over="ignore"):
            while len(rows):
                self.until(j + 64)
                bits = buf.mix(np.arange(j, j + 64).astype(np.uint64) + np.uint64(self.seed)).astype(np.uint32)
                for r in bits:
                    ch = code[pos]
                    hit = self.at.get(j)
                    if hit is not None:
                        live = pos < end
                        out[rows[live][:, None], hit] = (scatter(ch[live][:, None] ^ self.salt[hit]) >> np.uint32(24)).astype(np.uint8)
                    pos = np.minimum(pos + ((ch ^ r) * _K3 >> np.uint32(31)), end)
                    j += 1
                live = pos < end
                if not live.all():
                    rows, pos, end = rows[live], pos[live], end[live]
        return out


def as_text(fp: np.ndarray) -> list[str]:
    """Rows of bytes in hexadecimal."""
    raw, w = fp.tobytes().hex(), 2 * fp.shape[1]
    return [raw[i : i + w] for i in range(0, len(raw), w)]


def from_text(col: pa.Array) -> np.ndarray:
    raw, off = buf.flat(col)
    return np.frombuffer(bytes.fromhex(raw.tobytes().decode()), np.uint8).reshape(len(off) - 1, -1) if len(raw) else np.zeros((len(off) - 1, PLACES), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal places."""
    return (a == b).mean(axis=1)


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by the beginning of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, str]]]:
    lot, size = [], 0
    for b in batches:
        for d, t, own in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "own"))):
            lot.append((d, t or "", own))
            size += len(lot[-1][1])
            if size >= most:
                yield lot
                lot, size = lot[-1:], 0
    if len(lot):
        yield lot


COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def next_rows(docs: DataFrame, id_col: str, text_col: str, parts: int) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, own, part) in ``parts`` stretches of descending id, each followed by the next one's first row.

    The stretches are cut at approximate quantiles of the ids; a stretch's first row goes to the one before it as well
    (own false), and the very first row to the last stretch.
    """
    x = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    probs = [i / parts for i in range(1, parts)]
    got = x.agg(F.percentile_approx("doc_id", F.lit(probs), F.lit(20 * parts)).alias("q"), F.max("doc_id").alias("m")).first() if probs else x.agg(F.lit(None).alias("q"), F.max("doc_id").alias("m")).first()
    top = got["m"]
    bounds = np.array(sorted({v for v in (got["q"] or []) if v != top}), np.int64)  # the first ids of stretches 1, 2, ... from the right
    last = len(bounds)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """A row's stretch, and after it the stretches whose next row it may be."""
        some = ids.notna().to_numpy()
        v = ids.fillna(0).to_numpy().astype(np.int64)
        at = np.where(some, last - np.searchsorted(bounds, v, "left"), last)
        head = some & np.isin(v, bounds)
        first = some & (v == top) if top is not None else ~some
        return pd.Series([[a, *([a - 1] if h else []), *([last] if f else [])] for a, h, f in zip(at.tolist(), head.tolist(), first.tolist())])

    x = x.withColumn("at", places("doc_id")).select("doc_id", "text", F.posexplode("at").alias("i", "part"))
    return x.select("doc_id", "text", (F.col("i") == 0).alias("own"), "part"), last + 1


def fingerprint_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 4, parts: int | None = None, lot_chars: int = 4 << 20) -> DataFrame:
    """For every document: its fingerprint, that of its edited text, and how like they and the next document's are.

    The next document is the one that follows in descending order of id (rows of one id in order of text, null ids
    last); after the last comes the first. Null texts count as empty; an empty text has the zero fingerprint, a
    likeness of 1 to another empty one. A single document is its own next. Texts of any length are walked whole. An
    empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, n = next_rows(docs, id_col, text_col, min(parts, 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(seed)
        for lot in _lots(batches, lot_chars):
            texts = [t for _, t, _ in lot]
            fp = walk.embed(texts)
            own = [i for i in range(len(lot) - 1) if lot[i][2]]
            if not own:
                continue
            changed = [edited(texts[i], texts[i + 1]) for i in own]
            ef = walk.embed(changed)
            a, b = fp[own], fp[[i + 1 for i in own]]
            yield pa.RecordBatch.from_arrays([
                pa.array([lot[i][0] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(as_text(a)), pa.array(as_text(ef)),
                pa.array(likeness(a, ef)), pa.array(likeness(a, b)),
            ], names=["doc_id", *COLUMNS])

    # in a stretch: own rows by id, then the row that follows them
    placed = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return placed.select("doc_id", "text", "own").mapInArrow(run, SCHEMA)


def like(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places of each fingerprint of ``a`` agree with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for p in range(a.shape[1]):
        out += a[:, p, None] == b[:, p]
    return out


def _band_keys(picks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = from_text(b.column("fp")), b.column("node").to_numpy()
            for i, at in enumerate(picks):
                key = np.full(len(fp), np.uint64(i + 1))
                with np.errstate(over="ignore"):
                    for p in at:
                        key = buf.mix(key * np.uint64(0x9E3779B97F4A7C15) + fp[:, p])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], names=["key", "node"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of units (root, i, j) with members (block, node, fp): how many each node is linked to here, and a spanning forest."""
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")]).combine_chunks()
        root, i, j, block, node = (t.column(k).to_numpy() for k in ("root", "i", "j", "block", "node"))
        fp = from_text(t.column("fp"))
        new = np.ones(len(root), bool)
        new[1:] = (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = np.append(np.flatnonzero(new), len(root))
        need = int(np.ceil(least * PLACES - 1e-9))
        near, up = np.zeros(len(node), np.int64), np.arange(len(node))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows = np.arange(a, z)
            left, right = (rows, rows) if i[a] == j[a] else (rows[block[a:z] == i[a]], rows[block[a:z] == j[a]])
            m = like(fp[left], fp[right]) >= need
            if i[a] == j[a]:
                np.fill_diagonal(m, False)
                near[left] += m.sum(axis=1)
            else:
                near[left] += m.sum(axis=1)
                near[right] += m.sum(axis=0)
            x, y = np.nonzero(m)
            x, y = left[x], right[y]
            while len(x):
                rx, ry = up[x], up[y]
                if (rx == ry).all():
                    break
                np.minimum.at(up, np.maximum(rx, ry), np.minimum(rx, ry))
                while not np.array_equal(nxt := up[up[a:z]], up[a:z]):
                    up[a:z] = nxt
        k = near > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(near[k]), pa.array(node[up[k]])], names=["node", "near", "other"])

    return run


def classes(prints: DataFrame, least: float = 0.8, bands: int = 32, width: int = 8, seed: int = 4, block: int = BLOCK) -> DataFrame:
    """node, class_id, links for every distinct fingerprint of a written table (doc_id, fp, node): node is a hash of fp.

    Each of ``bands`` bands samples the bits of ``width`` places. Fingerprints that share a band's bits are connected;
    every pair of what is connected is compared on all places and linked where at least ``least`` of them agree.
    links counts the other fingerprints linked to one, class_id is the least doc_id that links reach. A connected group
    beyond ``block`` fingerprints is cut into blocks, and each two blocks are a piece of work of their own, so a group of
    near copies without bound is never in one task. A pair at likeness 0.8 is missed by all bands 3 times in 1000, unless
    others connect it.
    """
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    picks = np.stack([np.sort(rng.choice(PLACES, width, replace=False)) for _ in range(bands)])
    nodes = work.table(prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("id")), "nodes")
    keyed = work.table(nodes.select("node", "fp").mapInArrow(_band_keys(picks), "key long, node long"), "bands")
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    edges = work.table(keyed.join(shared.select("key", "lo"), "key").filter("node != lo").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct(), "candidates")
    work.drop(keyed)
    comp = components(edges)
    sizes = comp.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    x = comp.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = x.withColumn("o", other).select("node", "root", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    x = x.join(nodes.select("node", "fp"), "node").select("root", "i", "j", "block", "node", "fp")
    found = work.table(x.repartition("root", "i", "j").mapInArrow(_verify(least), "node long, near long, other long"), "links")
    near = found.groupBy("node").agg(F.sum("near").alias("links"))
    tree = components(found.filter("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    x = nodes.select("node", "id").join(near, "node", "left").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = x.filter("links is not null").groupBy("root").agg(F.min("id").alias("class_id"))
    x = x.join(least_id, "root", "left").select("node", F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return x


def near_pairs(docs: DataFrame, least: float = 0.8, bands: int = 32, width: int = 8, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", lot_chars: int = 4 << 20, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, links: near-duplicate classes by bit-sampled banding and verification, as in :func:`classes`.

    One row for every document. links counts distinct fingerprints, so copies of a document add nothing to it; they
    share its class. Null and empty texts have the zero fingerprint and are one class. Repeated rows and ids give a
    row each; a null id names a class only where the class has no other. Texts of any length are walked whole. An empty table
    gives an empty result. Extra columns are ignored.
    """
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(seed)
        for b in batches:
            texts, a = [t or "" for t in b.column(1).to_pylist()], 0
            while a < len(texts):
                z, size = a, 0
                while z < len(texts) and size < lot_chars:
                    size += len(texts[z])
                    z += 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(as_text(walk.embed(texts[a:z])))], names=["doc_id", "fp"])
                a = z

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    fps = work.table(slim.mapInArrow(prints, "doc_id long, fp string").withColumn("node", F.xxhash64("fp")), "walks")
    return fps.select("doc_id", "node").join(classes(fps, least, bands, width, seed, block), "node").select("doc_id", "class_id", "links")


def op4_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints and likenesses, and each document's near-duplicate class and its links."""
    rows = fingerprint_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = work.table(rows.withColumn("node", F.xxhash64("fingerprint")), "walks")
    per = classes(rows.select("doc_id", F.col("fingerprint").alias("fp"), "node"))
    return rows.join(per, "node").drop("node")
