"""Related-document packing.

1. Every text is sketched (min-hashes of its content-sampled 16-byte shingles) and tokenised once, into a table.
2. Nearest-neighbour graph over the whole corpus. Documents are related if they agree in a place of the sketch. Each
   place's min-hash is a list, and all documents of a list are compared with each other, in a list of any length: those
   beyond ``reach`` (a passage that many share) are cut into blocks, and every two blocks are a task's work of their own.
   The ``most`` likest neighbours of each document are kept, which is what the graph is (k nearest neighbours, exact).
3. Every document is joined with its likest neighbour, then every such cluster with its likest other cluster. Documents
   in the order of clusters are cut into shards of about ``shard_bytes``, so a document and its nearest neighbour share
   a shard but where a cut falls between them.
4. In a shard, the walk starts at the unvisited document of lowest degree and goes on to its likest unvisited neighbour,
   cluster by cluster. Windows are filled along the paths without a gap. Every row gets its place by a join.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buf, work
from .components import components

WIDTH = 1024
END_ID = 0
PLACES = 16
MOST = 8
REACH = 2048
#: lists of at most so many documents are compared many at a time
SMALL = 64
#: one document in so many is counted to find the long lists
COUNTED = 16
#: so many pairs are compared at a time
CELLS = 1 << 17
SHARD_BYTES = 24 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_NONE = np.uint16(0xFFFF)


def sketch(col: pa.Array) -> np.ndarray:
    """Rows of ``PLACES`` min-hashes (all ones where nothing was sampled). One in 16 shingles is sampled by its hash."""
    text, off = buf.flat(col)
    docs = len(off) - 1
    out = np.full(docs * PLACES, _TOP)
    n = len(text) - 15
    if n > 0:
        text = np.ascontiguousarray(text)
        with np.errstate(over="ignore"):
            w = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
            h = (w[:n] * _A) ^ ((w[8:] * _B) >> np.uint64(7))
            h *= _C
        i = np.flatnonzero(h >> np.uint64(60) == 0)
        doc = np.searchsorted(off, i, "right") - 1
        ok = i + 16 <= off[doc + 1]
        i, doc = i[ok], doc[ok]
        m = buf.mix(h[i])
        np.minimum.at(out, doc * PLACES + (m & np.uint64(PLACES - 1)).astype(np.int64), m >> np.uint64(4))
    return out.reshape(docs, PLACES)


def short(sk: np.ndarray) -> np.ndarray:
    """Sketches as 16-bit hashes for comparison (``_NONE`` where nothing was sampled)."""
    h = buf.mix(sk).astype(np.uint16)
    return np.where(sk == _TOP, _NONE, np.where(h == _NONE, np.uint16(0), h))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, the same from both sides: it breaks ties between equally like neighbours."""
    return buf.mix(np.minimum(a, b).view(np.uint64) * _A ^ buf.mix(np.maximum(a, b).view(np.uint64)))


def likest(a: np.ndarray, b: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
    """The rows with each a's ``most`` likest b, each b once, sorted by a and falling likeness, then by the pair's hash."""
    with np.errstate(over="ignore"):
        h = pair_hash(a, b)
    o = np.lexsort([b, h, -like, a])
    new = np.ones(len(o), bool)
    new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
    o = o[new]
    x = a[o]
    return o[np.arange(len(x)) - np.searchsorted(x, x) < most]


def related(key: np.ndarray, node: np.ndarray, sk: np.ndarray, most: int, slice_rows: int = 1 << 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, like) of short lists with rows in their order, each node once a list: the ``most`` likest of each node.

    Rows are taken ``slice_rows`` at a time and each slice keeps its likest, which bounds the memory.
    """
    n, kept = len(key), []
    for z in range(0, n, slice_rows):
        i, out, step = np.arange(z, min(n, z + slice_rows)), [], 1
        while True:
            i = i[i + step < n]
            i = i[key[i] == key[i + step]]
            if not len(i):
                break
            like = ((sk[i] == sk[i + step]) & (sk[i] != _NONE)).sum(axis=1)
            out += [(node[i], node[i + step], like), (node[i + step], node[i], like)]
            step += 1
        if out:
            a, b, like = (np.concatenate(x) for x in zip(*out))
            k = likest(a, b, like, most)
            kept.append((a[k], b[k], like[k]))
    if not kept:
        return tuple(np.zeros((3, 0), np.int64))
    return tuple(np.concatenate(x) for x in zip(*kept))


def block(node: np.ndarray, sk: np.ndarray, other: np.ndarray, osk: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, like): the ``most`` likest of ``other`` for each of ``node`` by every pair, in the order of :func:`likest`."""
    n, kept, none, onone = len(other), [], _absent(sk), _absent(osk)
    osk, some = np.ascontiguousarray(osk.T), none.any() and onone.any()
    least, last = other.view(np.uint64) * _A, buf.mix(other.view(np.uint64))
    rows = max(1, CELLS // n)
    for z in range(0, len(node), rows):
        a, s = node[z : z + rows, None], sk[z : z + rows]
        like = np.zeros((len(a), n), np.uint8)
        for p in range(PLACES):
            like += s[:, p, None] == osk[p]
        if some:
            like -= np.bitwise_count(none[z : z + rows, None] & onone)
        first = a < other
        u = a.view(np.uint64)
        h = buf.mix(np.where(first, u * _A, least) ^ np.where(first, last, buf.mix(u)))
        like[a == other] = 0
        w = like.astype(np.uint64) << np.uint64(58) | ~h >> np.uint64(6)
        i = np.argpartition(w, n - most, axis=1)[:, n - most :] if most < n else np.broadcast_to(np.arange(n), w.shape)
        like = np.take_along_axis(like, i, axis=1)
        k = like > 0
        kept.append((np.broadcast_to(a, i.shape)[k], other[i[k]], like[k].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*kept))


def _absent(sk: np.ndarray) -> np.ndarray:
    """The places of short sketches where nothing was sampled, a bit each."""
    return ((sk == _NONE) << np.arange(PLACES)).sum(axis=1).astype(np.uint16)


def walk(off: np.ndarray, near: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Documents in the order of greedy paths from ``starts``; near[off[i]:off[i + 1]] are i's neighbours, likest first."""
    mark = bytearray(len(starts))
    path = np.zeros(len(starts), np.int64)
    k = 0
    for s in starts.tolist():
        while s >= 0 and not mark[s]:
            mark[s] = 1
            path[k] = s
            k += 1
            s = next((t for t in near[off[s] : off[s + 1]].tolist() if not mark[t]), -1)
    return path


class Encoder:
    """Token ids of texts. The merges run in tiktoken on the tokenizer's own vocabulary, with the same ids at several
    times the speed; texts with a special token's string go through the tokenizer itself."""

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.slow = Tokenizer.from_file(path)
        self.kind = np.dtype(np.uint16 if self.slow.get_vocab_size() <= 1 << 16 else np.uint32)
        self.fast = None
        if path.endswith("byte_bpe_50k.json"):
            with open(path[: -len(".json")] + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or "<|" in text:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    n, w = len(x), x.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32)), pa.py_buffer(x)])


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _joined(col: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of packed numbers and each row's offset among them."""
    raw, off = buf.flat(col)
    return np.frombuffer(raw.tobytes(), dtype), off // np.dtype(dtype).itemsize


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, node, short sketch) of the documents that are in a list at each place."""
    for b in batches:
        sk = _joined(b.column("sketch"), np.uint64)[0].reshape(-1, PLACES)
        node, s = b.column("node").to_numpy(), short(sk)
        for p in range(PLACES):
            i = np.flatnonzero(sk[:, p] != _TOP)
            with np.errstate(over="ignore"):
                yield buf.mix(sk[i, p] + np.uint64(p + 1) * _A).view(np.int64), node[i], s[i]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, _, _ in _listed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's entries in the lists of its places."""
    for key, node, s in _listed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), _binary(s)], names=["key", "node", "short"])


def _relate(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _gather(batches)
        if t is None:
            return
        key, part, node = (t.column(k).to_numpy() for k in ("key", "part", "node"))
        sk = _joined(t.column("short"), np.uint16)[0].reshape(-1, PLACES)
        del t
        o = np.lexsort([node, part, key])
        o = o[np.r_[True, (key[o][1:] != key[o][:-1]) | (node[o][1:] != node[o][:-1])]]  # rows that repeat are one node
        k = key[o]
        same = k[1:] == k[:-1]
        o = o[np.r_[False, same] | np.r_[same, False]]
        key, part, node, sk = key[o], part[o], node[o], sk[o]
        at = np.append(np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)]), len(key))
        few = np.diff(at) <= SMALL
        i = np.flatnonzero(np.repeat(few, np.diff(at)))
        got = [related(key[i], node[i], sk[i], most)]
        for x, z in zip(at[:-1][~few].tolist(), at[1:][~few].tolist()):
            m = x + int(np.searchsorted(part[x:z], part[x], "right"))  # two parts of a long list, or one list
            got.append(block(node[x:m], sk[x:m], node[m:z] if m < z else node[x:m], sk[m:z] if m < z else sk[x:m], most))
            if m < z:
                got.append(block(node[m:z], sk[m:z], node[x:m], sk[x:m], most))
            if sum(len(g[0]) for g in got[1:]) > 1 << 20:
                got = [_likest(got, most)]
        a, b, like = _likest(got, most)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(like.astype(np.int32))], names=["node", "other", "like"])

    return run


def _likest(got: list[tuple], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, like = (np.concatenate(x) for x in zip(*got))
    k = likest(a, b, like, most)
    return a[k], b[k], like[k]


def _lists(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a node: its likest neighbours and how like they are."""
        t = _gather(batches)
        if t is None:
            return
        a, b, like = (t.column(k).to_numpy() for k in ("node", "other", "like"))
        k = likest(a, b, like, most)
        a, b, like = a[k], b[k], like[k]
        u = np.unique(a)
        off = np.searchsorted(a, np.append(u, u[-1:])).astype(np.int32)
        off[-1] = len(a)
        cols = [pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer(off * w), pa.py_buffer(np.ascontiguousarray(x))]) for w, x in ((8, b), (1, like.astype(np.uint8)))]
        yield pa.RecordBatch.from_arrays([pa.array(u), *cols, pa.array(b[off[:-1]])], names=["node", "near", "likes", "best"])

    return run


def neighbours(nodes: DataFrame, reach: int = REACH, most: int = MOST) -> DataFrame:
    """node, near, likes, best of every related document of (node long, sketch binary) over the whole table.

    near: the ``most`` likest of all other nodes (packed longs, likest first, ties by hash of the pair), likes: how many
    places each shares (bytes). Every two nodes of a list are compared. ``reach`` only says how the work is cut: lists of
    more nodes are compared in blocks of about so many, spread over tasks, and the result is the same whatever it is.
    Rows that repeat a node are one; documents without a sampled shingle have no neighbour.
    """
    nodes = nodes.select("node", "sketch")
    # a long list is found by its share of some nodes; a miss costs time, not pairs
    some = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0).dropDuplicates(["node"]).mapInArrow(_keys, "key long")
    long = some.groupBy("key").agg(F.ceil(F.count("*") * COUNTED / reach).cast("int").alias("parts")).filter("parts > 1")
    x = nodes.mapInArrow(_explode, "key long, node long, short binary").join(F.broadcast(long), "key", "left")
    x = x.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # every part meets every other and itself
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.withColumn("key", F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "with"), F.greatest("part", "with"))))
    met = x.select("key", "part", "node", "short").repartition("key").mapInArrow(_relate(most), "node long, other long, like int")
    return met.repartition("node").mapInArrow(_lists(most), "node long, near binary, likes binary, best long")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each list as pairs (a, b) with a weight: likeness, then the pair's hash."""
    for b in batches:
        other, off = _joined(b.column("near"), np.int64)
        like, _ = _joined(b.column("likes"), np.uint8)
        a = np.repeat(b.column("node").to_numpy(), np.diff(off))
        with np.errstate(over="ignore"):
            w = like.astype(np.int64) << 58 - 8 | (pair_hash(a, other) >> np.uint64(14)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(other), pa.array(w)], names=["a", "b", "w"])


def clusters(near: DataFrame, rounds: int = 2) -> DataFrame:
    """node, c0, c1, ...: clusters of a written table of :func:`neighbours`, the finest first.

    In each round every cluster (at first every node) is joined with the likest other one. The finest clusters hold
    every node's likest neighbour, and the later ones keep what is left of the graph together.
    """
    out = components(near.select(F.col("node").alias("a"), F.col("best").alias("b"))).withColumnRenamed("root", "c0")
    pairs = near.mapInArrow(_pairs, "a long, b long, w long")
    for r in range(1, rounds):
        top = out.select("node", F.col(f"c{r - 1}").alias("c"))
        x = pairs.join(top.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(top.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").filter("ca != cb")
        # a pair is seen from both sides, whichever list has it
        x = x.select(F.explode(F.array(F.struct(F.col("ca").alias("a"), F.col("cb").alias("b"), "w"), F.struct(F.col("cb").alias("a"), F.col("ca").alias("b"), "w"))).alias("e")).select("e.*")
        up = components(x.groupBy("a").agg(F.max_by("b", F.struct("w", "b")).alias("b")))
        out = work.table(out.join(up.select(F.col("node").alias(f"c{r - 1}"), F.col("root").alias(f"c{r}")), f"c{r - 1}", "left").withColumn(f"c{r}", F.coalesce(f"c{r}", f"c{r - 1}")), "clusters")
    return out


def pack(docs: DataFrame, width: int = WIDTH, tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, most: int = MOST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids, then ``end_id``, lie in pieces that follow each other gaplessly in sequences of at most
    ``width`` ids; a shard's last sequence is the only one that isn't full. Null and empty texts are one id, the end.
    Repeated rows are packed each; a text of any length is cut into as many pieces as it needs; a null id stays null.
    An empty table gives an empty result. Extra columns are ignored.
    """
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = Encoder(tokenizer), array(kind.char, [end_id])
        row = TaskContext.get().partitionId() << 40
        for b in buf.pieces(batches):
            ids, col = b.column("doc_id"), b.column("text")
            text, off = buf.flat(col)
            with np.errstate(over="ignore"):
                node = buf.mix(buf.span_hash(text, off[:-1], off[1:]) + ids.fill_null(0).to_numpy().astype(np.uint64) * _A + ids.is_null().to_numpy(zero_copy_only=False) * _B).view(np.int64)
            toks = [(array(kind.char, enc.ids(t)) + end).tobytes() for t in col.to_pylist()]
            n = np.array([len(t) // kind.itemsize for t in toks], np.int64)
            rows = np.arange(row, row + len(b))
            row += len(b)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(node), ids, pa.array(n), pa.array(np.diff(off) + 1), pa.array(toks, pa.binary()), _binary(sketch(col))], names=["row", "node", "doc_id", "n", "size", "ids", "sketch"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = _gather(batches)
        if t is None:
            return
        shard = TaskContext.get().partitionId()
        row, at, n, top = (t.column(k).to_numpy() for k in ("row", "node", "n", "top"))
        nodes, one, inv = np.unique(at, return_index=True, return_inverse=True)
        other, off = _joined(t.column("near"), np.int64)
        like, _ = _joined(t.column("likes"), np.uint8)
        del t
        of = buf.row_of(off)
        k = np.flatnonzero(one[inv[of]] == of)  # each node's list once
        a, b, like = nodes[inv[of[k]]], other[k], like[k].astype(np.int64)
        k = np.flatnonzero(nodes[np.minimum(np.searchsorted(nodes, b), len(nodes) - 1)] == b)  # the neighbours in this shard
        a, b, like = np.concatenate([a[k], b[k]]), np.concatenate([b[k], a[k]]), np.tile(like[k], 2)
        k = likest(a, b, like, len(a) + 1)
        a, b = np.searchsorted(nodes, a[k]), np.searchsorted(nodes, b[k])
        degree = np.bincount(a, minlength=len(nodes))
        path = walk(np.append(0, np.cumsum(degree)), b, np.lexsort([nodes, degree, top[one]]))
        rank = np.empty(len(nodes), np.int64)
        rank[path] = np.arange(len(nodes))
        o = np.lexsort([row, rank[inv]])  # rows that repeat follow each other
        start = np.cumsum(n[o]) - n[o]
        yield pa.RecordBatch.from_arrays([pa.array(row[o]), pa.array(np.full(len(o), shard, np.int64)), pa.array(start)], names=["row", "shard", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for d, raw, shard, at in zip(*(b.column(k).to_pylist() for k in ("doc_id", "ids", "shard", "at"))):
                t = np.frombuffer(raw, kind).astype("<u4")
                start = 0
                while start < len(t):
                    seq, used = divmod(at + start, width)
                    take = min(len(t) - start, width - used)
                    for k, v in enumerate((d, start, take, zlib.crc32(t[start : start + take].tobytes()), len(t), (shard << 32) + seq, used)):
                        out[k].append(v)
                    start += take
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = np.result_type(Encoder(tokenizer).kind, np.min_scalar_type(end_id))
    coded = work.table(slim.mapInArrow(encode, "row long, node long, doc_id long, n long, size long, ids binary, sketch binary"), "tokens")
    near = work.table(neighbours(coded, reach, most), "neighbours")
    total = coded.agg(F.sum("size")).first()[0] or 0
    x = coded.select("row", "node", "n", "size").join(near.join(clusters(near, 2), "node"), "node", "left")
    x = x.withColumn("c0", F.coalesce("c0", "node")).withColumn("top", F.coalesce("c1", "c0"))
    x = x.withColumns({"near": F.coalesce("near", F.lit(b"")), "likes": F.coalesce("likes", F.lit(b""))})
    # a cluster stays in one shard, unless it is larger than one: then it is cut between groups of likest neighbours
    large = x.groupBy("c0").agg(F.sum("size").alias("s")).filter(F.col("s") > shard_bytes).select("c0", F.lit(True).alias("large"))
    x = x.join(large, "c0", "left")
    x = x.withColumn("u", F.when(F.col("large"), F.least("node", "best")).otherwise(F.lit(0))).withColumn("v", F.when(F.col("large"), F.col("row")).otherwise(F.lit(0)))
    x = x.repartitionByRange(max(1, -(-total // shard_bytes)), "top", "c0", "u", "v").select("row", "node", "n", "top", "near", "likes")
    placed = work.table(x.mapInArrow(place, "row long, shard long, at long"), "places")
    work.drop(near)
    return coded.select("row", "doc_id", "ids").join(placed, "row").mapInArrow(cut, SCHEMA)


def op2_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
