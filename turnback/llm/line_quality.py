"""Quality classifier: a linear-chain conditional random field over lines.

Every line gets features of its own and of its neighbours; the field labels lines good or bad jointly. Training data
are documents' labels, so a line starts with its document's label and, in a bad document, is relabelled by the model
(its worst line always stays bad). A document's quality is the mean of its lines' marginal probabilities of being
good, from the forward-backward algorithm, weighted by length, then calibrated on the training documents.

The forward-backward passes run over all blocks of ``BLOCK`` lines of a batch at once, one line index at a time, with the
2 x 2 transfer matrices of a block's lines; the blocks of a document then follow each other. So a document of n lines
costs about BLOCK + n / BLOCK steps. Everything is computed by line or by document: a score depends on its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buf, work
from .quality_rules import labelled_sample

_SYM, _UP, _LOW, _DIG, _PUN, _HI, _BANG = (np.zeros(256, bool) for _ in range(7))
_SYM[[ord(c) for c in "#*$%&|<>{}=~^_\\@"]] = True
_UP[65:91] = _LOW[97:123] = _DIG[48:58] = True
_PUN[[ord(c) for c in ".,;:'\"()-"]] = True
_HI[192:] = True
_BANG[[ord(c) for c in "!?"]] = True
N_OWN = 14
BLOCK = 64


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines with a word, their lengths, and each document's offset among the lines."""
    text, off = buf.flat(col)
    ls, le, _ = buf.spans(text != 10, off)
    _, ws, we, woff, h = buf.words(col, lower=True)
    a, z = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    has = z > a
    ls, le, a, z = ls[has], le[has], a[has], z[has]
    loff = np.searchsorted(ls, off)
    nw, nb = (z - a).astype(float), (le - ls).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        c = np.zeros(len(text) + 1, np.int64)
        np.cumsum(table[text], out=c[1:])
        return (c[le] - c[ls]).astype(float)

    def over(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1)
        np.cumsum(flags, out=c[1:])
        return c[z] - c[a]

    up, low, sym, bang = share(_UP), share(_LOW), share(_SYM), share(_BANG)
    ldoc = buf.row_of(loff)
    wline = np.repeat(np.arange(len(nw)), z - a)

    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (wline[1:] == wline[:-1])
    types = np.zeros(len(nw))
    if len(h):
        _, one = np.unique(buf.mix(h + wline.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        types = np.bincount(wline[one], minlength=len(nw)).astype(float)
    lh = buf.mix(buf.span_hash(text, ls, le) + ldoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    repeated = np.zeros(len(nw))
    if len(nw):
        _, inv, cnt = np.unique(lh, return_inverse=True, return_counts=True)
        repeated = (cnt[inv] > 1).astype(float)
    lastb = text[le - 1] if len(nw) else np.zeros(0, np.uint8)
    x = np.stack([
        np.log1p(nw) / 4, nb / np.maximum(nw, 1) / 8, np.minimum(sym / nw, 2), up / np.maximum(up + low, 1), np.minimum(share(_DIG) / nb * 4, 2), np.minimum(bang / nw, 2),
        types / nw, over(same) / nw, over(we - ws <= 3) / nw, share(_PUN) / nb * 8, share(_HI) / nb * 4, repeated, ((lastb == 46) | (lastb == 33) | (lastb == 63)).astype(float), (nw < 3).astype(float),
    ], axis=1) if len(nw) else np.zeros((0, N_OWN))
    return x, nb, loff


def with_neighbours(x: np.ndarray, loff: np.ndarray) -> np.ndarray:
    """[own, own squared, previous, next, is first, is last, 1] for every line; no neighbour: zeros."""
    n = len(x)
    prev, nxt, first, last = np.zeros_like(x), np.zeros_like(x), np.zeros((n, 1)), np.zeros((n, 1))
    has = loff[:-1] < loff[1:]
    first[loff[:-1][has]] = 1
    last[loff[1:][has] - 1] = 1
    prev[1:] = x[:-1]
    nxt[:-1] = x[1:]
    prev *= 1 - first
    nxt *= 1 - last
    return np.hstack([x, x * x, prev, nxt, first, last, np.ones((n, 1))])


class Blocks:
    """The lines of documents in blocks of at most ``BLOCK``, the longest blocks first."""

    def __init__(self, loff: np.ndarray):
        n = np.diff(loff)
        self.n = int(loff[-1])
        has = np.flatnonzero(n)
        count = -(-n[has] // BLOCK)
        self.docs = len(has)
        doc = np.repeat(np.arange(self.docs), count)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)  # in its document
        start = loff[:-1][has][doc] + rank * BLOCK
        size = np.minimum(BLOCK, loff[1:][has][doc] - start)
        self.of_line = np.repeat(np.arange(len(doc)), size)  # blocks lie in order of lines
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
        self.steps = [start[order[:k]] + t for t, k in enumerate(live)]  # the lines at index t of their block
        self.start, self.last, self.doc, self.rank = start, start + size - 1, doc, rank
        by = np.argsort(rank, kind="stable")
        self.rounds = np.split(by, np.searchsorted(rank[by], np.arange(1, int(rank.max(initial=0)) + 1))) if len(doc) else []
        self.follows = np.ones(self.n, bool)  # the line has one after it in its document
        self.follows[loff[1:][has] - 1] = False
        self.follows = np.flatnonzero(self.follows)


def forward_backward(u: np.ndarray, trans: np.ndarray, b: Blocks, pairs: bool = False):
    """Marginals of a two-label chain with scores ``u`` of label 1 and ``trans``, in scaled probabilities."""
    n = len(u)
    t = np.exp(trans)
    good = 1 / (1 + np.exp(-np.clip(u, -500, 500)))
    e = np.stack([1 - good, good], axis=1)
    e = np.maximum(e, 1e-300)

    def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x.sum(axis=tuple(range(1, x.ndim)))
        return x / z.reshape(-1, *[1] * (x.ndim - 1)), z

    # from the state before a block to that of each of its lines; before a document there is state 0 alone
    f, scale = np.zeros((n, 2, 2)), np.zeros(n)
    for k, i in enumerate(b.steps):
        if k:
            x = (f[i - 1][:, :, :, None] * t).sum(axis=2) * e[i][:, None, :]
        else:
            opens = np.zeros(n, bool)
            opens[b.start[b.rank == 0]] = True
            x = np.where(opens[i][:, None, None], 1.0, t) * e[i][:, None, :]
        f[i], z = unit(x)
        scale[i] = np.log(z) + (scale[i - 1] if k else 0)
    before, log_z = np.zeros((len(b.start), 2)), np.zeros(b.docs)
    state = np.tile([1.0, 0.0], (b.docs, 1))
    for r in b.rounds:
        before[r] = state[b.doc[r]]
        state[b.doc[r]], z = unit((before[r][:, :, None] * f[b.last[r]]).sum(axis=1))
        log_z[b.doc[r]] += np.log(z) + scale[b.last[r]]
    alpha, _ = unit((before[b.of_line][:, :, None] * f).sum(axis=1))
    # from the state of a line to that of its block's last line
    g = np.zeros((n, 2, 2))
    g[b.last] = np.eye(2)
    inner = np.ones(n, bool)
    inner[b.last] = False
    for i in b.steps[::-1]:
        i = i[inner[i]]
        g[i], _ = unit((t[None, :, :, None] * (e[i + 1][:, :, None] * g[i + 1])[:, None]).sum(axis=2))
    after = np.ones((len(b.start), 2))
    for r in b.rounds[:0:-1]:
        h = b.start[r]
        x = e[h] * (g[h] * after[r][:, None, :]).sum(axis=2)
        after[r - 1], _ = unit((t[None] * x[:, None, :]).sum(axis=2))  # a document's blocks are neighbours
    beta, _ = unit((g * after[b.of_line][:, None, :]).sum(axis=2))
    both = alpha * beta
    p = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return p
    i = b.follows
    q, _ = unit(alpha[i][:, :, None] * t * (e[i + 1] * beta[i + 1])[:, None, :])
    return p, q.sum(0), log_z.sum() + np.logaddexp(0, u).sum()


@dataclass
class Field:
    """weights of the good label, 2 x 2 transition scores, and the document's calibration (slope, shift)."""

    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    empty: float = 0.5
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def marginals(self, f: np.ndarray, loff: np.ndarray, pairs: bool = False):
        """P(good) of every line; with ``pairs`` the summed pair marginals (2 x 2) and the log partition sum too."""
        return forward_backward((f * self.weights).sum(axis=1), self.trans, Blocks(loff), pairs)

    def quality(self, x: np.ndarray, nb: np.ndarray, loff: np.ndarray, raw: bool = False) -> np.ndarray:
        """Every document's score; documents without a line get the training share of good ones among such."""
        p = self.marginals((with_neighbours(x, loff) - self.centre) / self.scale, loff)
        total = buf.row_sum(nb, loff)
        q = np.zeros(len(loff) - 1)
        has = np.flatnonzero(np.diff(loff))
        if len(has):  # summed document by document, so that the other rows don't matter
            q[has] = np.add.reduceat(p * nb, loff[has]) / np.maximum(total[has], 1e-9)
        if raw:
            return q
        q = np.clip(q, 1e-4, 1 - 1e-4)
        return np.where(total > 0, 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.shift))), self.empty)


def train(x: np.ndarray, nb: np.ndarray, loff: np.ndarray, y: np.ndarray, rounds: int = 3, steps: int = 120, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam on full batches; lines of bad documents are relabelled between rounds."""
    f = with_neighbours(x, loff)
    centre, scale = f.mean(0), f.std(0)
    centre[-1], scale[scale < 1e-9] = 0, 1
    f = (f - centre) / scale
    doc = buf.row_of(loff)
    good = y[doc].astype(bool)
    crf = Field(np.zeros(f.shape[1]), np.zeros((2, 2)), centre=centre, scale=scale)
    blocks = Blocks(loff)
    pair = blocks.follows
    m = v = np.zeros(f.shape[1] + 4)
    for r in range(rounds):
        if r:  # lines of bad documents that look good are good, but for the worst
            p = forward_backward(f @ crf.weights, crf.trans, blocks)
            worst = np.full(len(y), np.inf)
            np.minimum.at(worst, doc, p)
            good = y[doc].astype(bool) | ((p > 0.5) & (p > worst[doc]))
        emp = np.zeros((2, 2))
        np.add.at(emp, (good[pair].astype(int), good[pair + 1].astype(int)), 1)
        target = f.T @ good
        m = v = np.zeros(f.shape[1] + 4)
        for k in range(1, steps + 1):
            p, q, _ = forward_backward(f @ crf.weights, crf.trans, blocks, pairs=True)
            grad = np.concatenate([(target - f.T @ p) / len(f) - l2 * crf.weights, (emp - q).ravel() / len(f) - 10 * l2 * crf.trans.ravel()])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            crf.weights = crf.weights + step[:-4]
            crf.trans = crf.trans + step[-4:].reshape(2, 2)
    has = np.diff(loff) > 0
    q = np.clip(crf.quality(x, nb, loff, raw=True)[has], 1e-4, 1 - 1e-4)
    t, yy = np.log(q / (1 - q)), y[has]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one number
        p = 1 / (1 + np.exp(-(a * t + b)))
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * t * t).sum() + 1, (w * t).sum()], [(w * t).sum(), w.sum() + 1]])
        d = np.linalg.solve(hess, [((yy - p) * t).sum() - (a - 1), (yy - p).sum() - b])
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    crf.slope, crf.shift = max(a, 1e-3), b
    none = y[~has]
    crf.empty = float((none.sum() + 0.25) / (len(none) + 1))
    return crf


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, keep: F.Column | None = None, most_lines: int = 200_000) -> Field | None:
    """Train on at most ``most`` labelled documents, those with the least md5 of their id, and at most ``most_lines`` lines.

    Documents are taken in that order; one that would exceed the lines left is passed over. What comes to the driver is
    bounded by both. None without both labels. An id that repeats is one document: its greatest label, its least text.
    Null ids and null labels aren't trained on; null, empty and blank texts teach the score of texts without a line. An
    empty table of either kind gives None. Extra columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in buf.pieces(batches):
            x, nb, loff = line_features(b.column(0))
            rows = [np.column_stack([x[s:e], nb[s:e]]).ravel() for s, e in zip(loff[:-1], loff[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    kept = work.table(labelled_sample(docs, labels, most, F.lit(True) if keep is None else keep), "sample")
    sizes = kept.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n")).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").collect()  # at most ``most``
    left, out = most_lines, []
    for d, n in sizes:
        if n > left:
            out.append(d)
        else:
            left -= max(n, 0)
    rows = kept.filter(~F.col("doc_id").isin(out)) if out else kept
    got = rows.select("text", F.col("y").cast("int")).mapInArrow(run, "x array<double>, y int").toArrow()
    work.drop(kept)
    y = got.column(1).to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    each = [np.asarray(v, np.float64).reshape(-1, N_OWN + 1) for v in got.column(0).to_pylist()]
    order = sorted(range(len(y)), key=lambda i: (len(each[i]), y[i], each[i].tobytes()))
    every = np.vstack([each[i] for i in order])
    loff = np.concatenate([[0], np.cumsum([len(each[i]) for i in order])])
    return train(every[:, :-1], every[:, -1], loff, y[order])


def score(docs: DataFrame, crf: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted. Null, empty and blank texts get the share of good ones among such training texts (at
    least smoothed: below 1/2 without any); without a model every score is 1/2. Repeated rows give repeated results;
    texts of any length are read whole; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in buf.pieces(batches):
            if crf is None:
                s = np.full(b.num_rows, 0.5)
            else:
                s = crf.quality(*line_features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, crf: Field | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (a column text and any others) whose score reaches ``threshold``; all of them without a model.

    Null, empty and blank texts stay or go together, by the score of texts without a line; repeated rows likewise. Ids
    aren't read; all columns are kept as they are, whatever their names; an empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in buf.pieces(batches):
            yield b if crf is None else b.filter(pa.array(crf.quality(*line_features(b.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def training_rows() -> F.Column:
    """Rows that labels may be learnt from; a null id is none of the held-out ones."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1, F.lit(True))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crf = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=training_rows())
    return score(docs, crf).select("doc_id", (~training_rows()).alias("held_out"), "score", "predicted")
