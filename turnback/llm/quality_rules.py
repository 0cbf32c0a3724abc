"""Quality rules: gradient-boosted trees over document statistics, scored through flat numpy node arrays.

Statistics come from one vectorised Arrow pass. The trees are trained on a bounded sample of labelled rows (the
only sample here; its size is a parameter), with monotonic constraints: more symbols, repeated lines, repeated words
or capitals never raise a score. Scoring steps all documents of a batch down all trees level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buf

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: feature -> sign of its monotonic constraint (0: none)
FEATURES = {
    "log_words": 0, "word_len": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1, "digits": 0, "line_words": 0,
    "punct_end": 0, "types": 0, "stops": 0, "adjacent": -1, "non_ascii": 0, "bang": -1, "max_line": 0,
}
_CLASS = np.zeros((8, 256), bool)
_CLASS[0, [ord(c) for c in "#*$%&|<>"]] = True
_CLASS[1, 65:91] = True
_CLASS[2, 48:58] = True
_CLASS[3, [ord(c) for c in "!?"]] = True
_CLASS[4, 128:192] = True  # continuation bytes
_CLASS[5, 192:] = True
_CLASS[6, 97:123] = True


def statistics(col: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the feature matrix of a column of texts (null: empty)."""
    text, off = buf.flat(col)
    _, starts, ends, woff, h = buf.words(col)
    n, docs = np.diff(woff), len(off) - 1
    cs = lambda k: np.concatenate([[0], np.cumsum(_CLASS[k][text], dtype=np.int64)])
    cont = cs(4)
    chars = buf.row_sum(ends - starts - (cont[ends] - cont[starts]), woff)
    per = {k: (c := cs(k))[off[1:]] - c[off[:-1]] for k in (0, 1, 2, 3, 5, 6)}
    # lines
    lmask = text != 10
    ls, le, loff = buf.spans(lmask, off)
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ldoc = buf.row_of(loff)
    lh = buf.span_hash(text, ls, le)
    key = buf.mix(lh + ldoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    k = np.flatnonzero(has)
    _, first = np.unique(key[k], return_index=True)
    dup = np.ones(len(k), bool)
    dup[first] = False
    n_lines = np.bincount(ldoc[k], minlength=docs)
    n_dup = np.bincount(ldoc[k][dup], minlength=docs)
    last = text[np.maximum(le - 1, 0)] if len(text) else np.zeros(0, np.uint8)
    stop = np.isin(last, [46, 33, 63]) & has
    lw = (np.searchsorted(starts, le) - np.searchsorted(starts, ls)) * has
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, ldoc, lw)
    # words in 3-word windows that occur twice or more in their text
    wdoc = buf.row_of(woff)
    rep = np.zeros(len(h), bool)
    g = buf.rolling(h, 3)
    if len(g):
        inside = np.flatnonzero(wdoc[:-2] == wdoc[2:])
        gk = buf.mix(g[inside] + wdoc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(gk, kind="stable")
        s = gk[order]
        twice = np.zeros(len(s), bool)
        twice[1:] |= s[1:] == s[:-1]
        twice[:-1] |= s[1:] == s[:-1]
        at = inside[order[twice]]
        for d in range(3):
            rep[at + d] = True
    repeats = buf.row_sum(rep, woff)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    types = np.zeros(docs, np.int64)
    if len(h):
        _, one = np.unique(buf.mix(h + wdoc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        types = np.bincount(wdoc[one], minlength=docs)
    short = buf.row_sum((ends - starts) <= 3, woff)
    base = {"n_words": n, "word_chars": chars, "n_symbols": per[0], "n_dup_lines": n_dup, "n_repeat_words": repeats}
    w, c, lines = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    x = np.stack([
        np.log1p(n), chars / w, per[0] / w, n_dup / lines, repeats / w, per[1] / np.maximum(per[1] + per[6], 1), per[2] / c, np.log1p(n / lines),
        np.bincount(ldoc[stop], minlength=docs) / lines, types / w, short / w, buf.row_sum(same, woff) / w, per[5] / c, per[3] / w, np.log1p(longest),
    ], axis=1).astype(np.float64)
    return base, x


@dataclass
class Forest:
    """Boosted trees as flat arrays: node i of tree t splits ``feature[t, i]`` at ``cut[t, i]``; children 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > self.cut[t, at]))
            out += self.value[t, at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def train(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 5.0) -> Forest:
    """Logistic boosting on quantile bins. A split on a feature with sign s is allowed only if s * (right - left) >= 0,
    and the children's later values are held on their side of the middle, so the whole forest is monotonic."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1) if n else np.zeros((0, m), int)
    p0 = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    f = np.full(n, bias)
    for t in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-f))
        g, hs = y - p, p * (1 - p)
        todo = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            i, rows, lo, hi, d = todo.pop()
            G, H = g[rows].sum(), hs[rows].sum()
            v = float(np.clip(G / (H + l2), lo, hi))
            best = (1e-3, None)
            if d < depth and len(rows) >= 20:
                for j in range(m):
                    k = len(cuts[j])
                    if not k:
                        continue
                    gb = np.cumsum(np.bincount(code[rows, j], g[rows], k + 1))[:-1]
                    hb = np.cumsum(np.bincount(code[rows, j], hs[rows], k + 1))[:-1]
                    lv, rv = np.clip(gb / (hb + l2), lo, hi), np.clip((G - gb) / (H - hb + l2), lo, hi)
                    gain = gb * lv - 0.5 * (hb + l2) * lv**2 + (G - gb) * rv - 0.5 * (H - hb + l2) * rv**2 - (G * v - 0.5 * (H + l2) * v * v)
                    gain[(hb < 1) | (H - hb < 1)] = -1
                    if signs[j]:
                        gain[signs[j] * (rv - lv) < 0] = -1
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (gain[b], (j, b, lv[b], rv[b]))
            if best[1] is None:
                value[t, i] = rate * v
                f[rows] += rate * v
                continue
            j, b, lv, rv = best[1]
            feature[t, i], cut[t, i] = j, cuts[j][b]
            left = code[rows, j] <= b
            mid = (lv + rv) / 2
            a, z = ((lo, mid), (mid, hi)) if signs[j] > 0 else ((mid, hi), (lo, mid)) if signs[j] < 0 else ((lo, hi), (lo, hi))
            todo += [(2 * i + 1, rows[left], *a, d + 1), (2 * i + 2, rows[~left], *z, d + 1)]
    return Forest(feature, cut, value, depth, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, keep: F.Column) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents, those with the least md5 of their id among the rows of ``keep``.

    One row per id: its greatest label that isn't null and its least text. Labels without a document and null ids are
    passed over.
    """
    ids = labels.filter(keep & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    ids = ids.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    x = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most ``most`` rows
    return x.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 8000, keep: F.Column | None = None, **how) -> Forest:
    """Train on at most ``most`` labelled rows, a few numbers each. Without labels the forest is its bias alone (score 1/2).

    Repeated ids, null ids and null labels as in :func:`labelled_sample`; null and empty texts have counts of 0. Texts of any
    length are read whole; empty tables give the bias alone; extra columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in buf.pieces(batches):
            _, x = statistics(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    rows = labelled_sample(docs, labels, most, F.lit(True) if keep is None else keep)
    got = rows.select("text", F.col("y").cast("int")).mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.array(got.column(0).to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got.column(1).to_numpy().astype(np.float64)
    order = np.lexsort([*x.T, y])  # the rows' order doesn't matter to the result
    return train(x[order], y[order], tuple(FEATURES.values()), **how)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def apply_rules(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, base_failed, kept and the forest's score.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows; such documents aren't kept.
    Others are kept if the score reaches ``threshold``. Null and empty texts have counts of 0 and fail; repeated rows
    give repeated results; whole texts are read, however long; extra columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in buf.pieces(batches):
            base, x = statistics(b.column(1))
            score = forest.score(x)
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(base[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                names=["doc_id", *BASE, "base_failed", "kept", "score"],
            )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, forest).drop("score")
