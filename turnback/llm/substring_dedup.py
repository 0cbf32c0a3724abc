"""Substring dedup by factors of every document against every other's reference blocks.

A window of ``length`` words that an earlier document (smaller doc_id) has too is a duplicate. Every window chooses an
anchor, the least hash among the short blocks inside it; equal windows choose the same anchor at the same offset.
The successive windows with one anchor are a factor of the document's parse. Factors are indexed by (anchor,
signature of the whole factor), so that

1. factors that are equal from end to end are settled by the least document of their signature;
2. only where an anchor is shared but signatures differ, at the boundaries of longer matches, the windows themselves
   are compared, for one representative document of each signature (equal factors share its result).

So this is a relative parse into indexed factors with checks at their boundaries, but not the greedy one of relative
Lempel-Ziv: factors end where the anchor changes rather than where the longest match does. A greedy parse needs all
reference texts in one place and is blind to a window that begins inside a factor found in one document and ends inside
another's; content-chosen factors need no reference text, and the check of windows makes the result exact. Factors are
matched by 128 bits of their words (anchor and signature), windows by two independent hashes of 64.

Each task settles copies among its own rows first and sends one entry of a signature, so a passage in a third of all
documents is as many entries as there are tasks. Anchors at the edges of such a passage have a signature for every
document: entries of such an anchor are spread by signature and always compared. The covered stretches then meet
their documents for the cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import buf, work

LENGTH = 50
_CHECK = np.uint64(0xD1B54A32D192ED03)


def block_size(length: int) -> tuple[int, int]:
    """Words of an anchor block, and blocks in a window."""
    k = max(1, int(length * 0.4))
    return k, length - k + 1


def factors(h: np.ndarray, woff: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchor, signature, document's row, first window's start, windows of all factors."""
    k, w = block_size(length)
    g = buf.rolling(h, k)
    n = len(h) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    # the leftmost least block of each window: minima over doubling spans, each the earlier one on ties
    low, at, span = g.copy(), np.arange(len(g)), 1
    while span * 2 <= w:
        a, b = low[:-span], low[span:]
        t = b < a
        low, at = np.where(t, b, a), np.where(t, at[span:], at[:-span])
        span *= 2
    a, b = low[:n], low[w - span : w - span + n]
    at = np.where(b < a, at[w - span : w - span + n], at[:n])
    wdoc = buf.row_of(woff)
    start = np.flatnonzero(wdoc[:n] == wdoc[length - 1 :])
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    anchor = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(start) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    s, p = start[first], anchor[first]
    with np.errstate(over="ignore"):
        cs = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * buf.powers(buf._P, len(h)), out=cs[1:])
        whole = (cs[s + count - 1 + length] - cs[s]) * buf.powers(buf._INV, len(h) + 1)[s]
        sig = buf.mix(whole + (p - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    doc = wdoc[s]
    return g[p], sig, doc, s - woff[doc], count


def _merge(doc: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite overlapping or touching stretches [a, z) of the same row."""
    if not len(doc):
        return doc, a, z
    o = np.lexsort([a, doc])
    doc, a, z = doc[o], a[o], z[o]
    big = int(z.max()) + 1
    reach = np.maximum.accumulate(doc * big + z)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * big + a[1:] > reach[:-1]
    f = np.flatnonzero(new)
    last = np.append(f[1:], len(doc)) - 1
    return doc[f], a[f], reach[last] - doc[f] * big


def _settle(keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Per entry: is there one with the same keys and a smaller id."""
    o = np.lexsort([ids, *keys[::-1]])
    new = np.ones(len(o), bool)
    new[1:] = np.any([k[o][1:] != k[o][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    least = ids[o][new][group]
    later = np.empty(len(o), bool)
    later[o] = ids[o] > least
    return later


_FACTORS = "doc_id long, tid long, start int, n int, anchor long, sig long, settled boolean"
_WINDOWS = "doc_id long, tid long, start int, n int, whash long, wcheck long, settled boolean"
#: entries of an anchor beyond which they aren't brought together
HOT = 1 << 16


def _table(ids, tids, row, start, n, extra: dict[str, np.ndarray], settled) -> pa.RecordBatch:
    cols = {"doc_id": ids[row], "tid": tids[row], "start": start.astype(np.int32), "n": n.astype(np.int32), **{k: v.view(np.int64) for k, v in extra.items()}, "settled": settled}
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))


def _gather(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lots of about ``most`` bytes of text."""
    lot, size = [], 0
    for b in buf.pieces(batches):
        lot.append(b)
        size += b.column("text").nbytes
        if size >= most:
            yield lot
            lot, size = [], 0
    if lot:
        yield lot


def _factor_rows(length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _gather(batches, most):
            got = []
            for b in lot:
                _, _, _, woff, h = buf.words(b.column("text"))
                anchor, sig, doc, start, n = factors(h, woff, length)
                got.append((anchor, sig, b.column("doc_id").to_numpy()[doc], b.column("tid").to_numpy()[doc], start, n))
            anchor, sig, ids, tids, start, n = (np.concatenate([g[k] for g in got]) for k in range(6))
            if not len(ids):
                continue
            later = _settle([anchor, sig], ids)
            row = np.flatnonzero(later)
            # stretches of one document in one row each
            u, inv = np.unique(np.stack([ids[row], tids[row]], axis=1), axis=0, return_inverse=True)
            d, a, z = _merge(inv.reshape(-1).astype(np.int64), start[row].astype(np.int64), start[row] + n[row] + length - 1)
            none = np.zeros(len(d), np.int64)
            yield _table(u[:, 0], u[:, 1], d, a, z - a, {"anchor": none, "sig": none}, np.ones(len(d), bool))
            row = np.flatnonzero(~later)
            yield _table(ids, tids, row, start[row], n[row], {"anchor": anchor[row], "sig": sig[row]}, np.zeros(len(row), bool))

    return run


def _window_rows(length: int, most: int):
    """Of rows with ``want``, lists of (start, n): the hashes of the windows wanted, or stretches settled among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _gather(batches, most):
            got = []
            for b in lot:
                _, _, _, woff, h = buf.words(b.column("text"))
                w, v = buf.rolling(h, length), buf.rolling(buf.mix(h ^ _CHECK), length)
                want = b.column("want")
                rows = buf.row_of(want.offsets.to_numpy().astype(np.int64) - want.offsets[0].as_py())
                flat = want.flatten()
                s, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                rep = np.repeat(np.arange(len(s)), n)
                pos = s[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                row = rows[rep]
                got.append((w[woff[row] + pos], v[woff[row] + pos], b.column("doc_id").to_numpy()[row], b.column("tid").to_numpy()[row], pos))
            whash, wcheck, ids, tids, pos = (np.concatenate([g[k] for g in got]) for k in range(5))
            if not len(ids):
                continue
            later = _settle([whash, wcheck], ids)
            row = np.flatnonzero(later)
            u, inv = np.unique(np.stack([ids[row], tids[row]], axis=1), axis=0, return_inverse=True)
            d, a, z = _merge(inv.reshape(-1).astype(np.int64), pos[row], pos[row] + length)
            yield _table(u[:, 0], u[:, 1], d, a, z - a, {"whash": np.zeros(len(d), np.int64), "wcheck": np.zeros(len(d), np.int64)}, np.ones(len(d), bool))
            row = np.flatnonzero(~later)
            yield _table(ids, tids, row, pos[row], np.full(len(row), length), {"whash": whash[row], "wcheck": wcheck[row]}, np.zeros(len(row), bool))

    return run


def duplicate_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", lot_bytes: int = 24 << 20, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): spans has doc_id, tid, spans (array of start and n, in words); texts is docs as doc_id, tid, text.

    tid is a hash of the text, so that rows which repeat an id with another text keep spans of their own.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("tid"), docs[text_col].cast("string").alias("text"))
    real = texts.filter("doc_id is not null and text is not null")
    facts = work.table(real.mapInArrow(_factor_rows(length, lot_bytes), _FACTORS), "factors")
    whole = Window.partitionBy("anchor", "sig")
    open_facts = facts.filter("not settled")
    many = work.table(open_facts.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("anchor"), "hot")

    def judged(x: DataFrame, differ: F.Column) -> DataFrame:
        x = x.withColumn("least", F.min("doc_id").over(whole)).withColumn("differ", differ)
        return x.filter("least < doc_id or differ").withColumn("known", F.col("least") < F.col("doc_id")).select("doc_id", "tid", "start", "n", "known")

    by = Window.partitionBy("anchor")
    differ = F.min("sig").over(by) < F.max("sig").over(by)
    if many.isEmpty():
        shared = judged(open_facts, differ)
    else:
        shared = judged(open_facts.join(many, "anchor", "left_anti"), differ).unionByName(judged(open_facts.join(many, "anchor", "left_semi"), F.lit(True)))
    shared = work.table(shared, "shared")
    want = shared.filter("not known").groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n")).alias("want"))
    asked = real.join(want, ["doc_id", "tid"]).select("doc_id", "tid", "text", "want")
    windows = work.table(asked.mapInArrow(_window_rows(length, lot_bytes), _WINDOWS), "windows")
    open_ = windows.filter("not settled").withColumn("least", F.min("doc_id").over(Window.partitionBy("whash", "wcheck"))).filter("least < doc_id")
    every = facts.filter("settled").select("doc_id", "tid", "start", "n")
    every = every.unionByName(shared.filter("known").select("doc_id", "tid", "start", (F.col("n") + length - 1).alias("n")))
    every = every.unionByName(windows.filter("settled").select("doc_id", "tid", "start", "n")).unionByName(open_.select("doc_id", "tid", "start", "n"))
    return every.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n")).alias("spans")), texts


def _cut(full: bool):
    """With ``full`` the kept text (spaces as they were) and n_removed, else the digest columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in buf.pieces(batches):
            data, starts, ends, woff, _ = buf.words(b.column("text"))
            n = np.diff(woff)
            gone = np.zeros(len(starts) + 1, np.int64)
            want = b.column("spans")
            at = want.offsets.to_numpy().astype(np.int64)
            at -= at[0]
            if want.null_count:
                ok = np.asarray(want.is_valid())
                at = np.concatenate([[0], np.cumsum(np.where(ok, np.diff(at), 0))])
            rows = buf.row_of(at)
            flat = want.flatten()
            s = woff[rows] + flat.field("start").to_numpy().astype(np.int64)
            np.add.at(gone, s, 1)
            np.add.at(gone, s + flat.field("n").to_numpy().astype(np.int64), -1)
            keep = np.cumsum(gone)[:-1] == 0
            removed = n - buf.row_sum(keep, woff)
            out = []
            raw = data.tobytes()
            _, off = buf.flat(b.column("text"))
            for r in range(b.num_rows):
                if full:
                    if not removed[r]:
                        out.append(raw[off[r] : off[r + 1]])
                        continue
                    i = np.flatnonzero(keep[woff[r] : woff[r + 1]]) + woff[r]
                    cut = np.flatnonzero(np.diff(i) != 1)
                    a, z = np.append(i[:1], i[cut + 1]), np.append(i[cut], i[-1:])
                    out.append(b"\n".join([raw[starts[x] : ends[y]] for x, y in zip(a, z)]))
                else:
                    w = raw[off[r] : off[r + 1]].split()
                    k = keep[woff[r] : woff[r + 1]]
                    if removed[r]:
                        w = [x for x, ok in zip(w, k.tolist()) if ok]
                    out.append(hashlib.sha256(b" ".join(w)).hexdigest())
            cols = {"doc_id": b.column("doc_id"), "tid": b.column("tid"), "n_words": pa.array(n), "n_removed": pa.array(removed.astype(np.int64))}
            cols["kept" if full else "kept_sha256"] = pa.array(out, pa.binary()).cast(pa.string()) if full else pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, tid, n_words, n_removed and kept (the text without its duplicates) or kept_sha256.

    Words of a window of ``length`` words that starts in a document with a smaller doc_id are removed; windows are
    judged on the input. Repeats inside one document or among rows of one doc_id stay. Null, empty and short texts
    lose nothing (null counts as empty); rows with a null id neither lose words nor cost others any. Texts of any
    length are read whole; an empty table gives an empty result. Extra columns are ignored.
    """
    spans, texts = duplicate_spans(docs, length, id_col, text_col)
    x = texts.withColumn("text", F.coalesce("text", F.lit(""))).join(spans, ["doc_id", "tid"], "left").select("doc_id", "tid", "text", "spans")
    last = "kept_sha256 string" if digest else "kept string"
    return x.mapInArrow(_cut(not digest), f"doc_id long, tid long, n_words long, n_removed long, {last}")


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the duplicates cut from its texts; rows all stay, an n_chars
    column follows the text."""
    spans, _ = duplicate_spans(docs, length)
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("tid").alias("__t"), F.col("spans").alias("__spans"))
    x = docs.withColumn("__h", F.xxhash64("text"))
    x = x.join(spans, (x["doc_id"] == spans["__d"]) & (x["__h"] == spans["__t"]), "left")
    x = x.select(*[docs[c] for c in docs.columns], "__spans")
    change = _cut(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in buf.pieces(batches):
            part = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc_id"), b.column("text").fill_null(""), b.column("__spans")], names=["doc_id", "tid", "text", "spans"])
            (got,) = change(iter([part]))
            touched = pc.greater(got.column("n_removed"), 0)
            text = pc.if_else(touched, got.column("kept"), b.column("text"))
            cols = {n: b.column(n) for n in b.schema.names if n != "__spans"}
            cols["text"] = text
            if "n_chars" in cols:
                cols["n_chars"] = pc.if_else(touched, pc.utf8_length(text).cast(cols["n_chars"].type), cols["n_chars"])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return x.mapInArrow(run, docs.schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True).drop("tid")


ORACLE_8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(h) AS h, unnest(range(len(h))) AS i FROM (SELECT doc_id, list_transform(range(greatest(len(w) - 49, 0)), lambda i: md5(array_to_string(w[i + 1:i + 50], ' '))) AS h FROM d)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
s AS (SELECT g.doc_id, g.i, 1 AS hit FROM g JOIN m ON m.h = g.h WHERE m.least < g.doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
c AS (SELECT x.doc_id, x.i, x.word, coalesce(max(s.hit) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone FROM x LEFT JOIN s ON s.doc_id = x.doc_id AND s.i = x.i),
k AS (SELECT doc_id, count(*) AS n, sum(gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_words, coalesce(k.r, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
