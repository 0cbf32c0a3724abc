import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from turnback.llm import components, simhash, substring_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = "[^\x20\x09-\x0d]+"


def key(r):
    return tuple((x is None, x) for x in r)


def fp(t):
    w = re.findall(WORD, (t or "").translate(UP))
    s = [" ".join(p) for p in zip(w, w[1:])] if len(w) > 1 else w
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)) if hs else 0


def brute_near(ids, x, bits=6):
    m = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    lab = np.arange(len(x))
    while True:
        new = np.array([lab[m[i]].min() for i in range(len(x))])
        if (new == lab).all():
            break
        lab = new
    comp = defaultdict(list)
    for i, r in enumerate(lab):
        comp[r].append(ids[i])
    least = {r: min((v for v in vs if v is not None), default=None) for r, vs in comp.items()}
    return [(ids[i], f"{int(x[i]):016x}", int(m[i].sum()) - 1, least[lab[i]]) for i in range(len(x))]


def test_near_duplicates(odd, odd_rows):
    got = [(r.doc_id, r.fingerprint, r.n_near, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    want = brute_near([d for d, _, _ in odd_rows], np.array([fp(t) for _, t, _ in odd_rows], np.uint64))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("how", [{}, {"split": 2, "block": 5}, {"split": 20, "block": 1000}])
def test_links_of_dense_and_random_fingerprints(spark, how):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    base = np.uint64(0xDEADBEEFCAFEF00D)
    flips = [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for _ in range(300)]
    spread = [base ^ np.uint64(sum(1 << (8 * int(p) + int(rng.integers(8))) for p in rng.choice(8, 6, replace=False))) for _ in range(50)]
    x = np.unique(np.concatenate([x, np.array(flips), np.array(spread)]))
    nodes = spark.createDataFrame([(int(v), int(n)) for v, n in zip(x.view(np.int64), rng.integers(1, 4, len(x)))], "fp long, n long")
    n = {r.fp: r.n for r in nodes.collect()}
    near = defaultdict(int)
    other = []
    for r in simhash.links(nodes, **how).collect():
        near[r.fp] += r.near
        other += [(r.fp, r.other)] if r.other is not None else []
    m = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 6) & ~np.eye(len(x), dtype=bool)
    ns = np.array([n[int(v)] for v in x.view(np.int64)])
    assert [near[int(v)] for v in x.view(np.int64)] == (m @ ns).tolist()
    a, b = np.nonzero(np.triu(m))
    want = components.union_find(x.view(np.int64)[a], x.view(np.int64)[b])
    got = components.union_find(*np.array(other).T)
    assert all((g == w).all() for g, w in zip(got, want))


def test_survivors(odd, odd_rows):
    from pyspark.sql import functions as F

    x = odd.withColumn("h", F.lit(1)).withColumn("d", F.lit("d"))
    got = simhash.survivors(x)
    assert got.columns == x.columns
    ids, prints = [d for d, _, _ in odd_rows], np.array([fp(t) for _, t, _ in odd_rows], np.uint64)
    comp = [c for _, _, _, c in brute_near(ids, prints)]
    groups = defaultdict(set)
    for (d, t, _), c, p in zip(odd_rows, comp, prints):
        groups[c if c is not None else f"alone {p}"].add((d is None, d or 0, t))
    have = [(r.doc_id is None, r.doc_id or 0, r.text) for r in got.collect()]
    assert len(have) == len(groups)
    for g in groups.values():
        (one,) = [x for x in have if x in g]
        assert one[:2] == min(x[:2] for x in g)


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, one_task):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 400, 260), rng.integers(0, 400, 260)
    a, b = np.append(a, np.arange(1000, 1040)), np.append(b, np.arange(1001, 1041))  # and a long chain
    edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").filter("a != b")
    got = {r.node: r.root for r in components.components(edges, one_task).collect()}
    nodes, root = components.union_find(a[a != b], b[a != b])
    assert got == dict(zip(nodes.tolist(), root.tolist()))


def test_empty(empty, odd):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.survivors(empty).count() == 0
    assert substring_dedup.dedup(empty).count() == 0
    assert substring_dedup.cut(empty).count() == 0


def brute_cut(rows, length=50):
    seen = {}
    for d, t in rows:
        w = re.findall(WORD, t or "")
        if d is not None:
            for i in range(len(w) - length + 1):
                k = tuple(w[i : i + length])
                seen[k] = min(seen.get(k, d), d)
    out = []
    for d, t in rows:
        w = re.findall(WORD, t or "")
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - length + 1):
                if seen[tuple(w[i : i + length])] < d:
                    gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("length,lot,hot", [(50, 24 << 20, 1 << 16), (50, 2000, 1), (7, 5000, 3), (1, 3000, 0)])
def test_substrings(odd, odd_rows, length, lot, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup.duplicate_spans, "__defaults__", (50, "doc_id", "text", lot, hot))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(odd.repartition(3), length, digest=True).collect()]
    assert sorted(got, key=key) == sorted(brute_cut([(d, t) for d, t, _ in odd_rows], length), key=key)


def test_cut_keeps_rows_and_columns(odd, odd_rows):
    got = substring_dedup.cut(odd)
    assert got.columns == odd.columns and got.count() == len(odd_rows)
    want = sorted((x for x in brute_cut([(d, t) for d, t, _ in odd_rows])), key=key)
    have = [(r.doc_id, hashlib.sha256(" ".join(re.findall(WORD, r.text or "")).encode()).hexdigest()) for r in got.collect()]
    assert sorted(have, key=key) == sorted([(w[0], w[3]) for w in want], key=key)
