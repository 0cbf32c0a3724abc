"""Each stage of the pipeline against plain Python on its own input, on a small corpus and on odd rows."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_dedup import brute_cut, brute_near, fp
from test_rows import check_pack, plain_features

from turnback.llm import line_quality, mixing, work


def plain_quality(crf, text):
    """A document's score from features in plain Python and forward-backward in logarithms."""
    x, nb = plain_features(text)
    if not len(x):
        return crf.empty
    n, own = x.shape
    pad = np.vstack([np.zeros(own), x, np.zeros(own)])
    edge = np.eye(n)
    f = np.hstack([x, x * x, pad[:-2], pad[2:], edge[:, :1], edge[:, -1:], np.ones((n, 1))])
    u = (f - crf.centre) / crf.scale @ crf.weights
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = 0, u[0]
    for t in range(1, n):
        a[t] = np.logaddexp(a[t - 1][0] + crf.trans[0], a[t - 1][1] + crf.trans[1]) + (0, u[t])
    for t in range(n - 2, -1, -1):
        y = np.array([0, u[t + 1]]) + b[t + 1]
        b[t] = np.logaddexp(crf.trans[:, 0] + y[0], crf.trans[:, 1] + y[1])
    g = a + b
    q = np.clip(np.average(1 / (1 + np.exp(g[:, 0] - g[:, 1])), weights=nb), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(crf.slope * np.log(q / (1 - q)) + crf.shift)))


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(t):
    return (t or "").encode().split()


@pytest.mark.parametrize("which", ["small", "odd"])
def test_stages(spark, sf, odd, which):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "small" else odd
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(work.table(stage(spark, kept[-1], sf), "stage"))
        if name != "packing":
            assert kept[-1].columns == docs.columns
    at = [Counter(rows(x)) for x in kept[:5]]

    crf = line_quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), keep=line_quality.training_rows())
    if crf is None:
        assert at[1] == at[0]
    else:
        scores = {t: plain_quality(crf, t) for _, t in at[0]}
        sure = [r for r in at[0] if abs(scores[r[1]] - 0.5) > 1e-9]
        assert len(sure) > 0.9 * len(at[0]) and all((r in at[1]) == (scores[r[1]] >= 0.5) for r in sure)
        assert all(at[1][r] == at[0][r] for r in at[1])

    ids, texts = zip(*[r for r in at[1].elements()])
    groups = defaultdict(set)
    prints = np.array([fp(t) for t in texts], np.uint64)
    for d, t, p, (_, _, _, c) in zip(ids, texts, prints, brute_near(list(ids), prints)):
        groups[c if c is not None else f"alone {p}"].add((d is None, d or 0, t))
    assert sum(at[2].values()) == len(groups)
    for g in groups.values():
        (one,) = [r for r in at[2] if (r[0] is None, r[0] or 0, r[1]) in g]
        assert (one[0] is None, one[0] or 0) == min(x[:2] for x in g)

    before = list(at[2].elements())
    want = Counter((d, h) for d, _, _, h in brute_cut(before))
    assert Counter((d, hashlib.sha256(b" ".join(words(t))).hexdigest()) for d, t in at[3].elements()) == want

    size, taken = Counter(), Counter()
    biggest = Counter()
    for r in kept[3].collect():
        size[r.source] += len(words(r.text))
        biggest[r.source] = max(biggest[r.source], len(words(r.text)))
    for r in kept[4].collect():
        taken[r.source] += len(words(r.text))
    left = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, target = float(sum(size.values())), {}
    while left:  # shared by weight; what is over three times the size is shared again
        part = total / sum(left.values())
        full = [s for s, w in left.items() if part * w >= mixing.MOST * size[s]]
        for s in full or list(left):
            target[s] = float(mixing.MOST * size[s]) if full else part * left[s]
            total -= target[s]
            del left[s]
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in size)
    assert set(at[4]) <= set(at[3])

    assert check_pack(list(at[4].elements()), kept[5].collect()) <= 1


def test_stages_on_an_empty_table(spark, sf, empty):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, sf)
        assert got.count() == 0
        if name != "packing":
            assert got.columns == empty.columns


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
