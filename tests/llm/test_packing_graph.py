"""The graph and the paths of related-document packing against brute force, over many shards and with a large group."""

import random

import numpy as np
import pyarrow as pa
import pytest

from turnback.llm import packing


def texts(n):
    """Documents of mixed topics; half of them have one passage in common."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4000)]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    hot = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        own = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))]
        out.append(" ".join(rng.sample(passages, rng.randint(0, 3)) + own + [hot] * (i % 2)))
    return out


def likenesses(docs):
    sk = packing.sketch(pa.array(docs))
    like = ((sk[:, None] == sk) & (sk[:, None] != packing._TOP)).sum(axis=2)
    np.fill_diagonal(like, 0)
    return like


def graph(spark, docs, **how):
    sk = packing.sketch(pa.array(docs))
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sk)], "node long, sketch binary").repartition(3)
    return {r["node"]: np.frombuffer(r["near"], np.int64) for r in packing.neighbours(nodes, **how).collect()}


def test_neighbours_are_exact_without_caps(spark):
    docs = texts(400)
    like = likenesses(docs)
    got = graph(spark, docs, reach=len(docs), most=len(docs))
    for i in range(len(docs)):
        near = got.get(i, np.zeros(0, np.int64))
        assert set(near.tolist()) >= set(np.flatnonzero(like[i]).tolist())
        assert (np.diff(like[i, near]) <= 1).all()  # 16 bits of a place agree by chance now and then


def test_recall_of_nearest_neighbours(spark):
    """Half of the documents share one passage, so its lists are far longer than the reach."""
    docs = texts(3000)
    like = likenesses(docs)
    assert (like > 0).sum(axis=1).max() > 1000
    got = graph(spark, docs)
    some = np.flatnonzero(like.max(axis=1))
    assert np.mean([i in got and like[i, got[i][0]] == like[i].max() for i in some]) >= 0.9
    high = np.flatnonzero(like.max(axis=1) >= 8)
    assert len(high) > 50 and np.mean([like[i, got[i][0]] == like[i].max() for i in high]) >= 0.9


@pytest.mark.parametrize("how", [{}, {"reach": 100}])
def test_the_likest_of_long_lists_are_exact(spark, how):
    """Lists far longer than a block, and copies: the very neighbours that brute force finds, ties included."""
    docs = texts(1500)
    docs += docs[7:8] * 120 + ["short", ""]
    exact(np.arange(len(docs)), packing.sketch(pa.array(docs)), graph(spark, docs, **how))


def exact(node, sk, got):
    """Whether ``got`` has the likest of all others for each node."""
    s = packing.short(sk)
    met = ((sk[:, None] == sk) & (sk[:, None] != packing._TOP)).any(axis=2)
    like = ((s[:, None] == s) & (s[:, None] != packing._NONE)).sum(axis=2)
    np.fill_diagonal(met, False)
    assert met.sum(axis=1).max() > 700
    assert set(got) == set(node[met.any(axis=1)].tolist())
    for i in np.flatnonzero(met.any(axis=1)):
        k = np.flatnonzero(met[i])
        o = np.lexsort([node[k], packing.pair_hash(np.full(len(k), node[i]), node[k]), -like[i, k]])
        assert got[int(node[i])].tolist() == node[k[o]][: packing.MOST].tolist()


def test_the_pipeline_packs_by_the_exact_graph(spark, monkeypatch):
    """The last stage, on documents of which half share a passage: the graph it lays out, and all documents whole."""
    import corpus_pipeline

    seen, find = [], packing.neighbours

    def spy(nodes, *a, **how):
        out = find(nodes, *a, **how)
        seen.append(([(r["node"], r["sketch"]) for r in nodes.select("node", "sketch").collect()], {r["node"]: np.frombuffer(r["near"], np.int64) for r in out.collect()}))
        return out

    monkeypatch.setattr(packing, "neighbours", spy)
    docs = texts(1500)
    table = spark.createDataFrame([(i, t, None if i % 7 else "s") for i, t in enumerate(docs)], "doc_id long, text string, source string")
    x = corpus_pipeline.STAGES[-1][1](spark, table.repartition(5), None).toPandas()
    ((nodes, got),) = seen
    exact(np.array([n for n, _ in nodes]), np.frombuffer(b"".join(bytes(s) for _, s in nodes), np.uint64).reshape(-1, packing.PLACES), got)
    whole = x.groupby("doc_id").agg(n=("length", "sum"), tokens=("doc_tokens", "max"))
    assert len(whole) == len(docs) and (whole.n == whole.tokens).all()


def test_the_graph_reads_the_sketches_twice(spark, tmp_path):
    """Once to count some of them, once to compare all: no sampling of ranges, no second search of long lists."""
    docs, seen = texts(400), str(tmp_path / "seen")
    nodes = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(packing.sketch(pa.array(docs)))], "node long, sketch binary")

    def count(batches):
        for b in batches:
            with open(seen, "a") as f:
                f.write("x" * b.num_rows)
            yield b

    assert packing.neighbours(nodes.mapInArrow(count, nodes.schema)).count() > 300
    assert len(open(seen).read()) <= 2 * len(docs)


@pytest.mark.parametrize("shards", [1, 20, 200])
def test_nearest_neighbours_share_a_shard(spark, shards):
    docs = texts(3000)
    like = likenesses(docs)
    total = sum(len(d) + 1 for d in docs)
    x = packing.pack(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5), shard_bytes=-(-total // shards)).toPandas()
    x = x[x.start == 0].sort_values(["sequence_id", "offset"])
    shard = (x.set_index("doc_id").sequence_id // 2**32).to_dict()
    assert shards // 2 <= len(set(shard.values())) <= shards
    some = np.flatnonzero(like.max(axis=1))
    best = [np.flatnonzero(like[i] == like[i].max()) for i in some]
    assert np.mean([any(shard[j] == shard[i] for j in b.tolist()) for i, b in zip(some.tolist(), best)]) >= 0.9
    # the paths: documents that follow each other are related wherever the walk could go on
    order = x.doc_id.to_numpy()
    linked = np.mean([like[a, b] > 0 for a, b in zip(order[:-1], order[1:]) if like[a].any()])
    assert linked > 0.6


def test_walk_by_brute_force():
    """Low degree first, then the likest unvisited neighbour."""
    rng = np.random.default_rng(2)
    n = 60
    m = np.triu(rng.random((n, n)) < 0.06, 1) * rng.random((n, n))
    m = m + m.T
    lists = [[j for j in np.argsort(-m[i]).tolist() if m[i, j]] for i in range(n)]
    off = np.append(0, np.cumsum([len(v) for v in lists]))
    near = np.array([j for v in lists for j in v])
    starts = np.lexsort([np.arange(n), np.diff(off)])
    want, left = [], set(range(n))
    for s in starts.tolist():
        while s in left:
            left.discard(s)
            want.append(s)
            s = next((j for j in lists[s] if j in left), -1)
    assert packing.walk(off, near, starts).tolist() == want


def test_a_large_cluster_is_cut(spark):
    """Copies of one document, and repeated rows, beyond a shard's bytes."""
    t = texts(1)[0] + " " + "same words again and again " * 20
    rows = [(i, t) for i in range(300)] + [(1000, t)] * 200
    x = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shard_bytes=20_000).toPandas()
    assert (x.sequence_id // 2**32).nunique() > 3 and len(x[x.start == 0]) == 500
