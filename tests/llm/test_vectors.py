"""Exact top-k search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from ringfold.llm import topk


def brute(vectors, queries, k):
    out = []
    for q in queries:
        own = [v for i, v in vectors if i == q][0]
        scored = sorted(((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in vectors if i != q and len(v) == len(own)))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 1, "z") for i in range(700)]
    rows += [(700 + i, rows[7][1], 2, "z") for i in range(20)]
    rows += [(800, None, 1, "z"), (801, [1.0, None, 2.0, 1.0, 1.0, 1.0], 1, "z"), (802, [float("nan")] * 6, 1, "z"), (803, [float("inf")] * 6, 1, "z"), (804, [1.0, 2.0], 1, "z"), (None, [0.0] * 6, 1, "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank string")
    got = sorted(map(tuple, topk.top_k(topk.integer_vectors(table), F.col("id") % 100 == 0).collect()))
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if i is not None and i not in (800, 801, 802, 803)]
    assert got == brute(whole, [i for i, _ in whole if i % 100 == 0], 10)


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(topk.integer_vectors(table), F.col("id") % 100 == 0).collect())) == [(0, 1, 100, 2 * 1024 * 1024), (0, 2, 3, -1024 * 1024), (100, 1, 0, 2 * 1024 * 1024), (100, 2, 3, -2 * 1024 * 1024)]
    assert topk.top_k(topk.integer_vectors(table.limit(0)), F.col("id") % 100 == 0).count() == 0


def test_large_components_stay_exact():
    a, b = np.array([[1 << 40, -3]]), np.array([[1 << 20, 5], [7, 9]])
    assert topk.inner(b, a[0]).tolist() == [(1 << 60) - 15, 7 * (1 << 40) - 27]
    huge = np.array([[1 << 60, 1 << 60]])
    assert topk.inner(huge, huge[0]).tolist() == [2**63 - 1]


def test_waves_cover_all_shards_once():
    for n in (1, 2, 7, 16, 33, 500):
        w = topk.waves(n)
        assert [a for a, _ in w] == [0, *[b for _, b in w[:-1]]] and w[-1][1] == n and all(a < b for a, b in w)


def test_known_scores_prune_leaves():
    """Branch and bound looks into few leaves where vectors stand in groups, and into fewer still from a score known before."""
    rng = np.random.default_rng(3)
    groups = rng.integers(-1000, 1000, (40, 8))
    vectors = (groups[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 8))).astype(np.int64)
    ids = np.arange(4000)
    for q in vectors[:20]:
        tree = topk.BallTree(vectors, 64)
        whole = tree.search(q, ids, -1, 10)
        first = tree.looked
        want = sorted(zip((vectors @ q).tolist(), (-ids).tolist()), reverse=True)[:10]
        assert whole == [(s, -i) for s, i in want] and first < len([c for c in tree.children if c is None]) / 3
        tree.looked = 0
        assert tree.search(q, ids, -1, 10, whole[-1][0]) == whole and tree.looked <= first
