"""Operator 9 against brute force: scores, order, ties, and recall."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from joulecorpus.llm import nearest as N

SCHEMA = "vec_id bigint, embedding array<float>, list string, rank int"


def brute(ids, vectors, query, k=20):
    v = vectors.astype(np.float64)
    own = np.flatnonzero(ids == query)
    score = {}
    for o in own:
        for i, s in zip(ids.tolist(), (v @ v[o]).tolist()):
            if i != query:
                score[i] = max(s, score.get(i, -np.inf))
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def run(spark, ids, vectors):
    rows = [(int(i), [float(x) for x in v], "clash", 1) for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return N.nearest(df, F.col("vec_id") % 20 == 0)


def test_recall_scores_and_ranks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16))
    vectors = (centres[rng.integers(0, 10, 3000)] + rng.normal(0, 0.8, (3000, 16))).astype(np.float32)
    vectors[100:700] = vectors[100]  # one vector has a fifth of all rows
    vectors[700:] *= rng.uniform(0.5, 2, (2300, 1)).astype(np.float32)
    ids = rng.permutation(3000)
    found: dict = {}
    for r in run(spark, ids, vectors).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    at = {i: v for i, v in zip(ids.tolist(), vectors.astype(np.float64))}
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1])) and q not in {r[1] for r in rows}
        assert all(np.isclose(r[2], at[q] @ at[r[1]], rtol=1e-12) for r in rows)
        hits += len({r[1] for r in rows} & {i for i, _ in brute(ids, vectors, q)})
    assert hits / (20 * len(found)) >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    vectors = np.tile(np.array([[0.3, 0.1, 0.7]], np.float32), (200, 1))
    got = run(spark, np.arange(200), vectors).collect()
    for q in range(0, 200, 20):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i in range(21) if i != q][:20]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a", 1), (1, [0.5, 0.5], "a", 1), (2, None, None, None), (3, [0.0, 0.0], "a", 1), (4, [nan, 1.0], "a", 1),
        (5, [None, 1.0], "a", 1), (6, [inf, 1.0], "a", 1), (7, [1.0], "a", 1), (20, [0.0, 1.0], "a", 1), (None, [1.0, 1.0], "a", 1),
        (1, [0.9, 0.5], "a", 1), (1, [0.9, 0.5], "a", 1), (40, [0.0, 0.0], "a", 1), (8, [], "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, N.nearest(df, F.col("vec_id") % 20 == 0).collect()))
    want = [(0, 1, 1, 0.9), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert N.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert N.nearest(df.where("vec_id = 1"), F.col("vec_id") % 20 == 0).collect() == []


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(4000, 12))
    graph = N.Graph.fit(sample, 40_000, float(np.sqrt((sample**2).sum(1).max())))
    points = rng.normal(size=(300, 12))
    row, found = graph.lists(points, 1.15, 4, len(graph.centroids), True)
    wide = np.concatenate([points, np.zeros((300, 1))], axis=1)
    distance = np.sqrt(((wide[:, None] - graph.centroids) ** 2).sum(2))
    want = {(i, j) for i in range(300) for j in np.flatnonzero(distance[i] <= 1.15 * distance[i].min())}
    got = set(zip(row.tolist(), found.tolist()))
    assert len(want & got) / len(want) > 0.97


def test_lists_are_balanced():
    rng = np.random.default_rng(2)
    parts = N.halved(rng.normal(size=(1000, 5)) ** 3, 4, rng)
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and {len(p) for p in parts} <= {62, 63}


def test_the_graph_of_most_centroids_is_fitted_in_bounded_memory():
    import tracemalloc

    sample = np.random.default_rng(9).normal(size=(20_000, 16))
    tracemalloc.start()
    graph = N.Graph.fit(sample, 10**9, float(np.sqrt((sample**2).sum(1).max())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(graph.centroids) > 4096 and peak < 400 << 20
    exact = ((graph.centroids[:5, None] - graph.centroids[None]) ** 2).sum(2)
    assert (np.sort(graph.neighbours[:5, :8], axis=1) == np.sort(np.argsort(exact, axis=1)[:, :8], axis=1)).all()
