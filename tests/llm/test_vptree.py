"""Neighbours against brute force; factor one is exact, a larger one keeps its recall."""

import numpy as np
import pytest

from postaudit.llm import vptree


def brute(rows, every, k):
    out = []
    for i, q in rows:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(np.float64(q), np.float64(v))), j) for j, v in rows if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank string, size int, shard int")


def table(spark, rows):
    return frame(spark, [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "r", 3, 4)
                         for i, v in rows])


@pytest.mark.parametrize("shard,leaf", [(50, 5), (1000, 3), (97, 256)])
def test_exact(spark, shard, leaf):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 6)).astype(np.float32) * rng.choice([0.1, 1, 30], size=(300, 1)).astype(np.float32)
    points[100:160] = points[100]  # ties
    rows = [(i, p) for i, p in enumerate(points)]
    got = vptree.nearest(table(spark, rows), 7, 5, 1.0, shard, leaf).collect()
    assert sorted(map(tuple, got)) == brute(rows, 7, 5)


def test_unusable_rows_and_few_candidates(spark):
    odd = [(0, [1, 0]), (1, [0, 1]), (2, None), (20, []), (40, [0, 0]), (60, [float("nan"), 1]), (80, [float("inf"), 1]),
           (100, [None, 1]), (None, [1, 1]), (120, [2, 1]), (120, [2, 1]), (140, [1, 2, 3])]
    good = [(0, [1, 0]), (1, [0, 1]), (120, [2, 1])]
    got = sorted(map(tuple, vptree.nearest(table(spark, odd)).collect()))
    assert got == brute(good, 20, 20)


def test_empty(spark):
    assert vptree.nearest(table(spark, [])).collect() == []
    assert vptree.nearest(table(spark, [(1, [1, 2])])).collect() == []


def test_relaxed_recall():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    points = centres[rng.integers(40, size=6000)] + 0.25 * rng.normal(size=(6000, 32))
    ids, queries = np.arange(6000), np.arange(0, 6000, 60)
    tree = vptree.build(ids, points, 64)
    exact = vptree.search(tree, points[queries], queries, 20)
    loose = vptree.search(tree, points[queries], queries, 20, 2.0)
    pairs = [set(zip(x[0].tolist(), x[1].tolist())) for x in (exact, loose)]
    want = np.argsort(-(points[queries] @ points.T - 1e9 * (queries[:, None] == ids)), axis=1)[:, :20]
    assert pairs[0] == {(q, j) for q, row in zip(queries.tolist(), want.tolist()) for j in row}
    assert len(pairs[0] & pairs[1]) / len(pairs[0]) >= 0.9
