"""NN-descent against all pairs."""

import numpy as np
import pytest

from postaudit.llm import descent as N

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, id STRING, n INT"


def brute(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    good = []
    for i, (vec_id, vec, *_) in enumerate(rows):
        ok = vec_id is not None and vec and all(x is not None and np.isfinite(x) for x in vec) and any(vec)
        good.append(np.float32(vec).astype(np.float64) if ok else None)
    linked = [set() for _ in rows]
    for i, a in enumerate(good):
        for j, b in enumerate(good):
            if i != j and a is not None and b is not None and len(a) == len(b):
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    linked[i].add(j)
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        seen, waiting = {i}, [i]
        while waiting:
            for j in linked[waiting.pop()] - seen:
                seen.add(j)
                waiting.append(j)
        root = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(linked[i]), root, vec_id is not None and vec_id == root))
    return sorted(out, key=str)


def clusters(rng, sizes, width=16, noise=0.01):
    made = []
    for size in sizes:
        center = rng.standard_normal(width)
        for _ in range(size):
            made.append((rng.uniform(0.5, 3) * (center + noise * rng.standard_normal(width))).tolist())
    return made


def rows_of(vectors, start=0):
    return [(start + i, v, 0, "x", 5) for i, v in enumerate(vectors)]


def run(spark, rows, **options):
    got = N.near_dedup(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_finds_all_links_of_clusters(spark):
    rows = rows_of(clusters(np.random.default_rng(1), [1] * 300 + [2] * 20 + [15, 40]))
    assert run(spark, rows, bucket=64) == brute(rows)


def test_full_lists_grow_and_then_count_in_tiles(spark):
    """A group beyond the greatest length of a list: every link is counted, in tiles smaller than the group."""
    rows = rows_of(clusters(np.random.default_rng(2), [1] * 60 + [90, 5]))
    assert run(spark, rows, longest=32, tile=25, bucket=32) == brute(rows)


def test_nulls_copies_lengths_and_repeats(spark):
    vec = [1.0, 2.0, 3.0]
    rows = [(1, vec, 0, "", 0), (2, vec, 1, "", 0), (2, vec, 1, "", 0), (3, [2.0, 4.0, 6.0], 0, "", 0), (4, None, 0, "", 0),
            (5, [0.0, 0.0, 0.0], 0, "", 0), (6, [1.0, None, 3.0], 0, "", 0), (7, [1.0, float("nan"), 3.0], 0, "", 0),
            (8, [1.0, float("inf"), 3.0], 0, "", 0), (9, [1.0, 2.0], 0, "", 0), (10, [], 0, "", 0), (None, vec, 0, "", 0),
            (11, [-1.0, -2.0, -3.0], 0, "", 0), (12, [1e30, 2e30, 3e30], 0, "", 0), (9, [5.0, 1.0, 0.0], 0, "", 0)]
    want = brute(rows[:13]) and brute([r for r in rows if r[0] != 12])
    got = run(spark, rows)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert by[1] == [(4, 1, True)] and by[2] == [(4, 1, False)] * 2 and by[3] == [(4, 1, False)] and by[12] == [(4, 1, False)]
    for lonely in (4, 5, 6, 7, 8, 10, 11):
        assert by[lonely] == [(0, lonely, True)]
    assert by[9] == [(0, 9, True)] * 2 and by[None] == [(0, None, False)] and len(want) == 14


def test_audit_sees_what_the_lists_miss(spark):
    rows = clusters(np.random.default_rng(4), [6] * 40)
    frame = spark.createDataFrame([(i, len(v), v) for i, v in enumerate(rows)], "id LONG, width INT, vec ARRAY<DOUBLE>")
    wanted = N.audit_links(frame, 1000, 0.95)
    assert wanted.count() == 40 * 30
    _, share = N.neighbour_lists(frame, bucket=8, seeds=1)
    assert share >= N.RECALL


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_of(k):
    rng = np.random.default_rng(k)
    near = rng.standard_normal((7, 20))
    near[2], near[3, 5:] = -np.inf, -np.inf
    rows, columns = N.best_of(near, np.full(7, k))
    for i in range(7):
        want = sorted((x for x in near[i] if x > -np.inf), reverse=True)[:k]
        assert near[i, columns[rows == i]].tolist() == want


def test_empty_table(spark):
    assert run(spark, []) == []
