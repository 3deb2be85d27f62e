"""Exact dedup against plain Python on small tables."""

import hashlib
from collections import defaultdict

import pytest

from postaudit.llm import exact

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é" * 5000), (6, "é" * 5000), (7, "b"), (8, "a "), (None, "b"),
        (None, "c"), (9, "d"), (9, "d"), (10, "x" * 200_000)] + [(100 + i, "hot") for i in range(300)]


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep, stays = max((i for i in ids if i is not None), default=None), True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and stays, hashlib.sha256(text.encode()).hexdigest()))
            stays = stays and i != keep
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n int, key string")


@pytest.mark.parametrize("capacity", [1, 3, 50_000])
def test_report(spark, capacity):
    found = exact.exact_dedup(frame(spark, ROWS), capacity).drop("bucket", "chain").collect()
    assert sorted(map(tuple, found), key=repr) == brute(ROWS)


def test_empty(spark):
    assert exact.exact_dedup(frame(spark, [])).collect() == []
    assert exact.drop_exact_copies(frame(spark, [])).collect() == []


def test_drop_keeps_columns_and_one_row(spark):
    left = exact.drop_exact_copies(frame(spark, ROWS))
    assert left.columns == ["doc_id", "text", "n", "key"]
    assert sorted((r.doc_id, r.text or "") for r in left.collect() if r.doc_id is not None) == sorted(
        (k, t) for t, k in {(t or ""): max(i for i, u in ROWS if i is not None and (u or "") == (t or ""))
                            for j, t in ROWS if j is not None}.items())
    assert [r.text for r in left.collect() if r.doc_id is None] == ["c"]


def test_buckets_hold_ranges_within_capacity(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    index, rows = exact.build_index(docs, 100)
    assert rows.join(index, ["bucket", "key", "sha"]).count() == 4000
    buckets = index.groupBy("bucket", "depth").count().collect()
    assert len(buckets) > 40 and max(b["count"] for b in buckets) <= 100
    assert len({b.bucket for b in buckets}) == len(buckets)
    assert index.filter("chain > 1").count() == 0


def test_texts_of_one_key_are_chained(spark, monkeypatch):
    """With a key of four values most texts collide; bytes decide, and each text has a place of its own in its chain."""
    whole = exact.F.xxhash64
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: whole(*c).bitwiseAND(exact.F.lit(3)))
    found = exact.exact_dedup(frame(spark, ROWS), 3)
    rows = found.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == brute(ROWS)
    places = {(r.bucket, r.chain, r.text_sha256) for r in rows}
    assert len(places) == len({r.text_sha256 for r in rows}) and max(r.chain for r in rows) > 1


def test_hot_text_goes_to_several_owners(spark):
    rows = [(i, "hot") for i in range(6000)] + [(6000 + i, f"t{i % 50}") for i in range(100)]
    found = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r)[:5] for r in found.collect()), key=repr) == brute(rows)


def test_owners_group_without_another_exchange_of_texts(spark, tmp_path, monkeypatch):
    plans, keep = [], exact.materialise
    monkeypatch.setattr(exact, "materialise", lambda df, folder=None: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or keep(df, folder))
    exact.build_index(frame(spark, ROWS))
    owned = next(p for p in plans if "rangepartitioning" in p and "text" in p.split("rangepartitioning")[0])
    assert owned.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in owned
