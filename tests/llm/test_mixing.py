"""Targets, copies and the mixed corpus against plain Python."""

import re
from fractions import Fraction

import pytest

from postaudit.llm import mixing

ROWS = [(1, "a b c", "x"), (2, "d e\t f\n", "x"), (3, None, "x"), (4, "", None), (5, "one two", None), (6, "w " * 900, "é"),
        (7, "\x85 \xa0 z", "Z"), (None, "no id", "Z"), (8, None, "empty"), (1, "a b c", "x")]
ROWS += [(100 + i, "some words of text here", f"s{i % 7}") for i in range(200)]


def size(text):
    return len(re.findall("[^\x20\x09-\x0D]+", text or ""))


def plain_targets(rows):
    sums = {}
    for _, text, source in rows:
        sums[source] = sums.get(source, 0) + size(text)
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, full = Fraction(3, 2) * sum(sums.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        pool = goal - sum(2 * sums[s] for s in full)
        share = {s: pool * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = {s for s in rest if share[s] > 2 * sums[s]}
        if not over:
            return sums, {s: float(share.get(s, 2 * sums[s])) for s in names}
        full |= over


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 5, "q") for i, t, s in rows],
                                 "doc_id long, text string, source string, n int, target string")


def test_mix(spark):
    sums, goals = plain_targets(ROWS)
    sources = {i: s for i, _, s in ROWS}
    rows = mixing.mix(frame(spark, ROWS)).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id) == sorted((i, size(t)) for i, t, _ in ROWS if i)
    for r in rows:
        s = sources[r.doc_id]
        assert (r.source_size, r.target) == (sums[s], pytest.approx(goals[s], rel=1e-12))
        rate = goals[s] / sums[s] if sums[s] else 0
        assert int(rate) <= r.copies <= int(rate) + 1 and r.copies <= 2 and r.taken == r.size * r.copies
    again = mixing.mix(frame(spark, ROWS[::-1]).repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_emitted_rows(spark):
    docs = frame(spark, ROWS)
    often = {}
    for r in mixing.mix(docs).collect():
        often[r.doc_id] = often.get(r.doc_id, 0) + r.copies
    out = mixing.emit_mix(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in often.items() if v}


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('word ', cast(1 + id % 9 AS int)) AS text",
                                          "concat('s', id % 3) AS source")
    sums = mixing.mix(docs).groupBy("target").sum("taken").collect()
    assert all(abs(r[1] / r[0] - 1) < 0.03 for r in sums)


def test_wordless_and_empty(spark):
    rows = mixing.mix(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
    assert mixing.mix(frame(spark, [])).collect() == [] == mixing.emit_mix(frame(spark, [])).collect()
