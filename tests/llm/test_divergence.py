"""Source divergence against plain sums over all terms."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from postaudit.llm import divergence as D

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, item INT, `n` STRING"


def plain(rows, least, top):
    langs = {}
    for _, text, lang, source, *_ in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups, docs = langs.setdefault(lang or "", ({}, Counter()))
        groups.setdefault(source or "", Counter()).update(words)
        docs.update(set(words))
    out = []
    for lang, (groups, docs) in langs.items():
        kept = sorted(t for t, n in docs.items() if n >= least)
        v = len(kept)
        total = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        p = {s: {t: 1 + 10 ** 9 * (c[t] + 2) // (total[s] + 2 * v) for t in kept} for s, c in groups.items()}
        whole = {t: 1 + 10 ** 9 * (sum(c[t] for c in groups.values()) + 2) // (sum(total.values()) + 2 * v) for t in kept}
        price = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(price(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-price(p[s][t], whole[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > whole[t])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def corpus(rng, n):
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Éa", "日本", "x"]
    made = []
    for i in range(n):
        source = rng.choice(["s1", "s2", "s3", "s4", None, ""])
        bias = words[:8] if source == "s1" else words
        text = " ".join(rng.choice(bias) + rng.choice(["", ",", "7", "W"]) for _ in range(rng.randrange(0, 30)))
        made.append((i, text, rng.choice(["en", "de", None]), source, 0, "z"))
    return made


@pytest.mark.parametrize("segment,block,least", [(1 << 14, 32, 10), (4, 2, 3), (1, 1, 5), (7, 3, 1)])
def test_equals_plain_sums(spark, segment, block, least):
    rows = corpus(random.Random(segment), 160)
    rows += [(None, None, None, None, 1, ""), (3, "", "xx", "only", 1, ""), (4, "12 34", "yy", "a", 1, ""), (4, None, "yy", "b", 1, "")]
    rows += [(500, "same text same", "en", "s2", 1, "")] * 15
    got = D.audit(spark.createDataFrame(rows, SCHEMA), least, 4, segment, block)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, 4)


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 64), np.int64)
    counts[1, 5], counts[2, 5], counts[2, 60] = 2, 2, 9
    forest = D.Forest(counts)
    # One zero node a level, and one path each for the two changes.
    assert forest.sizes == [3, 3, 3, 3, 3, 3, 3]
    a, b, often = forest.met(0, 1)
    assert sorted(zip(forest.values[a].tolist(), forest.values[b].tolist(), often.tolist())) == [(0, 0, 63), (0, 2, 1)]
    assert forest.places(2).tolist() == [5, 60] and forest.places(0).tolist() == []


def test_padding_is_not_priced():
    forest = D.Forest(np.array([[1, 2, 3], [1, 2, 4]], np.int64))
    a, b, often = forest.met(0, 1)
    assert sorted(zip(forest.values[a].tolist(), forest.values[b].tolist(), often.tolist())) == [(1, 1, 1), (2, 2, 1), (3, 4, 1)]


def test_chances_are_exact():
    for total in (1, 7, 10 ** 6, 10 ** 12 + 39, 2 ** 53 - 1, 2 ** 60 + 1):
        counts = np.array([0, 1, 5, total // 3, max(0, total - 2)], np.int64)
        assert D.chances(counts, total).tolist() == [1 + 10 ** 9 * (int(c) + 2) // total for c in counts]


def test_very_long_text(spark, monkeypatch):
    text = "Alpha beta " * 30_000
    rows = [(i, text if i == 0 else "alpha gamma", "en", "a" if i % 2 else "b", 0, "") for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert D.term_counts(text.lower().encode()) == Counter({b"alpha": 30_000, b"beta": 30_000})
    monkeypatch.setattr(D, "PIECE", 1000)
    assert D.term_counts(text.lower().encode()) == Counter({b"alpha": 30_000, b"beta": 30_000})
    assert sorted(tuple(r) for r in D.audit(docs).collect()) == plain(rows, 10, 10)


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).count() == 0
