"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import pytest

from postaudit.llm import phrases as P

SCHEMA = "doc_id LONG, lang STRING, text STRING, phrase INT, `a` STRING"


def plain(rows, least, longest, top, cover=100):
    langs = {}
    for _, lang, text, *_ in rows:
        counts = langs.setdefault(lang or "und", Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            for n in range(1, longest + 1):
                counts.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in langs.items():
        total = sum(c for w, c in counts.items() if len(w) == 1)
        some = {w: c for w, c in counts.items() if len(w) > 1 and c >= least}
        kept = []
        for w, a in some.items():
            inside = any(len(b) > len(w) and 100 * c >= cover * a and any(b[i:i + len(w)] == w for i in range(len(b)))
                         for b, c in some.items())
            if not inside:
                score, k = min((1000 * a * total // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
                kept.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total, -score))
    return sorted(out)


def corpus(rng, n):
    words = ["the", "Of", "and", "é", "Ärger", "x-y", "　wide", "tea", "cup", "of"]
    made = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "!?", " : "])
                       for _ in range(rng.randrange(0, 60)))
        made.append((i, rng.choice(["en", "de", None, "und"]), text, 0, "z"))
    return made


@pytest.mark.parametrize("least,longest,chunk,sample", [(5, 5, 1 << 20, 2), (12, 3, 200, 8), (3, 2, 60, 10 ** 6), (8, 5, 1, 1)])
def test_equals_plain_counting(spark, monkeypatch, least, longest, chunk, sample):
    rows = corpus(random.Random(least), 150)
    rows += [(None, None, None, 1, "q"), (7, "en", "", 1, "q"), (7, "en", "a b a b a b a b a b a b a b", 1, "q"),
             (900, "fr", "la la la la la la la la la la la la la la", 1, "q")] + [(901, "en", "same line here", 1, "q")] * 20
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(P.counted, "__defaults__", (0, None, None, chunk))
    got = P.collocations(docs, least, longest, 30, sample=sample)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain(
        rows, least, longest, 30)


def test_a_missed_phrase_opens_the_border_and_is_closed(spark):
    """Nothing is proposed, so every frequent phrase is a failure: one expansion finds them all."""
    rows = [(i, "en", "red green blue white black " * 3, 0, "") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("doc_id", "place")
    found, passes = P.frequent(docs, 20, 5, 10 ** 9)
    want = Counter()
    for _ in range(30):
        words = ("red green blue white black " * 3).split()
        for n in range(1, 6):
            want.update(" ".join(words[i:i + n]) for i in range(len(words) - n + 1))
    want[""] = 450
    assert passes == 2 and {r.phrase: r.f for r in found.collect()} == {w: c for w, c in want.items() if c >= 20}


def test_long_texts_without_separators(spark):
    text = " ".join(f"w{i % 13}" for i in range(40_000))
    docs = spark.createDataFrame([(1, "en", text, 0, "")], SCHEMA)
    rows = P.collocations(docs, 100, 5, 40).collect()
    assert sorted(tuple(r) for r in rows) == plain([(1, "en", text)], 100, 5, 40)


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_top_of_groups_in_rounds(spark):
    rows = spark.range(5000).selectExpr("'g' AS g", "id", "id % 7 AS v")
    got = P.top_of_groups(rows, "g", [rows["v"].desc(), rows["id"].asc()], 3, ["id"])
    assert sorted((r.rank, r.id) for r in got.collect()) == [(1, 6), (2, 13), (3, 20)]
