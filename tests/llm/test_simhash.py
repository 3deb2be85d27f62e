"""Fingerprints, pairs and components against plain Python."""

import random

import numpy as np
import pytest
import xxhash

from postaudit.llm import simhash


def plain_print(text):
    import re
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    pieces = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


TEXTS = [None, "", " \t\n", "One", "one", "Two words", "two\x0bwords", "a b c", "A  B\tC", "É é b c d", "é É b c d",
         "\x85 \xa0x　y z w", "long " * 30_000, "x" * 150_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_pieces_make_no_difference(monkeypatch):
    text = " ".join(f"w{i % 97} v{i}" for i in range(700))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 13)
    assert simhash.fingerprint(text) == whole == plain_print(text)


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("bucket", [2, 4096])
def test_components_of_fingerprints(spark, bucket):
    rng = random.Random(5)
    prints = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(25):
        chain = [rng.getrandbits(64)]
        for k in range(8):
            chain.append(near(rng, chain[-1], rng.choice([1, 3, 4])))
        prints += chain
    hub = rng.getrandbits(64)
    prints = list(dict.fromkeys(prints + [near(rng, hub, 2) for _ in range(120)]))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = simhash.close_edges(spark.createDataFrame([(p,) for p in signed], "fp long"), 3, bucket)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components(prints)
    mine = [got.get(p, p) for p in signed]
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "A b C"), (3, "One")]
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(copy)))
    rows += [(200 + i, " ".join(rng.choices(words, k=80))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, n int")
    got = simhash.near_dedup(docs).collect()
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    first = {}
    for (i, _), r in zip(rows, roots):
        first[r] = i if r not in first or first[r] is None else min(x for x in (first[r], i) if x is not None)
    want = sorted(((i, f"{p:016x}", first[r]) for (i, _), p, r in zip(rows, prints, roots)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(first.values()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_dedup(docs).collect() == [] == simhash.drop_near_copies(docs).collect()
