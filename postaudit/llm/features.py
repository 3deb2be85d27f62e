"""Hashed n-grams of texts, as arrays of bucket numbers, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postaudit.llm.common import SPACE, word_bounds

PIECE = 1 << 22
"""Longer texts are taken in pieces cut at white space; n-grams don't cross a cut."""

_MIX = np.uint32(2654435769)
_PRIME = 0x100000001B3
_ONE, _INVERSE = np.uint64(_PRIME), np.uint64(pow(_PRIME, -1, 1 << 64))
_powers: list[np.ndarray] = []


def raw_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def pieces(raw: np.ndarray, limit: int = PIECE) -> Iterator[np.ndarray]:
    start = 0
    while len(raw) - start > limit:
        gaps = np.flatnonzero(SPACE[raw[start:start + limit]])
        end = start + (int(gaps[-1]) + 1 if len(gaps) else limit)
        yield raw[start:end]
        start = end
    yield raw[start:]


def grams(codes: np.ndarray, n: int, seed: int, bits: int) -> np.ndarray:
    """A bucket for each run of n codes."""
    if len(codes) < n:
        return np.empty(0, np.uint32)
    wide, size = codes.astype(np.uint32), len(codes) - n + 1
    made = np.full(size, seed, np.uint32)
    for k in range(n):
        made = made * np.uint32(0x01000193) + wide[k:k + size]
    made ^= made >> np.uint32(15)
    return (made * _MIX) >> np.uint32(32 - bits)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_ONE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one running sum over the bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    made = (total[ends] - total[starts]) * down[starts] * np.uint64(0x9E3779B97F4A7C15)
    made ^= made >> np.uint64(31)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    return made ^ (made >> np.uint64(29))


# ---------------------------------------------------------------- languages

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 256)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def subwords(raw: np.ndarray, bits: int, sizes=(2, 3, 4)) -> np.ndarray:
    """Buckets of the byte n-grams within words, where a word's edge counts as a byte and what is no letter as an edge."""
    low = _LETTERS[np.concatenate([[0x20], raw, [0x20]])]
    edge, out = low == 0x20, []
    for n in sizes:
        made = grams(low, n, n, bits)
        inner = ~(edge[:len(made)] & edge[n - 1:n - 1 + len(made)]) if n == 2 else np.ones(len(made), bool)
        for k in range(1, n - 1):
            inner &= ~edge[k:k + len(made)]
        out.append(made[inner])
    return np.concatenate(out)


# ---------------------------------------------------------------- quality

_SHAPES = np.arange(256, dtype=np.uint8)  # marks stand for themselves
_SHAPES[0x61:0x7B] = 0x61
_SHAPES[0x41:0x5B] = 0x41
_SHAPES[0x30:0x3A] = 0x30
_SHAPES[0x80:] = 0x80


def indicators(raw: np.ndarray, bits: int) -> np.ndarray:
    """Buckets, each once, of a text's n-grams: bytes, byte shapes, words and which words repeat the one before."""
    present = np.zeros(1 << bits, bool)
    for part in pieces(raw):
        starts, ends = word_bounds(part)
        words = word_hashes(part, starts, ends)
        same = (words[1:] == words[:-1]).astype(np.uint8)
        shift = np.uint64(64 - bits)
        present[grams(part, 3, 11, bits)] = True
        present[grams(_SHAPES[part], 4, 12, bits)] = True
        present[words >> shift] = True
        present[(words[1:] * np.uint64(3) + words[:-1]) >> shift] = True
        for n in (1, 2, 3):
            present[grams(same, n, 20 + n, bits)] = True
    return np.flatnonzero(present)


# ---------------------------------------------------------------- samples


def remainder(doc_id):
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id):
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def labelled_sample(rows: DataFrame, per_label: int, most: int) -> DataFrame:
    """Up to `per_label` rows (doc_id, label) of each label and `most` in all, in order of a hash of the id.

    Only ids that are not held out and have a label count. The bounds make the result safe to broadcast. Rows are
    first thinned by a threshold on that hash which leaves about twice the rows wanted of a label, so no task
    ranks all rows of a label. Repeated rows count each; where a few ids make up a label's rows, fewer rows may be left.
    """
    rows = rows.filter((remainder(F.col("doc_id")) != 1) & F.col("label").isNotNull()).select("doc_id", "label")
    key = F.xxhash64("doc_id", F.lit(7))
    order = [key, F.col("doc_id")]
    # Every label's first row comes before any second one, so labels beyond the first `most` have no place.
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("of")).orderBy("label").limit(most)
    share = key.cast("double") / 2.0**64 + 0.5
    rows = rows.join(F.broadcast(sizes), "label").filter(share <= (2 * per_label + 200) / F.col("of")).drop("of")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(*order)))
    return (ranked.filter(F.col("place") <= per_label).orderBy("place", "label", *order).limit(most)
            .select("doc_id", "label"))


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """label and text of the sample's rows; of rows that share an id the one with the smallest text hash."""
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return met.withColumn("one", one).filter("one = 1").select("label", "text")
