"""Phrase collocations: a sample proposes frequent phrases, full passes count them and their border until it is closed."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postaudit.session import materialise

LEAST = 100
LONGEST = 5
TOP = 2000
COVER = 100
"""A phrase goes if a longer candidate around it occurs in this many of 100 of its places."""
SAMPLE = 8
"""One document in so many proposes phrases; results don't depend on it."""
MARGIN = 0.6
"""What is proposed has this share of the count that a phrase of `least` occurrences is expected to have in the sample."""
CHUNK = 2 << 20
"""Bytes of text whose phrases a task counts at once."""
FILTER_BITS = 1 << 27
"""Most bits of a filter (16 MB); beyond 2**23 proposed phrases it lets more pass, which costs time and changes no result."""

_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_NEXT = {n: re.compile(rb"(?:[ \t]*[^ \t\n]+){0,%d}" % n) for n in range(1, 16)}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEPT = np.uint64(0xFFFFFFFFFFFF0000)  # 48 bits; phrases that share them only add to a border sum, which is an upper bound
_COUNTED = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


# ---------------------------------------------------------------- hashes and filters


def seed_of(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), 1)


def fold(seed: int, words: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases from the hashes of their first, second, ... words."""
    made = np.full(len(words[0]), seed, np.uint64)
    for word in words:
        made = (made ^ word) * _MIX
        made ^= made >> np.uint64(29)
    return made & _KEPT


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


@dataclass(frozen=True)
class Filter:
    """A Bloom filter of phrase hashes: never says no to a member."""

    cells: np.ndarray  # uint64

    @staticmethod
    def bits_for(members: int) -> int:
        return int(min(FILTER_BITS, max(1 << 12, 1 << math.ceil(math.log2(16 * max(1, members))))))

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        shift = np.uint64(64 - int(math.log2(bits)))
        return [(hashes * np.uint64(m)) >> shift for m in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, 64 * len(self.cells)):
            found &= (self.cells[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def make_filter(hashes: DataFrame) -> Filter:
    """The filter of `hashes` (h). Tasks set bits, which are merged by cell: only cells reach the driver."""
    bits = Filter.bits_for(hashes.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["h"].to_numpy(np.int64).view(np.uint64)
            at = np.unique(np.concatenate(Filter.places(own, bits)))
            one = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pd.DataFrame({"cell": (at >> np.uint64(6)).astype(np.int64), "bits": one})

    made = hashes.select("h").mapInPandas(run, "cell long, bits long")
    found = made.groupBy("cell").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    cells = np.zeros(bits // 64, np.uint64)
    cells[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return Filter(cells)


# ---------------------------------------------------------------- counting in a task


def parts(text: str, longest: int, limit: int) -> Iterator[tuple[bytes, bytes]]:
    """A text's lower-cased bytes, separators as newlines, in parts of about `limit`: (part, words that follow it).

    A part ends at a separator where there is one, so that nothing crosses its end; else at a space, and the next
    words are given for the phrases that begin in the part and end beyond it.
    """
    raw = text.encode("utf-8", "surrogatepass").lower().translate(_MARKS)
    start = 0
    while len(raw) - start > limit:
        end = raw.rfind(b"\n", start, start + limit) + 1
        if end:
            yield raw[start:end], b""
        else:
            spaces = [raw.rfind(s, start, start + limit) for s in (b" ", b"\t")]
            end = max(spaces)
            if end <= start:
                after = [x for x in (raw.find(s, start + limit) for s in (b" ", b"\t", b"\n")) if x >= 0]
                end = min(after, default=len(raw))
            yield raw[start:end], _NEXT[longest - 1].match(raw, end).group() if longest > 1 else b""
        start = end
    yield raw[start:], b""


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each key among the different ones, the first place of each of those, and how many they are."""
    codes, found = pd.factorize(keys)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return codes, first, len(found)


def count_phrases(raw: bytes, after: bytes, lang: str, lengths: range, known: int, proposed: Filter | None,
                  fresh: Filter | None) -> Iterator[tuple[np.ndarray, list[str] | None, np.ndarray]]:
    """(hashes, phrases or None, counts) of the phrases that begin in `raw`.

    A phrase of several words is looked at if it is held without its last and without its first word: by `proposed`, or,
    beyond `known` words, by having been looked at. So all that is proposed is counted, by its words, and its
    negative border by hash (by its words at the greatest length); every word belongs to one or the other. With `fresh`,
    only phrases in it or with a part in it are counted, all by their words, and all of those are held.
    """
    mark = raw.replace(b"\n", b" . ").split()  # a lone full stop can't be a word
    own = len(mark)
    mark += after.split()
    names = [b"."] + list(set(mark) - {b"."})
    place = dict(zip(names, range(len(names))))
    codes = np.fromiter(map(place.__getitem__, mark), np.int64, len(mark))
    del mark, place
    seed, hashes = seed_of(lang), np.array([word_hash(w) for w in names], np.uint64)
    at, rank, first, size = np.arange(len(codes)), codes, None, len(names)
    ok, new = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    for n in range(1, lengths.stop):
        if n == 1:
            words = np.arange(len(names))[:, None]
            hashed = fold(seed, [hashes])
            counts = np.bincount(codes[:own], minlength=size)
            counts[0] = 0
        else:
            at = np.flatnonzero(ok[:-1] & ok[1:])
            if not len(at):
                return
            inverse, first, size = distinct(rank[at] * len(names) + codes[at + n - 1])
            first = at[first]
            words = codes[first[:, None] + np.arange(n)]
            hashed = fold(seed, [hashes[words[:, k]] for k in range(n)])
            counts = np.bincount(inverse[at < own], minlength=size)
        held = proposed.has(hashed) if proposed and n <= known else np.full(size, n > 1)
        if fresh:
            part = fresh.has(hashed)
            if n > 1:
                part |= new[first] | new[first + 1]
            held |= part
            spoken, silent = part, np.zeros(size, bool)
        else:
            spoken = held & (n <= known) if lengths.start == 1 and proposed else np.zeros(size, bool)
            if proposed and n > known and n == lengths.stop - 1 and lengths.start == 1:
                spoken = np.ones(size, bool)
            silent = ~spoken
        if n in lengths:
            named = np.flatnonzero(spoken & (counts > 0))
            if len(named):
                phrases = [b" ".join([names[c] for c in row]).decode("utf-8", "surrogatepass") for row in words[named].tolist()]
                yield hashed[named], phrases, counts[named]
            rest = np.flatnonzero(silent & (counts > 0))
            if len(rest):
                yield hashed[rest], None, counts[rest]
            if n == 1 and not fresh:
                yield np.zeros(1, np.uint64), [""], counts.sum(keepdims=True)
        if n == 1:
            held[0] = False
            ok, rank = held[codes], codes
            new = part[codes] if fresh else new
        else:
            ok, rank = np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
            ok[at], rank[at] = held[inverse], inverse
            if fresh:
                new = np.zeros(len(codes), bool)
                new[at] = part[inverse]


def counted(docs: DataFrame, lengths: range, known: int = 0, proposed: Filter | None = None, fresh: Filter | None = None,
            chunk: int = CHUNK) -> DataFrame:
    """h, lang, phrase, f of what `count_phrases` counts in `docs` (lang, text); lang and phrase are null where only the
    hash is kept, and the row with phrase '' has all words of a lang.
    """
    sent = docs.sparkSession.sparkContext.broadcast((proposed, fresh))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size = 0

        def rows(lang: str, raw: bytes, after: bytes = b"") -> Iterator[pa.RecordBatch]:
            for hashed, phrases, counts in count_phrases(raw, after, lang, lengths, known, *sent.value):
                n = len(hashed)
                texts = [pa.array([lang] * n, pa.string()), pa.array(phrases, pa.string())] if phrases else [pa.nulls(n, pa.string())] * 2
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), *texts, pa.array(counts)], schema=_COUNTED)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, raws in waiting.items():
                yield from rows(lang, b"\n".join(raws))
            waiting.clear()

        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time leaves Arrow's memory
                lang = batch.column(0)[i].as_py()
                for part, after in parts(batch.column(1)[i].as_py(), lengths.stop - 1, chunk):
                    if after:
                        yield from rows(lang, part, after)
                        continue
                    waiting.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= chunk:
                        yield from flush()
                        size = 0
        yield from flush()

    made = docs.select("lang", "text").mapInArrow(run, "h long, lang string, phrase string, f long")
    return made.groupBy("lang", "phrase", "h").agg(F.sum("f").alias("f"))


# ---------------------------------------------------------------- mining


def propose(docs: DataFrame, least: int, longest: int, sample: int, folder: str | None = None) -> DataFrame:
    """(h) of what is frequent in the sample, up to longest - 1 words; whatever it misses, the passes mend."""
    some = docs.filter(F.pmod(F.xxhash64("place", "text"), F.lit(sample)) == 0)
    enough = F.col("f") >= max(1, math.ceil(MARGIN * least / sample))
    keep = lambda found: materialise(found.filter(F.col("phrase").isNull() & enough).select("h"), folder)
    found = keep(counted(some, range(1, 2)))
    if longest > 2:
        found = found.union(keep(counted(some, range(2, 3), 1, make_filter(found))))
    if longest > 3:
        found = found.union(keep(counted(some, range(3, longest), 2, make_filter(found))))
    return found


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE,
             folder: str | None = None) -> tuple[DataFrame, int]:
    """lang, phrase, f of every phrase of 1 to `longest` words with f >= `least`, exactly, and the full passes taken.

    `docs` has place, lang and text; the row with phrase '' has all words of a lang. The first full pass counts what the
    sample proposed and its negative border, which holds every other word. Border phrases are counted by hash, and a sum
    of `least` or more is a failure: it, and phrases around it that no pass has counted, may be frequent. A phrase that
    the first pass left out has a part that is held by nothing and whose own parts are all held: a failure, if the phrase is
    frequent. So one expansion over all phrases with a failure in them, by their words, closes the border.
    """
    first = make_filter(propose(docs, least, longest, sample, folder))
    enough = (F.col("f") >= least) | (F.col("phrase") == "")
    found = materialise(counted(docs, range(1, longest + 1), longest - 1, first).filter(enough), folder)
    failures = found.filter("phrase IS NULL").select("h")
    named = found.filter("phrase IS NOT NULL").select("lang", "phrase", "f")
    if failures.isEmpty():
        return named, 1
    more = counted(docs, range(1, longest + 1), longest - 1, first, make_filter(failures)).filter(F.col("f") >= least)
    # A phrase that both passes have counted by its words has the same total in both.
    both = named.unionByName(more.select("lang", "phrase", "f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    return materialise(both, folder), 2


def top_of_groups(rows: DataFrame, group: str, order: list, k: int, spread) -> DataFrame:
    """Each group's first k rows with their `rank`. A large group is cut in parts first, so no task sorts it whole."""
    left = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    while left > 50 * k:
        n = math.ceil(left / (25 * k))
        part = F.pmod(F.xxhash64(*spread), F.lit(n))
        rows = (rows.withColumn("part_", part)
                .withColumn("rank", F.row_number().over(Window.partitionBy(group, "part_").orderBy(*order)))
                .filter(F.col("rank") <= k).drop("rank", "part_"))
        left = n * k
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER,
                 sample: int = SAMPLE, folder: str | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first `top` phrases of 2 to `longest` words.

    A-Z are lower-cased, texts split at `[.,;:!?\\x0A-\\x0D]` and those pieces at spaces and tabs; phrases stay within
    pieces and their occurrences may overlap. a is a phrase's count, l and r those of the two sides of its lowest-scoring cut (of
    equal scores the leftmost), n the lang's words, score floor(1000*a*n/(l*r)) in decimals of 38 digits, which is
    exact up to 10**17 words or so. Phrases that lie in a longer candidate with nearly (`cover` percent) their count go. Ties
    are in order of the phrase. A null text is empty, a null lang is `und`; repeated rows count each; no rows in, or no phrase
    often enough, no rows out; texts of any length are taken in parts. Only doc_id, lang and text are read.
    """
    rows = docs.select(F.col("doc_id").alias("place"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce("text", F.lit("")).alias("text"))
    found, _ = frequent(rows, least, longest, sample, folder)
    words = found.filter("phrase = ''").select("lang", F.col("f").alias("words"))
    counts = found.filter("phrase <> ''").select("lang", "phrase", "f")
    several = counts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    several = several.withColumn("size", F.size("w")).filter("size > 1")
    inner = several.filter("size > 2").select("lang", "a", "w", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, size(w) - m + 1)")).alias("i"))
    around = (inner.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    hidden = F.coalesce(100 * F.col("longer").cast("decimal(24,0)") >= cover * F.col("a").cast("decimal(24,0)"), F.lit(False))
    kept = several.join(around, ["lang", "phrase"], "left").filter(~hidden).drop("longer")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    side = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", side(F.lit(1), F.col("k")).alias("head"),
                       side(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    of = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    scored = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"]).join(words, "lang")
    whole = lambda name: F.col(name).cast("decimal(19,0)")
    scored = scored.withColumn("above", (F.lit(1000).cast("decimal(19,0)") * whole("a") * whole("words")).cast("decimal(38,0)"))
    scored = scored.withColumn("below", (whole("l") * whole("r")).cast("decimal(38,0)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct(
        F.expr("above div below").alias("score"), "k", "a", "l", "r", F.col("words").alias("n"))).alias("best"))
    flat = materialise(best.select("lang", "phrase", "best.*"), folder)
    ranked = top_of_groups(flat, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, ["phrase"])
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
