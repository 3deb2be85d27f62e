"""Repeated 200-byte strings by run-length indexes: bytes are marked that lie in a string which starts elsewhere too.

Strings that are equal choose the same anchor, the gram of least hash within them, so a text falls into pieces whose windows
share an anchor, and only pieces of one anchor can repeat each other. Anchors that occur once are dropped from
keys alone. The pieces of the others go, by anchor, to tasks that build run-compressed Burrows-Wheeler
transforms of them and stream the matching statistics from the samples at their run ends.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postaudit.llm.common import salted_lookup
from postaudit.llm.features import powers
from postaudit.session import materialise

LENGTH = 200
GRAM = 32
PIECE = 1 << 22
"""Window starts of a text that are looked at together."""
INDEX_BYTES = 1 << 20
"""Bytes of an index, about."""
BUCKET_BYTES = 6 << 20
"""Bytes of pieces that one call holds, about."""
GROUP = 4096
"""An anchor with more different pieces is resolved by its windows' digests, which spread over all tasks."""


# ---------------------------------------------------------------- anchors


def running_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each window of `width` keys, from running minima of blocks in both directions."""
    n = len(keys)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (first window, last window, anchor's hash) of a text's pieces, for a stretch of the text at a time."""
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        part = raw[at:at + PIECE + length - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        size = len(part) - gram + 1
        hashes = (total[gram:] - total[:size]) * down[:size] * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
        keys = (hashes & ~low) | np.arange(size, dtype=np.uint64)  # of equal grams the first
        chosen = (running_least(keys, length - gram + 1) & low).astype(np.int64)
        turn = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        first, last = np.concatenate([[0], turn]), np.concatenate([turn - 1, [len(chosen) - 1]])
        yield first + at, last + at, hashes[chosen[first]].view(np.int64)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# ---------------------------------------------------------------- the index


@dataclass
class RunIndex:
    """A run-compressed transform of strings, each ended by a mark of its own: `heads` and `lengths` of the runs, and the
    text positions sampled at the first and last row of each run. `names` numbers the strings of `depth`
    symbols that start at each position."""

    text: np.ndarray
    heads: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    last: np.ndarray
    names: np.ndarray
    depth: int

    def matches(self, least: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, position, length) of matches of `least` or more that can't be extended to the left.

        Within a run the row above a suffix is that of its left extension, so the statistics of all other
        positions follow from the samples where runs meet: one less for each position to the right.
        """
        a, b, last = self.first[1:], self.last[:-1], len(self.text) - 1
        for step in {0, max(0, least - self.depth)}:  # names of parts that overlap tell which samples agree so far
            good = self.names[np.minimum(a + step, last)] == self.names[np.minimum(b + step, last)]
            a, b = a[good], b[good]
        size = np.zeros(len(a), np.int64)
        for at in range(0, len(a), 2048):
            x, y, steps = a[at:at + 2048], b[at:at + 2048], np.arange(longest)
            left, right = (self.text[np.minimum(p[:, None] + steps, last)] for p in (x, y))
            ends = (left != right) | (left == 0)
            size[at:at + 2048] = np.where(ends.any(axis=1), ends.argmax(axis=1), longest)
        good = size >= least
        return a[good], b[good], size[good]


def build_index(strings: list[bytes], least: int = LENGTH) -> RunIndex:
    """Sort all suffixes by doubling prefixes, then keep only the runs."""
    sizes = np.array([len(s) for s in strings])
    n, starts = int(sizes.sum()) + len(strings), np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    text[starts[1:] - 1] = 0
    ends, places = np.repeat(starts[1:] - 1, sizes + 1), np.arange(n)
    bits = max(1, (n - 1).bit_length())
    keys, depth, names = np.zeros(n, np.int64), 4, (np.zeros(n, np.int64), 0)
    for k in range(depth):
        keys = keys * 512 + np.where(places + k < ends, text[np.minimum(places + k, n - 1)], 0)
    # Keys carry their position in the low bits: one plain sort, and tails that are equal stay in the strings' order.
    while True:
        if max(int(keys.max()).bit_length(), 1) + bits < 64:
            both = np.sort(keys << bits | places)
            order, sorted_keys = both & ((1 << bits) - 1), both >> bits
        else:
            order = np.argsort(keys, kind="stable")
            sorted_keys = keys[order]
        step = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if depth <= least:
            names = rank, depth
        if depth > sizes.max() or step[-1] == n - 1:
            break
        ahead = places + depth
        keys = rank * (n + 1) + np.where(ahead <= ends, rank[np.minimum(ahead, n - 1)] + 1, 0)
        depth *= 2
    starting = np.zeros(n, bool)
    starting[starts[:-1]] = True
    before = np.where(starting[order], -1 - order, text[order - 1])  # a string's start follows a mark of its own
    edge = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    final = np.concatenate([edge[1:], [n]]) - 1
    return RunIndex(text.astype(np.int16), before[edge], final - edge + 1, order[edge], order[final], *names)


def repeated(strings: list[bytes], often: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each of the (different) strings the byte ranges that repeat, given how often each string occurs."""
    index = build_index(strings, length)
    a, b, size = index.matches(length, max(map(len, strings)))
    change = np.zeros(len(index.text) + 1, np.int64)
    for place in (a, b):
        np.add.at(change, place, 1)
        np.add.at(change, place + size, -1)
    starts = np.cumsum([0, *(len(s) + 1 for s in strings)])
    for at, s, n in zip(starts, strings, often):
        if n > 1:
            change[at] += 1
            change[at + len(s)] -= 1
    inside = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    owner = np.searchsorted(starts, edges[::2], side="right") - 1
    for i, low, high in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
        out[i].append((low - int(starts[i]), high - int(starts[i])))
    return out


def join_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


# ---------------------------------------------------------------- Spark


def _key(text):
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """One row for each different text: key, rep_id (a row that has it), copies, n_bytes, sha, anchors (each once), twice (those
    that occur again in the text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                raw = utf8(text)
                found = [h for _, _, h in anchors(np.frombuffer(raw, np.uint8), length)]
                once, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
                rows.append((len(raw), hashlib.sha256(raw).digest(), once, n > 1))
            made = pd.DataFrame(rows, columns=["n_bytes", "sha", "anchors", "twice"])
            yield pd.concat([batch[["key", "doc_id"]].reset_index(drop=True), made], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(_key(F.col("text")).alias("key"), "doc_id", "text").mapInPandas(
        run, f"key binary, doc_id {kind}, n_bytes long, sha binary, anchors array<long>, twice array<boolean>")
    one = F.min(F.struct("n_bytes", "sha", "anchors", "twice")).alias("one")  # equal for all copies
    return rows.groupBy("key").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), one).select(
        "key", "rep_id", "copies", "one.*")


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    """anchor, piece, key, starts: the different pieces of each text at its repeated anchors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, wanted in zip(batch["key"], batch["text"], batch["anchors"]):
                raw, found = utf8(text), {}
                wanted = np.sort(np.asarray(wanted, np.int64))
                for first, last, hashes in anchors(np.frombuffer(raw, np.uint8), length):
                    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                    for i in np.flatnonzero(wanted[at] == hashes):
                        piece = raw[first[i]:last[i] + length]
                        found.setdefault((int(hashes[i]), piece), []).append(int(first[i]))
                rows += [(h, piece, key, starts) for (h, piece), starts in found.items()]
            yield pd.DataFrame(rows, columns=["anchor", "piece", "key", "starts"])

    return texts.mapInPandas(run, "anchor long, piece binary, key binary, starts array<long>")


def _indexed(pieces: DataFrame, length: int) -> DataFrame:
    """anchor, sha, lows, highs of the repeated ranges of pieces (anchor, piece, n), by indexes of whole anchors."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("anchor", kind="stable")
        hashes, texts, often = part["anchor"].to_numpy(), [bytes(p) for p in part["piece"]], part["n"].tolist()
        out, start, size = [], 0, 0
        for i in range(len(part) + 1):
            whole = i == len(part) or (i > start and hashes[i] != hashes[i - 1])
            if whole and i > start and (i == len(part) or size >= INDEX_BYTES):
                for k, ranges in enumerate(repeated(texts[start:i], often[start:i], length), start):
                    if ranges:
                        lows, highs = zip(*ranges)
                        out.append((hashes[k], hashlib.md5(texts[k]).digest(), lows, highs))
                start, size = i, 0
            size += len(texts[i]) if i < len(part) else 0
        return pd.DataFrame(out, columns=["anchor", "piece_key", "lows", "highs"])

    return pieces.groupBy("bucket").applyInPandas(run, "anchor long, piece_key binary, lows array<int>, highs array<int>")


def _by_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different pieces: windows meet by digest, wherever they come from."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for anchor, piece, n in zip(batch["anchor"], batch["piece"], batch["n"]):
                piece = bytes(piece)
                own = [hashlib.md5(piece[i:i + length]).digest() for i in range(len(piece) - length + 1)]
                yield pd.DataFrame({"anchor": anchor, "piece_key": [hashlib.md5(piece).digest()] * len(own), "n": n,
                                    "low": range(len(own)), "window": own})

    rows = pieces.select("anchor", "piece", "n").mapInPandas(run, "anchor long, piece_key binary, n long, low int, window binary")
    often = rows.groupBy("window").agg(F.sum("n").alias("all")).filter("all > 1").select("window")
    met = rows.join(often, "window", "left_semi").groupBy("anchor", "piece_key").agg(F.collect_list("low").alias("lows"))
    return met.withColumn("highs", F.transform("lows", lambda x: x + length))


def mark_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP, folder: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null an empty one. A byte is removed if a string of `length` bytes that covers it also
    starts at another place in any text, its own included; overlapping strings count, and strings are judged on
    the input. Repeated rows are copies of each other, so all of a text that occurs twice goes if it is
    `length` bytes or longer. No rows in, no rows out; other columns are not read.
    """
    texts = materialise(_anchored(docs, length), folder)
    own = texts.select("key", "rep_id", F.explode(F.arrays_zip("anchors", "twice")).alias("a")).select(
        "key", "rep_id", F.col("a.anchors").alias("anchor"), F.col("a.twice").cast("int").alias("twice"))
    often = own.groupBy("anchor").agg(F.sum(1 + F.col("twice")).alias("places")).filter("places > 1").select("anchor")
    wanted = own.join(often, "anchor").groupBy("key", "rep_id").agg(F.collect_list("anchor").alias("anchors"))
    rows = docs.select(_key(F.col("text")).alias("key"), F.col("doc_id").alias("row_id"), "text")
    same = (rows["key"] == wanted["key"]) & rows["row_id"].eqNullSafe(wanted["rep_id"])
    chosen = materialise(rows.join(wanted, same).select(rows["key"], "text", "anchors"), folder)
    parts = _pieces(chosen, length)
    pieces = parts.groupBy("anchor", "piece").agg(F.sum(F.size("starts")).alias("n"), F.min("key").alias("one"))
    pieces = materialise(pieces.select("anchor", "piece", "n"), folder)
    large = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).filter(F.col("different") > group)
    size = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    large = materialise(large.select("anchor"), folder)
    small = pieces.join(large, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    found = _indexed(small, length).unionByName(_by_windows(pieces.join(large, "anchor", "left_semi"), length))
    lookup = pieces.select("anchor", F.unhex(F.md5("piece")).alias("piece_key"), "n").join(found, ["anchor", "piece_key"])
    lookup = materialise(lookup, folder)
    refs = _pieces(chosen, length).select("anchor", F.unhex(F.md5("piece")).alias("piece_key"), "key", "starts")
    met = salted_lookup(refs, lookup, ["anchor", "piece_key"], "n", F.col("key"), "inner")
    spans = met.groupBy("key").agg(F.collect_list(F.struct("starts", "lows", "highs")).alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, found in zip(batch["key"], batch["text"], batch["found"]):
                ranges = join_ranges([(s + int(a), s + int(b)) for f in found for s in map(int, f["starts"])
                                      for a, b in zip(f["lows"], f["highs"])])
                raw, at, kept = utf8(text), 0, hashlib.sha256()
                for low, high in ranges:
                    kept.update(raw[at:low])
                    at = high
                kept.update(raw[at:])
                out.append((key, sum(b - a for a, b in ranges), len(ranges), kept.digest()))
            yield pd.DataFrame(out, columns=["key", "removed", "spans", "kept"])

    cut = chosen.select("key", "text").join(spans, "key").mapInPandas(run, "key binary, removed long, spans long, kept binary")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    zero, empty = F.lit(0).cast("long"), F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    cut = cut.groupBy("key").agg(F.max("removed").alias("removed"), F.max("spans").alias("spans"), F.max("kept").alias("kept"))
    every = materialise(texts.join(cut, "key", "left").select(
        "key", "copies", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("kept", "sha")).alias("kept")), folder)
    ids = docs.select("doc_id", _key(F.col("text")).alias("key"))
    return salted_lookup(ids, every, ["key"], "copies", F.col("doc_id"), "inner").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
