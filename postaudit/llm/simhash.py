"""SimHash near-dedup: 64-bit fingerprints, pigeonhole blocks, components of close fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postaudit.llm.common import keep_rows, salted_lookup
from postaudit.llm.graph import components
from postaudit.session import materialise

SHINGLE = 3
DISTANCE = 3
SEED = 42
BLOCKS = 6
"""Blocks of a fingerprint; two within `distance` bits share all but `distance` of them."""
FINE_BLOCKS = 16
"""Blocks for fingerprints in large buckets: what these leave free bounds a bucket by 2**12 values."""
BUCKET = 4096

_ONES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
PIECE = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words, no bits."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    last = max(1, n - shingle + 1)
    ends = (ends - 1)[min(shingle, n) - 1:]
    of, total, counts = xxhash.xxh64_intdigest, last, np.zeros(64, np.int64)
    for at in range(0, last, PIECE):  # very long texts in pieces
        pairs = zip(starts[at:min(at + PIECE, last)].tolist(), ends[at:at + PIECE].tolist())
        hashes = np.array([of(joined[a:b], seed) for a, b in pairs], "<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k:8 * k + 8] += np.bincount(hashes[:, k], minlength=256) @ _ONES
    return int(np.packbits((2 * counts > total), bitorder="little").view("<u8")[0])


def text_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, fp of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle, seed) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "fp": made})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, text_key long, fp long")


def masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks of the blocks that stay when `distance` of `blocks` near-equal blocks go."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    spans = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    made = [sum(kept) for kept in combinations(spans, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def tree(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges, one fewer than members, that join what is linked within a bucket."""
    rest, edges = prints, []
    while rest.size > 1:
        waiting, rest = [rest[0]], rest[1:]
        while waiting and rest.size:
            at = waiting.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                edges += [(at, x) for x in found]
                waiting += list(found)
                rest = rest[~near]
    return edges


def _keyed(prints: DataFrame, kept: list[int]) -> DataFrame:
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in kept])
    return prints.select("fp", F.posexplode(keys).alias("mask", "key"))


def _trees(buckets: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            edges = [e for prints in batch["prints"] for e in tree(np.asarray(prints, np.int64).view(np.uint64), distance)]
            yield pd.DataFrame(np.array(edges, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    met = buckets.groupBy("mask", "key").agg(F.collect_list("fp").alias("prints"))
    return met.filter(F.size("prints") > 1).select("prints").mapInPandas(run, "a long, b long")


def close_edges(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, folder: str | None = None) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of `prints` (distinct fp) linked by `distance` bits or fewer.

    Fingerprints meet by every choice of blocks that may agree. Buckets with up to `bucket` members are compared
    in place and give a tree, never all pairs. Members of larger ones meet again by finer blocks, where a
    bucket has no more than 2**12 possible members, so no bucket is ever large and none is cut.
    """
    keyed = _keyed(prints, masks(BLOCKS, distance))
    counts = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = materialise(keyed.join(counts, ["mask", "key"]), folder)
    large = met.filter(F.col("members") > bucket).select("fp").distinct()
    edges = _trees(met.filter(F.col("members") <= bucket), distance)
    return edges.unionByName(_trees(_keyed(large, masks(FINE_BLOCKS, distance)), distance))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET,
               folder: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (hex), component_id, fp, root, text_key.

    Words are split at ASCII white space and A-Z lower-cased; texts shorter than a shingle hash as a whole; null
    and wordless texts have fingerprint zero, which links like any other. component_id is the smallest doc_id
    that is reached (null only if a component has no id); repeated rows share it. No rows in, no rows out.
    """
    prints = materialise(fingerprints(docs, shingle), folder)
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), folder)
    linked = components(close_edges(distinct.select("fp"), distance, bucket, folder), folder)
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "n", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = materialise(rooted.join(smallest, "root").select("fp", "n", "root", "component_id"), folder)
    return salted_lookup(prints, found, ["fp"], "n", F.col("doc_id"), "inner").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "root", "text_key")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET,
                     folder: str | None = None) -> DataFrame:
    """`docs` with one row of each component, the one with the smallest doc_id; all columns are passed on."""
    report = near_dedup(docs, shingle, distance, bucket, folder)
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("stays")
    kept = report.groupBy("root").agg(stays).select("stays.doc_id", "stays.text_key")
    return keep_rows(docs, kept, text_key(F.col("text")))
