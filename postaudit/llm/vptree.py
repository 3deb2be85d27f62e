"""Exact and relaxed nearest neighbours by inner product: a vantage-point tree in each shard of the vectors."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postaudit.session import materialise

SHARD = 8192
"""Vectors of a shard, about."""
LEAF = 256
BLOCK = 512
"""Queries that walk a tree together."""
WAVE = 32
"""Blocks that meet a copy of a tree in one task."""
SLACK = 1e-7
"""Relative rounding that the search allows for; what it returns is scored and ordered exactly."""


# ---------------------------------------------------------------- one tree


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict:
    """A vantage-point tree over unit-free vectors, lifted so that a larger inner product is a smaller distance.

    With M the longest norm, x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0); then |x' - q'|^2 is
    M^2 + |q|^2 - 2 x.q, a true metric, which the triangle inequality needs. Nodes are rows of flat arrays:
    vantage vector, split radius, inner and outer child; a negative child is a leaf's span of the vectors.
    """
    square = np.einsum("ij,ij->i", vectors, vectors)
    top = square.max() if len(ids) else 0.0
    lifted = np.column_stack([vectors, np.sqrt(np.maximum(top - square, 0))])
    order, nodes, leaves = np.arange(len(ids)), [], []

    def grow(low: int, high: int) -> int:
        if high - low <= leaf:
            leaves.append((low, high))
            return -len(leaves)
        part = order[low:high]
        far = lifted[part] - lifted[part[0]]
        far = np.sqrt(np.einsum("ij,ij->i", far, far))
        vantage = int(part[far.argmax()])  # a point at the edge splits better than one amid the others
        gap = lifted[part] - lifted[vantage]
        gap = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        middle = (high - low) // 2
        ranks = np.argpartition(gap, middle)
        order[low:high] = part[ranks]
        radius, at = float(gap[ranks[middle]]), len(nodes)
        nodes.append(None)
        inner, outer = grow(low, low + middle), grow(low + middle, high)
        nodes[at] = (vantage, radius, inner, outer)
        return at

    root = grow(0, len(ids)) if len(ids) else None
    return {"ids": ids[order], "vectors": vectors[order], "top": top, "root": root, "leaves": leaves,
            "nodes": [(lifted[v], r, i, o) for v, r, i, o in nodes]}


def search(tree: dict, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, ...]:
    """Arrays (query, id, score) of each query's k nearest in the tree but itself, best first, ties to smaller ids.

    A half of a node is skipped when the query's distance from the splitting sphere, times `factor`, exceeds the
    distance of its k-th best so far: with factor 1 no neighbour can be lost, a larger one skips more.
    """
    n, (vectors, ids, top) = len(queries), (tree["vectors"], tree["ids"], tree["top"])
    size = np.einsum("ij,ij->i", queries, queries)
    slack = SLACK * (1 + np.sqrt(top * size))
    scores = np.full((n, k), -np.inf)  # ascending, so the k-th best comes first
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reach(rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(top + size[rows] - 2 * scores[rows, 0], 0) + slack[rows])

    def look(rows: np.ndarray, low: int, high: int) -> None:
        near = queries[rows] @ vectors[low:high].T
        near[ids[None, low:high] == own[rows, None]] = -np.inf
        both = np.concatenate([scores[rows], near], axis=1)
        scores[rows] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        at, place = np.nonzero((near >= scores[rows, :1] - slack[rows, None]) & (near > -np.inf))
        hits.append((rows[at], place + low, near[at, place]))

    def walk(node: int, rows: np.ndarray) -> None:
        if node < 0:
            look(rows, *tree["leaves"][-node - 1])
            return
        vantage, radius, inner, outer = tree["nodes"][node]
        gap = np.sqrt(np.maximum(size[rows] + top - 2 * (queries[rows] @ vantage[:-1]), 0))
        for inside, first, second in ((True, inner, outer), (False, outer, inner)):  # each query's nearer half first
            mine, apart = rows[(gap < radius) == inside], np.abs(gap - radius)[(gap < radius) == inside]
            if len(mine):
                walk(first, mine)
                left = mine[apart * factor <= reach(mine)]
                if len(left):
                    walk(second, left)

    if tree["root"] is not None and n:
        walk(tree["root"], np.arange(n))
    if not hits:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    rows, place, rough = map(np.concatenate, zip(*hits))
    good = rough >= scores[rows, 0] - slack[rows]
    rows, place = rows[good], place[good]
    exact = np.zeros(len(rows))
    for d in range(vectors.shape[1]):  # in order of the components, so equal vectors have equal scores
        exact += vectors[place, d] * queries[rows, d]
    order = np.lexsort((ids[place], -exact, rows))
    rows, place, exact = rows[order], place[order], exact[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return own[rows[keep]], ids[place[keep]], exact[keep]


# ---------------------------------------------------------------- Spark


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is neither null, empty, zero nor holding null or non-finite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.filter(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0))


def build_trees(vectors: DataFrame, shards: int, leaf: int = LEAF, folder: str | None = None) -> DataFrame:
    """(size, shard, tree) for each shard of `vectors` (vec_id, size, vec); dealt by hash of the id, so none is hot."""
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        made = build(part["vec_id"].to_numpy(np.int64), np.array(part["vec"].tolist(), np.float64), leaf)
        return pd.DataFrame({"size": [int(key[0])], "shard": [int(key[1])], "tree": [pickle.dumps(made, protocol=5)]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("size", "shard").applyInPandas(run, "size int, shard int, tree binary"), folder)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0, shard: int = SHARD, leaf: int = LEAF,
            folder: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` (vec_id, embedding) with the largest inner product
    with each row whose id is divisible by `every`, itself left out.

    The query set meets all rows in blocks: waves of blocks of queries go to each shard's tree, whose best k each
    are merged. Vectors that are null, empty, zero or hold null or non-finite components and rows without an id take no
    part; vectors of different lengths do not meet. Of rows that share an id the one with the smallest vector counts.
    With fewer candidates than k all are returned. Factor 1 is exact; a larger one is faster and may miss some.
    """
    rows = usable(vectors.filter("vec_id IS NOT NULL"), "embedding").groupBy("vec_id").agg(
        F.min(F.col("embedding").cast("array<double>")).alias("vec"))
    rows = materialise(rows.select(F.col("vec_id").cast("long"), F.size("vec").alias("size"), "vec"), folder)
    shards = max(1, math.ceil(rows.count() / shard))
    queries = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    waves = math.ceil(blocks / WAVE)
    trees = build_trees(rows, shards, leaf, folder).withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    packed = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
              .groupBy("size", "block").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("vec").alias("vecs")))
    sent = (materialise(packed, folder).withColumn("wave", (F.col("block") % waves).cast("int"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for blob in right["tree"]:
            tree = pickle.loads(blob)
            for ids, vecs in zip(left["ids"], left["vecs"]):
                points = np.array([np.asarray(v, np.float64) for v in vecs])
                parts.append(search(tree, points, np.asarray(ids, np.int64), k, factor))
        made = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), made)))

    keys = ["size", "shard", "wave"]
    found = sent.groupBy(keys).cogroup(trees.groupBy(keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
