"""Embedding near-dedup by NN-descent: neighbour lists improved by neighbours of neighbours, until an audit finds enough."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postaudit.llm.common import salted_lookup
from postaudit.llm.graph import components
from postaudit.llm.vptree import usable
from postaudit.session import materialise

LEAST = 0.95
LIST = 8
"""Neighbours that a list begins with."""
LONGEST = 256
"""A list that is full of links at this length grows no more: its component's links are then counted in tiles."""
SEEDS = 3
"""Random partitions that the first lists come from."""
BUCKET = 256
"""Vectors of a part of such a partition, about."""
ROUNDS = 20
"""Most rounds; the audit usually ends them before."""
AUDIT = 1024
"""Vectors whose links are all looked up, as queries against all rows, to measure recall."""
RECALL = 0.98
TILE = 1024
"""Vectors that are compared with others in one go."""

_EDGES = "a long, b long, score double"


# ---------------------------------------------------------------- within tasks


def unit(vectors) -> np.ndarray:
    """Vectors of length one, in double precision."""
    made = np.array([np.asarray(v, np.float64) for v in vectors])
    if not len(made):
        return made.reshape(0, 0)
    made /= np.abs(made).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return made / np.sqrt(np.einsum("ij,ij->i", made, made))[:, None]


def best_of(near: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k[row] largest entries of each row, -inf left out."""
    most = min(int(k.max(initial=0)), near.shape[1])
    at = np.argpartition(-near, most - 1, axis=1)[:, :most] if 0 < most < near.shape[1] else np.tile(
        np.arange(near.shape[1]), (len(near), 1))
    scores = np.take_along_axis(near, at, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    at, scores = np.take_along_axis(at, order, 1), np.take_along_axis(scores, order, 1)
    rows, places = np.nonzero((np.arange(at.shape[1])[None, :] < k[:, None]) & (scores > -np.inf))
    return rows, at[rows, places]


def _tiles(part: pd.DataFrame, length, floor, fresh) -> pd.DataFrame:
    """Edges from each vector of `part` (id, vec) to the best `length` others, over its `floor` and with either one fresh."""
    ids, vectors, made = part["id"].to_numpy(np.int64), unit(part["vec"]), []
    for start in range(0, len(ids), TILE):
        rows = np.arange(start, min(start + TILE, len(ids)))
        near = vectors[rows] @ vectors.T
        near[np.arange(len(rows)), rows] = -np.inf
        near[(near <= floor[rows, None]) | ~(fresh[rows, None] | fresh[None, :])] = -np.inf
        at, columns = best_of(near, length[rows])
        made.append(pd.DataFrame({"a": ids[rows[at]], "b": ids[columns], "score": near[at, columns]}))
    return pd.concat(made)


def _seed(size: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        n = len(part)
        return _tiles(part, np.full(n, size), np.full(n, -np.inf), np.ones(n, bool))

    return run


def _meet(part: pd.DataFrame) -> pd.DataFrame:
    """The neighbours of one vector meet each other; of those met, a list has use for what is nearer than its last."""
    return _tiles(part, part["length"].to_numpy(np.int64), part["floor"].to_numpy(np.float64), part["fresh"].to_numpy(bool))


# ---------------------------------------------------------------- lists


def _side(seed: int, planes: int):
    """A column of the cell that a vector lies in: on which side of each random plane through the origin."""
    @F.pandas_udf("long")
    def side(vecs: pd.Series) -> pd.Series:
        made, widths = np.zeros(len(vecs), np.int64), vecs.map(len).to_numpy()
        for width in np.unique(widths) if planes else ():
            own = np.flatnonzero(widths == width)
            normal = np.random.default_rng([seed, int(width)]).standard_normal((int(width), planes))
            made[own] = (unit(vecs.iloc[own]) @ normal > 0) @ (1 << np.arange(planes))
        return pd.Series(made)

    return side


def first_lists(vectors: DataFrame, size: int, seeds: range, bucket: int, folder: str | None = None) -> DataFrame:
    """a, b, score: each vector's best `size` among those that random hyperplanes put in one part with it.

    `vectors` has id, vec and width. A part is cut by as many planes as leave `bucket` vectors on average, so a dense
    region may fill one far beyond that; such a part is dealt by hash to parts of bounded size, as lists only need a start.
    """
    total = vectors.count()
    planes = max(0, math.ceil(math.log2(max(1, total) / bucket)))
    found = None
    for seed in seeds:
        cells = materialise(vectors.select("id", "width", "vec", _side(seed, planes)("vec").alias("cell")), folder)
        loads = cells.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * bucket)).cast("int").alias("parts"))
        dealt = cells.join(loads, ["width", "cell"]).withColumn("deal", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")))
        made = dealt.groupBy("width", "cell", "deal").applyInPandas(lambda part: _seed(size)(part), _EDGES)
        found = made if found is None else found.unionByName(made)
    return found


def shortened(edges: DataFrame, lengths: DataFrame | None, size: int) -> DataFrame:
    """a, b, score, fresh, length: the best of each vector's edges, as many as its list is long; ties to smaller ids."""
    one = edges.groupBy("a", "b").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    if lengths is not None:
        one = one.join(lengths, "a", "left").withColumn("length", F.coalesce("length", F.lit(size)))
    else:
        one = one.withColumn("length", F.lit(size))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    most = LONGEST  # no list is longer; with a literal, tasks leave out the rest before they shuffle
    return one.withColumn("place", place).filter((F.col("place") <= most) & (F.col("place") <= F.col("length"))).drop("place")


def improved(vectors: DataFrame, lists: DataFrame, size: int) -> DataFrame:
    """Edges that a round of neighbour joins finds: the members of each vector's list, and those that list it, meet.

    Those that list a vector are taken in order of a hash, as many as its own list is long: a vector that a third of all
    rows list is met by as many as any other, in other rounds by others.
    """
    back = lists.select(F.col("b").alias("center"), F.col("a").alias("member"), "fresh")
    long = lists.select(F.col("a").alias("center"), "length").distinct()
    turn = F.row_number().over(Window.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("member", "center")))
    back = (back.withColumn("turn", turn).filter(F.col("turn") <= LONGEST).join(long, "center", "left")
            .filter(F.col("turn") <= F.coalesce("length", F.lit(size))).select("center", "member", "fresh"))
    near = lists.select(F.col("a").alias("center"), F.col("b").alias("member"), "fresh")
    met = near.unionByName(back).groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
    floors = lists.groupBy("a").agg(F.first("length").alias("length"), F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
    floors = floors.select(F.col("a").alias("member"), "length",
                           F.when(F.col("n") >= F.col("length"), F.col("last")).otherwise(F.lit(-2.0)).alias("floor"))
    full = (met.join(floors, "member", "left").join(vectors.select(F.col("id").alias("member"), "vec"), "member")
            .select("center", F.col("member").alias("id"), "fresh", "vec", F.coalesce("length", F.lit(size)).alias("length"),
                    F.coalesce("floor", F.lit(-2.0)).alias("floor")))
    some = full.withColumn("any", F.max("fresh").over(Window.partitionBy("center"))).filter("any").drop("any")
    return some.groupBy("center").applyInPandas(_meet, _EDGES)


# ---------------------------------------------------------------- audit and dense components


def audit_links(vectors: DataFrame, audit: int, least: float, folder: str | None = None) -> DataFrame:
    """(a, b): all links of up to `audit` vectors, the first in order of a hash, as queries against all rows in blocks."""
    some = vectors.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(audit).select("id", "vec").toPandas()
    groups = {}
    for width in sorted({len(v) for v in some["vec"]}):
        own = some[some["vec"].map(len) == width]
        groups[width] = (own["id"].to_numpy(np.int64), unit(own["vec"]))
    sent = vectors.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        for batch in batches:
            widths = batch["vec"].map(len).to_numpy()
            for width, (ids, queries) in sent.value.items():
                own = batch[widths == width]
                if len(own):
                    near, others = queries @ unit(own["vec"]).T >= least, own["id"].to_numpy(np.int64)
                    rows, columns = np.nonzero(near & (ids[:, None] != others[None, :]))
                    yield pd.DataFrame({"a": ids[rows], "b": others[columns]})

    return materialise(vectors.select("id", "vec").mapInPandas(run, "a long, b long"), folder)


def counted_in_tiles(members: DataFrame, tile: int, least: float) -> DataFrame:
    """id, links: how many rows each vector of `members` (root, size, id, vec, n) links to within its root, itself left out.

    A root's members are dealt to tiles and tiles meet in pairs, which give counts, never pairs of vectors.
    """
    tiles = F.ceil(F.col("size") / tile).cast("int")
    dealt = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("id", F.lit(5)), F.col("tiles")).cast("int"))
    sent = dealt.select("root", "id", "vec", "n", "tile", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
    sent = sent.select("root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "id", "vec", "n")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        here = (part["tile"] == part["low"].iloc[0]).to_numpy()
        ids, n, vectors = part["id"].to_numpy(np.int64), part["n"].to_numpy(np.int64), unit(part["vec"])
        right = np.flatnonzero(~here) if (~here).any() else np.flatnonzero(here)
        alike, left = not (~here).any(), np.flatnonzero(here)
        if not alike and (not len(left) or part["low"].iloc[0] == part["high"].iloc[0]):
            return pd.DataFrame({"id": [], "links": []})
        links = np.zeros(len(ids), np.int64)
        for start in range(0, len(left), TILE):
            rows = left[start:start + TILE]
            near = vectors[rows] @ vectors[right].T >= least
            if alike:
                near &= rows[:, None] != right[None, :]
            links[rows] += near @ n[right]
            if not alike:
                links[right] += n[rows] @ near
        return pd.DataFrame({"id": ids, "links": links})

    made = sent.groupBy("root", "low", "high").applyInPandas(run, "id long, links long")
    return made.groupBy("id").agg(F.sum("links").alias("links"))


# ---------------------------------------------------------------- the operator


def neighbour_lists(vectors: DataFrame, least: float = LEAST, size: int = LIST, longest: int = LONGEST, rounds: int = ROUNDS,
                    audit: int = AUDIT, recall: float = RECALL, seeds: int = SEEDS, bucket: int = BUCKET,
                    folder: str | None = None) -> tuple[DataFrame, float]:
    """a, b, score, length of the lists of `vectors` (id, width, vec), and the audited share of links that they hold.

    Rounds go on until they add under 1/1000 to the links, no list has grown and the audit finds `recall`; while it does not,
    another random partition adds to the lists. A list
    whose members are all links is saturated and becomes four times as long, up to `longest`; in an audit a
    saturated vector's missing links count as found, as they are counted in full afterwards.
    """
    wanted = audit_links(vectors, audit, least, folder)
    lists = materialise(shortened(first_lists(vectors, size, range(seeds), bucket, folder).withColumn("fresh", F.lit(True)), None, size), folder)
    links, share, turn = -1, 0.0, seeds
    for _ in range(rounds):
        per = lists.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length"), F.min("score").alias("last"))
        full = (F.col("n") >= F.col("length")) & (F.col("last") >= least)
        grown = (F.col("length") < longest) & full
        lengths = materialise(per.select("a", F.when(grown, F.least(F.col("length") * 4, F.lit(longest))).otherwise(
            F.col("length")).alias("length"), grown.alias("grown"), (full & ~grown).alias("settled")), folder)
        held = lists.filter(F.col("score") >= least).select("a", "b")
        settled = lengths.filter("settled").select("a")
        known = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        lost = wanted.join(known, ["a", "b"], "left_anti").join(settled, "a", "left_anti").join(
            settled.select(F.col("a").alias("b")), "b", "left_anti").count()
        share = 1 - lost / max(1, wanted.count())
        before, links = links, held.count()
        grew = not lengths.filter("grown").isEmpty()
        still = not grew and before >= 0 and links <= before * 1.001
        if still and share >= recall:
            break
        # A list that has grown meets all its neighbours anew.
        lists = lists.drop("length").join(lengths.select("a", "length", "grown"), "a").withColumn("fresh", F.col("fresh") | F.col("grown"))
        lists = materialise(lists.drop("grown"), folder)
        found = improved(vectors, lists, size)
        if still:  # lists that find nothing new are stuck: another partition brings vectors together anew
            found = found.unionByName(first_lists(vectors, size, range(turn, turn + 1), bucket, folder))
            turn += 1
        found = found.withColumn("fresh", F.lit(True))
        old = lists.select("a", "b", "score", F.lit(False).alias("fresh"))
        lists = materialise(shortened(old.unionByName(found), lengths.select("a", "length"), size), folder)
    return lists, share


def near_dedup(vectors: DataFrame, least: float = LEAST, size: int = LIST, longest: int = LONGEST, rounds: int = ROUNDS,
               audit: int = AUDIT, recall: float = RECALL, seeds: int = SEEDS, bucket: int = BUCKET, tile: int = TILE,
               folder: str | None = None) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Rows link at a cosine of `least` or more in double precision, whatever else they hold; those of equal vectors always
    do, and are one vector here that counts once per row. Rows that are null, empty, zero, hold null or non-finite components or have
    no id link with nothing; vectors of different lengths do not meet. component_id is the smallest vec_id reachable, kept says
    that it is the row's own (false for a null id). Links are those that the lists hold in either direction; where a
    list is full of links at its greatest length, its component's links are counted in tiles, all of them. No rows in, no rows out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    good = usable(rows.filter("vec_id IS NOT NULL"), "vec")
    one = good.groupBy("vec").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    one = materialise(one.select(F.size("vec").alias("width"), "vec", "first_id", "n"), folder)
    one = materialise(one.withColumn("id", F.monotonically_increasing_id()), folder)
    lists, _ = neighbour_lists(one.select("id", "width", "vec"), least, size, longest, rounds, audit, recall, seeds, bucket, folder)
    held = lists.filter(F.col("score") >= least)
    pairs = materialise(held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder)
    linked = materialise(components(pairs, folder), folder)
    weights = one.select(F.col("id").alias("b"), "n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = both.join(weights, "b").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "id")
    full = held.groupBy("a").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= longest).select(F.col("a").alias("node"))
    dense = linked.join(full, "node").select("root").distinct()
    sizes = linked.groupBy("root").agg(F.count(F.lit(1)).alias("size")).join(dense, "root")
    members = linked.join(sizes, "root").select("root", "size", F.col("node").alias("id")).join(one.select("id", "vec", "n"), "id")
    tiled = materialise(counted_in_tiles(members, tile, least), folder)
    rooted = one.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = (rooted.join(smallest, "root").join(listed, "id", "left").join(tiled.withColumnRenamed("links", "all"), "id", "left")
             .select("vec", "n", "component_id", (F.coalesce("all", "links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    found = materialise(found, folder)
    keyed = rows.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("vec"))).drop("vec")
    made = salted_lookup(keyed, found.withColumnRenamed("vec", "key"), ["key"], "n", F.col("vec_id"), "left")
    root = F.coalesce("component_id", "vec_id")
    return made.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), root.alias("component_id"),
                       F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"))
