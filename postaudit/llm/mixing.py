"""Mixing sources to target weights: targets from word counts, then whole and chance copies of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postaudit.llm.common import salted_lookup
from postaudit.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def words(text):
    """Number of words `[^\\x20\\x09-\\x0D]+`; a null text has none."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, n, source_size, target of each source of `sizes` (source, size).

    Sources in code-point order, null last, weigh `weights` in turn and share `share` of all words. A target stops
    at `cap` times its source's words and the excess goes to the others by weight until none is above: the full
    sources are those with the least words for their weight, so they are a prefix of that order, and
    the others get what is left by weight. The windows run over sources, one row each.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    sums = sums.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    left = (F.sum("source_size").over(everything) * F.lit(float(share))
            - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    weights_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = (sums.withColumn("left", left).withColumn("weights_left", weights_left)
              .withColumn("open", F.col("left") * F.col("weight") <= F.col("most") * F.col("weights_left"))
              .withColumn("place", F.row_number().over(order)))
    first = F.min(F.when(F.col("open"), F.col("place"))).over(everything)
    at = F.col("place") == F.col("first")
    ranked = (ranked.withColumn("first", first).withColumn("pool", F.max(F.when(at, F.col("left"))).over(everything))
              .withColumn("shares", F.max(F.when(at, F.col("weights_left"))).over(everything)))
    target = F.when(F.col("place") < F.col("first"), F.col("most").cast("double")).otherwise(
        F.col("weight") * F.col("pool") / F.col("shares"))
    full = F.when(F.col("first").isNull(), F.col("most").cast("double")).otherwise(target)
    return ranked.select("source", "n", "source_size", full.alias("target"))


def chance(doc_id, seed: str = SEED):
    """A number in [0, 1) that depends on the document's id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def _with_targets(rows: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """`rows` joined to their source's target; null sources match each other."""
    key = lambda df: df.withColumn("null_", F.col("source").isNull()).withColumn(
        "source_", F.coalesce("source", F.lit("")))
    right = key(found).select("null_", "source_", "n", "source_size", "target")
    return salted_lookup(key(rows), right, ["null_", "source_"], "n", F.col("doc_id"), "inner").select(
        *names, "source_size", "target")


def copies(doc_id, source_size, target, seed: str = SEED):
    """floor(rate) copies, and one more with the probability that is left."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return F.floor(rate) + (chance(doc_id, seed) < rate - F.floor(rate)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED,
        folder: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, copies, taken (size times copies).

    A null text has size 0; null is a source of its own, last in order; a source without words has target 0
    and takes no copies. Equal ids make equal decisions, so repeated rows are repeated alike. No rows in, no
    rows out. A document gets at most `cap` copies.
    """
    rows = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size")), folder)
    found = materialise(targets(rows, weights, share, cap), folder)
    joined = _with_targets(rows, found, ["doc_id", "size"])
    n = copies(F.col("doc_id"), F.col("source_size"), F.col("target"), seed)
    return joined.withColumn("copies", n).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED,
             folder: str | None = None) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as `mix` says, all its columns passed on."""
    rows = docs.select("source", words(F.col("text")).alias("size"))
    found = materialise(targets(rows, weights, share, cap), folder)
    inner = docs.select(F.struct("*").alias("doc_"), "doc_id", "source")
    n = copies(F.col("doc_id"), F.col("source_size"), F.col("target"), seed)
    often = _with_targets(inner, found, ["doc_", "doc_id"]).select(
        "doc_", F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
    return often.select(*[F.col("doc_").getField(c).alias(c) for c in docs.columns])
