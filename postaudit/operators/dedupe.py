"""Keep-first removal of repeated posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from postaudit.session import materialise

POST_KEY = ("job_id", "tweet_id")
FILTER_BITS = 1 << 27
"""Bits of the filter of repeated keys, 16 MB in all."""


def keep_first(posts: DataFrame, keys: Sequence[str] = POST_KEY, order: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the first by `order`: file, member and place where the posts have them, then the text.

    The repeated keys are found from the key columns alone and kept as a filter of FILTER_BITS bits, so
    that each task sees which of its rows may have a copy. All other rows stay where they are; those that may are
    reduced, which moves their texts once. A bit that keys share costs such a move and changes no result. A row with
    a null in its key has no copies.
    """
    keys = list(keys)
    order = list(order or [c for c in ("path", "member", "pos", "created_at", "text") if c in posts.columns])
    place = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    repeated = posts.groupBy(*keys).count().filter("count > 1").select(place.alias("_place"))
    filled = materialise(repeated.groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")))
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    maybe = F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1
    whole = F.lit(True)
    for key in keys:
        whole &= F.col(key).isNotNull()
    # The filter is never larger than its bits, so it may be broadcast at any size of the input.
    marked = (posts.withColumn("_place", place).withColumn("_part", F.bitmap_bucket_number("_place"))
              .join(F.broadcast(filled), "_part", "left").withColumns({"_bit": bit, "_byte": byte})
              .withColumn("_maybe", F.coalesce(maybe & whole, F.lit(False))))
    copies = marked.filter("_maybe").select(*posts.columns)
    single = marked.filter("NOT _maybe").select(*posts.columns)
    return single.unionByName(_reduce(copies, keys, order))


def _reduce(posts: DataFrame, keys: list[str], order: Sequence[str]) -> DataFrame:
    """An aggregate and not a ranking window: every task first keeps its own best row, so a post
    copied a billion times sends one row per task instead of filling one task."""
    rest = [c for c in posts.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return posts.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*posts.columns)
