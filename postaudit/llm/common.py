"""What several corpus operators share: reading a table, joins that a hot key can't slow down, word ends."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOT_PARTS = 1000
"""A key holding more than one in so many rows is hot, so there are fewer hot keys than this."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_lookup(rows: DataFrame, found: DataFrame, keys: list[str], count: str, salt, how: str = "left") -> DataFrame:
    """Join `rows` to the one row of `found` that has their (non-null) keys; `count` there is the rows of a key.

    Rows of a hot key are dealt by `salt` to as many parts as keep each within 1/1000 of all rows, and
    only the hot keys' rows of `found` are copied. Those keys (under 1,000, by their definition) are the only
    thing broadcast; everything else is a plain join by key. `found` is read twice, so it should be a written table.
    """
    limit = max((found.agg(F.sum(count)).first()[0] or 0) / HOT_PARTS, 1000)
    parts = found.withColumn("parts_", F.greatest(F.ceil(F.col(count) / limit), F.lit(1)).cast("int"))
    hot = parts.filter("parts_ > 1").select(*keys, "parts_")
    dealt = (rows.join(F.broadcast(hot), keys, "left")
             .withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(salt), F.col("parts_")), F.lit(0)).cast("int")).drop("parts_"))
    copies = parts.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
    return dealt.join(copies, [*keys, "salt_"], how).drop("salt_")


FILTER_BITS = 1 << 27
"""Bits of a filter at most; it reaches tasks as up to 2^21 cells of 64 bits."""


def thinned(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`rows` without most of those whose `key` is not in `keys`; every other one stays.

    For use ahead of a join, so that rows without a partner don't move. `keys` has the column `key` and should be a written
    table. A bit that keys share costs a move and changes no result.
    """
    bits = min(FILTER_BITS, max(1 << 12, 1 << math.ceil(math.log2(16 * max(1, keys.count())))))
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    cells = keys.select(bit.alias("bit_")).groupBy(F.shiftright("bit_", 6).alias("cell_")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit_ % 64 AS INT))")).alias("bits_"))
    met = (F.col("own_cell_") == F.col("cell_")) & (F.expr("shiftright(bits_, CAST(own_bit_ % 64 AS INT)) & 1") == 1)
    marked = rows.withColumn("own_bit_", bit).withColumn("own_cell_", F.shiftright("own_bit_", 6))
    return marked.join(F.broadcast(cells), met, "left_semi").select(*rows.columns)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of a text's bytes."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def cut(sizes: np.ndarray, limit: int) -> list[slice]:
    """Runs of rows whose sizes sum to `limit` at most, or single larger rows."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            out.append(slice(start, i))
            start, total = i, 0
        total += n
    return [*out, slice(start, len(sizes))] if len(sizes) > start else out


def keep_rows(docs: DataFrame, kept: DataFrame, text_key) -> DataFrame:
    """The row of `docs` for each row of `kept` (doc_id, text_key; distinct), one of those that repeat both.

    Both steps need the rows by the same key, so texts move once.
    """
    of = lambda df, key: df.withColumn("none_", F.col("doc_id").isNull()).withColumn(
        "id_", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("key_", key)
    keys = ["id_", "none_", "key_"]
    found = of(docs, text_key).join(of(kept, F.col("text_key")).select(keys), keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(keys).orderBy("id_"))
    return found.withColumn("place_", place).filter("place_ = 1").select(*docs.columns)
