"""Source divergence: hash-consed segment trees of term counts, walked in pairs that price equal node pairs once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postaudit.llm.common import salted_lookup
from postaudit.session import materialise

LEAST_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
SEGMENT = 1 << 14
"""Term ids of a segment, about: a task builds the trees' branches above one segment."""
BLOCK = 32
"""Groups of a block, about: a task holds the branches of two blocks."""
ENTRIES = 400_000
"""Different (group, term) that a counting task holds before it hands them on."""
PIECE = 1 << 22

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^a-z\x80-\xff]")


# ---------------------------------------------------------------- trees


class Forest:
    """Segment trees over the same term ids, one for each row of `counts` (groups x ids); equal subtrees are one node.

    The ids beyond the last are padded to a power of two with -1. Level 0 has the different counts, a node of a higher level
    is a pair of nodes of the level below. So a stretch of terms that two groups, or two places, have alike is one node.
    """

    def __init__(self, counts: np.ndarray) -> None:
        groups, size = counts.shape
        wide = 1 << max(0, size - 1).bit_length()
        padded = np.full((groups, wide), -1, np.int64)
        padded[:, :size] = counts
        self.values, ids = np.unique(padded, return_inverse=True)
        ids = ids.reshape(padded.shape)
        self.leaves = ids
        self.halves: list[tuple[np.ndarray, np.ndarray]] = []  # of each level from the first above the leaves
        self.sizes = [len(self.values)]
        while ids.shape[1] > 1:
            pairs, made = np.unique(ids[:, 0::2] * self.sizes[-1] + ids[:, 1::2], return_inverse=True)
            self.halves.append((pairs // self.sizes[-1], pairs % self.sizes[-1]))
            self.sizes.append(len(pairs))
            ids = made.reshape(groups, -1)
        self.roots = ids[:, 0]

    def met(self, one: int, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs of leaves that the trees of two groups have at the same ids, and how often each."""
        a, b, often = self.roots[[one]], self.roots[[other]], np.ones(1, np.int64)
        for (left, right), size in zip(reversed(self.halves), reversed(self.sizes[:-1])):
            keys = np.concatenate([left[a] * size + left[b], right[a] * size + right[b]])
            keys, at = np.unique(keys, return_inverse=True)  # equal node pairs go on as one
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([often, often]))
            a, b, often = keys // size, keys % size, total
        real = self.values[a] >= 0
        return a[real], b[real], often[real]

    def places(self, group: int) -> np.ndarray:
        """Ids where a group's count is over 0, found by leaving out subtrees that hold only zeros and padding."""
        empty, nodes, at = [self.values <= 0], self.roots[[group]], np.zeros(1, np.int64)
        for left, right in self.halves:
            empty.append(empty[-1][left] & empty[-1][right])
        for level in range(len(self.halves), 0, -1):
            left, right = self.halves[level - 1]
            live = ~empty[level][nodes]
            nodes, at = nodes[live], at[live]
            nodes, at = np.concatenate([left[nodes], right[nodes]]), np.concatenate([2 * at, 2 * at + 1])
        return np.sort(at[~empty[0][nodes]])


def chances(counts: np.ndarray, total: int, unit: int = UNIT) -> np.ndarray:
    """1 + floor(unit * (count + 2) / total), exactly: by long division in steps of a thousand."""
    if total >= 1 << 53:
        return np.array([1 + unit * (int(c) + 2) // int(total) for c in counts], np.int64)
    rest, made = counts.astype(np.int64) + 2, np.zeros(len(counts), np.int64)
    assert unit == 1000 ** 3
    made, rest = divmod(rest, total)
    for _ in range(3):
        digit, rest = divmod(rest * 1000, total)
        made = made * 1000 + digit
    return made + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


# ---------------------------------------------------------------- counting


def term_counts(raw: bytes) -> Counter:
    """Terms `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of lower-cased bytes; very long texts in pieces cut between terms."""
    found: Counter = Counter()
    start = 0
    while len(raw) - start > PIECE:
        gap = _OTHER.search(raw, start + PIECE)
        end = gap.start() if gap else len(raw)
        found.update(_TERM.findall(raw, start, end))
        start = end
    found.update(_TERM.findall(raw, start))
    return found


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of a term in a group's texts, and texts that have it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, texts) in held.items():
                names = [t.decode("utf-8", "surrogatepass") for t in n]
                yield pd.DataFrame({"lang": lang, "source": source, "term": pd.Series(names, dtype=object),
                                    "n": list(n.values()), "docs": [texts[t] for t in n]})
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                found = term_counts(text.encode("utf-8", "surrogatepass").lower())
                if not found:
                    continue
                n, texts = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(found)
                texts.update(found.keys())
                size += len(n) - before
                if size >= ENTRIES:
                    yield from flush()
                    size = 0
        yield from flush()

    made = docs.mapInPandas(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- the audit


def _walk(top: int):
    """What a task does with the branches of two blocks of groups over one segment."""
    def run(heads: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if heads.empty:  # a block that no group fell into
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("lang", "source", "part", "item", "value")})
        heads = heads.sort_values(["block", "place"]).reset_index(drop=True)
        size, v, lang_total = int(heads["size"].iloc[0]), int(heads["v"].iloc[0]), int(heads["lang_n"].iloc[0])
        lang, alike = heads["lang"].iloc[0], heads["low"].iloc[0] == heads["high"].iloc[0]
        row = {key: i for i, key in enumerate(zip(heads["block"], heads["place"]))}
        counts = np.zeros((len(heads) + alike, size), np.int64)
        terms = cells[cells["term"].notna()]
        mine = cells[cells["term"].isna()]
        at = np.array([row[key] for key in zip(mine["own"], mine["at"])], np.int64)
        counts[at, mine["pos"].to_numpy(np.int64)] = mine["n"].to_numpy(np.int64)
        if alike:
            counts[-1, terms["pos"].to_numpy(np.int64)] = terms["n"].to_numpy(np.int64)
        if not size:  # a lang without kept terms: every pair is equal
            counts = np.full((len(heads) + alike, 1), -1, np.int64)
        forest = Forest(counts)
        with_padding = np.maximum(forest.values, 0)
        chance = [chances(with_padding, int(n) + 2 * v) if v else with_padding for n in heads["n"]]
        block, names = heads["block"].to_numpy(), heads["source"].tolist()
        for i in range(len(heads)):
            for j in range(i + 1, len(heads)):
                if alike or block[i] != block[j]:
                    a, b, often = forest.met(i, j)
                    value = int((price(chance[i][a], chance[j][b]) * often).sum())
                    out += [(names[i], "pair", names[j], value), (names[j], "pair", names[i], value)]
        if alike and size:
            words = terms.set_index("pos")["term"]
            base = chances(with_padding, lang_total + 2 * v)
            for i in range(len(heads)):
                at = forest.places(i)
                pairs, met = np.unique(forest.leaves[i, at] * len(forest.values) + forest.leaves[-1, at], return_inverse=True)
                p, q = chance[i][pairs // len(forest.values)], base[pairs % len(forest.values)]
                value = np.where(p > q, price(p, q), -1)[met]  # each different pair of counts is priced once
                good = np.flatnonzero(value >= 0)
                best = good[np.lexsort((at[good], -value[good]))][:top]
                out += [(names[i], "term", words[int(at[k])], int(value[k])) for k in best]
        made = pd.DataFrame(out, columns=["source", "part", "item", "value"], dtype=object)
        made.insert(0, "lang", pd.Series([lang] * len(made), dtype=object))
        return made

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, segment: int = SEGMENT, block: int = BLOCK,
          folder: str | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: how far each group's (lang, source) term chances are from others'.

    A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased; a lang keeps those in at least
    `least_docs` of its texts (rows; repeated rows count each). Each group, and each lang as a whole, gives every kept term
    p = 1 + floor(10**9 * (count + 2) / (N + 2V)). Part `pair`: the sum of floor((p-q)**2 / (p+q)) over the kept terms for each
    other source of the lang, 0 if none is kept. Part `term`: the `top` terms that a group has and likes more than
    its lang. Ranks go by falling value, then by item; null text, lang and source are ''. A group without terms takes
    part; a lang's only source has no pair; no rows in, no rows out; texts of any length are read in pieces. Other columns
    are not read. All arithmetic is in whole numbers.

    The trees of a lang are cut into segments of term ids and groups into blocks: a task walks the trees of two blocks
    over one segment, which bounds its memory, and sums over segments give the roots' prices.
    """
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = docs.select(empty("lang"), empty("source"), empty("text"))
    counts = materialise(counted(rows), folder)
    groups = rows.select("lang", "source").distinct()
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / block).cast("int")
    groups = groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")).alias("place")
    groups = materialise(groups.select("lang", "source", "blocks", "block", place), folder)

    terms = (counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("q"),
                                                F.count(F.lit(1)).alias("in_groups"))
             .filter(F.col("docs") >= least_docs))
    terms = materialise(terms, folder)
    langs = groups.groupBy("lang").agg(F.first("blocks").alias("blocks"))
    vocabulary = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("q").alias("lang_n"))
    vocabulary = materialise(langs.join(vocabulary, "lang", "left").select(
        "lang", "blocks", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
        F.coalesce(F.ceil(F.col("v") / segment), F.lit(0)).cast("int").alias("segments")), folder)
    # A lang may have a third of all terms, and a term as many rows as there are groups: both lookups deal hot keys.
    placed = salted_lookup(terms, vocabulary.select("lang", "segments", "blocks", "v"), ["lang"], "v", F.col("term"), "inner")
    placed = placed.withColumn("seg", F.pmod(F.xxhash64("term"), F.col("segments")).cast("int"))
    in_order = F.row_number().over(Window.partitionBy("lang", "seg").orderBy("term")) - 1
    placed = materialise(placed.select("lang", "seg", "term", in_order.alias("pos"), "q", "in_groups", "blocks"), folder)
    spans = placed.groupBy("lang", "seg").agg(F.count(F.lit(1)).cast("int").alias("size"))
    own = materialise(salted_lookup(counts.select("lang", "source", "term", "n"), placed.select(
        "lang", "term", "seg", "pos", "in_groups"), ["lang", "term"], "in_groups", F.col("source"), "inner")
        .select("lang", "source", "seg", "pos", "n"), folder)
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("n"))

    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    heads = (groups.join(totals, ["lang", "source"], "left").join(vocabulary.drop("blocks"), "lang").join(spans, "lang", "left")
             .select("lang", zero("seg"), zero("size"), "v", "lang_n", "source", zero("n"), "block", "place", other)
             .select("lang", "seg", low, high, "size", "v", "lang_n", "source", "n", "block", "place"))
    numbered = groups.select("lang", "source", "blocks", F.col("block").alias("block"), F.col("place").alias("place"))
    cells = (own.join(numbered, ["lang", "source"]).select("lang", "seg", "pos", "n", "block", "place", other)
             .select("lang", "seg", low, high, F.col("block").alias("own"), F.col("place").alias("at"), "pos", "n",
                     F.lit(None).cast("string").alias("term")))
    none = F.lit(None).cast("int")
    whole = (placed.select("lang", "seg", "pos", "q", "term", F.explode(F.expr("sequence(0, blocks - 1)")).alias("low"))
             .select("lang", "seg", "low", F.col("low").alias("high"), none.alias("own"), none.alias("at"), "pos",
                     F.col("q").alias("n"), "term"))
    keys = ["lang", "seg", "low", "high"]
    made = heads.groupBy(keys).cogroup(cells.unionByName(whole).groupBy(keys)).applyInPandas(
        _walk(top), "lang string, source string, part string, item string, value long")
    summed = made.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = summed.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
