"""Blocked phrases held in a table (rank, phrase) instead of a list: an index by rare words or grams, joined with the texts'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postaudit import schema as S
from postaudit.session import materialise

GRAM = 4
"""Characters of a gram; a shorter phrase is its own gram."""
SAMPLE = 64
"""One text in so many tells how often a gram occurs; that only decides which gram a phrase is found by."""
HOT_SHARE = 1000
"""A gram that more than one text in so many has is hot, and its texts are dealt to several tasks,"""
HOT_LEAST = 1000
"""if so many sampled texts have it."""
FEW_SHORT = 500
"""So many phrases without an inner word are looked for in every text; more of them are found by grams."""
MANY_LONG = 100_000
"""So many phrases with an inner word are sent to the texts, which then stay in place."""
HELD_CHARS = 16 << 20
"""Characters of the phrases that are sent to every task."""


def text_key(low: Column) -> Column:
    """Equal texts hold equal phrases, so each different text is searched once."""
    return F.unhex(F.sha2(low, 256))


def grams(low: Column, size: int) -> Column:
    """Hashes of the different runs of `size` characters of a text."""
    def runs(chars: Column) -> Column:
        run = lambda i: F.xxhash64(F.concat(*[F.get(chars, i + k) for k in range(size)]))
        return F.transform(F.sequence(F.lit(0), F.size(chars) - size), run)

    # The characters are an argument of a function, so that they are split off once a text and not once a run.
    made = F.get(F.transform(F.array(F.split(low, "")), runs), F.lit(0))
    return F.array_distinct(F.when(F.length(low) >= size, made).otherwise(F.array().cast("array<bigint>")))


def whole_word(low: Column, phrase: Column) -> Column:
    """Whether `low` holds `phrase` where no letter, digit or underscore adjoins it."""
    # A lower-cased phrase holds no \\E, which would end the quotation.
    return F.rlike(low, F.concat(F.lit(r"(?U)(?<!\w)\Q"), phrase, F.lit(r"\E(?!\w)")))


def inner_words(low: Column) -> Column:
    """What stands between the spaces of a phrase without its first and last part: whole words of any text that holds it."""
    parts = F.split(low, " ")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))


def explode_words(texts: DataFrame, *more: str) -> DataFrame:
    """(key, gram, more) of each text's different words, by their hashes; a word is what stands between spaces."""
    words = texts.select("key", *more, F.explode(F.array_distinct(F.split("low", " "))).alias("word"))
    return words.select("key", F.xxhash64("word").alias("gram"), *more)


def ordered_phrases(policy: DataFrame) -> DataFrame:
    """(place, low, rank, phrase, inner): the different phrases; the one of lowest place comes first, by rank and spelling.

    Equal phrases are one, that of lowest rank. Place is a number, so that a text's first phrase is kept by a plain minimum.
    """
    wanted = (policy.filter(F.coalesce("phrase", F.lit("")) != "")
              .select(F.lower("phrase").alias("low"), F.struct(F.col("rank").cast("bigint").alias("rank"), "phrase").alias("named"))
              .groupBy("low").agg(F.min("named").alias("named")).select("low", "named.*"))
    turn = F.row_number().over(Window.partitionBy("rank").orderBy("phrase", "low"))
    # A phrase without a rank comes before all others; 10^12 phrases may share a rank.
    rank = F.coalesce(F.col("rank").cast("decimal(20,0)"), F.lit("-10000000000000000000").cast("decimal(20,0)"))
    place = (rank * F.lit(10 ** 12).cast("decimal(13,0)") + turn.cast("decimal(13,0)")).cast("decimal(38,0)")
    return materialise(wanted.select(place.alias("place"), "low", "rank", "phrase", F.size(inner_words(F.col("low"))).alias("inner")))


def _by_rarest(own: DataFrame, seen: DataFrame) -> DataFrame:
    """(gram, low, place, often): of the grams of a phrase the one that fewest of the sampled texts have."""
    rated = own.join(seen, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    rarest = rated.groupBy("low", "place").agg(F.min(F.struct("often", "gram")).alias("by"))
    return materialise(rarest.select("by.gram", "low", "place", "by.often"))


def _sampled(texts: DataFrame) -> DataFrame:
    return texts.filter(F.pmod(F.hash("key"), F.lit(SAMPLE)) == 0)


def _often(found: DataFrame) -> DataFrame:
    return found.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))


def word_index(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(gram, low, place, often) with the inner word that each phrase is found by."""
    own = phrases.select("low", "place", F.explode(inner_words(F.col("low"))).alias("word"))
    own = own.select("low", "place", F.xxhash64("word").alias("gram"))
    return _by_rarest(own, _often(explode_words(_sampled(texts))))


def phrase_index(phrases: DataFrame, texts: DataFrame, size: int = GRAM) -> tuple[DataFrame, list[int]]:
    """(gram, low, place, often) with the gram of characters that each phrase is found by, and the lengths of grams in use."""
    sized = phrases.select("low", "place", F.least(F.length("low"), F.lit(size)).alias("size"))
    sizes = sorted(r[0] for r in sized.select("size").distinct().collect())  # `size` rows at most
    own = sized.select("low", "place", F.explode(_by_size(F.col("low"), sizes, F.col("size"))).alias("gram"))
    return _by_rarest(own, _often(explode_grams(_sampled(texts), sizes))), sizes


def _by_size(low: Column, sizes: list[int], size: Column) -> Column:
    chosen = F.array().cast("array<bigint>")
    for n in sizes:
        chosen = F.when(size == n, grams(low, n)).otherwise(chosen)
    return chosen


def explode_grams(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, gram) of each text's different grams of the given lengths."""
    every = F.flatten(F.array(*[grams(F.col("low"), n) for n in sizes])) if sizes else F.array().cast("array<bigint>")
    return texts.select("key", F.explode(every).alias("gram"))


def candidates(texts: DataFrame, index: DataFrame, found: DataFrame) -> DataFrame:
    """(key, low_phrase, place): phrases whose gram a text has by `found` (key, gram); only keys and grams move.

    Hot grams are known from the sample. A text has few grams for its length, so few grams can be in one text of a
    thousand: they are broadcast, and the rows that have one are dealt to parts, each with its own copy of the phrases.
    """
    total = _sampled(texts).count()
    parts = F.greatest(F.ceil(F.col("often") / max(total / HOT_SHARE, HOT_LEAST)), F.lit(1)).cast("int").alias("parts")
    rated = index.select(*index.columns, parts)
    hot = rated.filter("parts > 1").select("gram", "parts").distinct()
    found = found.join(F.broadcast(hot), "gram", "left")
    found = found.select("key", "gram", F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0)).alias("part"))
    copies = F.explode(F.expr("sequence(0L, CAST(parts - 1 AS BIGINT))")).alias("part")
    dealt = rated.select("gram", F.col("low").alias("low_phrase"), "place", copies)
    return found.join(dealt, ["gram", "part"]).select("key", "low_phrase", "place")


def _fit(phrases: DataFrame, most: int) -> tuple[bool, bool]:
    """Whether there are phrases, and whether they are so few and short that every task can have them all."""
    size = phrases.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("low")).alias("chars")).first()
    return size["n"] > 0, size["n"] <= most and (size["chars"] or 0) <= HELD_CHARS


def _held(low: Column, phrase: Column, whole_words: bool) -> Column:
    return F.contains(low, phrase) & (whole_word(low, phrase) if whole_words else F.lit(True))


def with_first_of_few(texts: DataFrame, phrases: DataFrame, whole_words: bool = False) -> DataFrame:
    """(key, low, best) with the lowest place of the given few phrases that a text holds; none behind it is looked for."""
    def step(best: Column, one: Column) -> Column:
        return F.coalesce(best, F.when(_held(F.col("low"), one["low"], whole_words), one["place"]))

    listed = phrases.agg(F.sort_array(F.collect_list(F.struct("place", "low"))).alias("_few"))
    first = F.aggregate("_few", F.lit(None).cast("decimal(38,0)"), step)
    return texts.crossJoin(F.broadcast(listed)).select("key", "low", first.alias("best"))


def first_phrases(texts: DataFrame, policy: DataFrame, whole_words: bool = False, size: int = GRAM) -> DataFrame:
    """(key, first) of the texts (key, low; different) that hold a phrase; first is struct(rank, phrase) of the lowest rank.

    A phrase of three or more words is found by its rarest inner word. A shorter one may lie within words: up to
    FEW_SHORT of these are looked for in each text, in their order, more are found by grams of characters. Each candidate that
    could come first is confirmed in the whole text, so a hash that two grams share changes nothing. Neither texts nor
    phrases are ever collected, and texts stay in place for phrases that every task can have; else a text has one row per
    candidate. What is confirmed is reduced by aggregation.
    """
    phrases = ordered_phrases(policy)
    short, long = phrases.filter("inner = 0").select("low", "place"), phrases.filter("inner > 0").select("low", "place")

    def first_of(met: DataFrame) -> DataFrame:
        held = met.filter(_held(F.col("low"), F.col("low_phrase"), whole_words))
        return held.groupBy("key").agg(F.min("place").alias("place"))

    if _fit(short, FEW_SHORT)[1]:
        judged = materialise(with_first_of_few(texts, short, whole_words))
    else:
        texts = materialise(texts)
        index, sizes = phrase_index(short, texts, size)
        by_short = first_of(texts.join(candidates(texts, index, explode_grams(texts, sizes)), "key"))
        judged = materialise(texts.join(by_short, "key", "left").select("key", "low", F.col("place").alias("best")))
    first = judged.filter(F.col("best").isNotNull()).select("key", F.col("best").alias("place"))
    any_long, held = _fit(long, MANY_LONG)
    if any_long:
        index = word_index(long, judged)
        met = (explode_words(judged, "low", "best").join(F.broadcast(index.withColumnRenamed("low", "low_phrase")), "gram") if held
               else judged.join(candidates(judged, index, explode_words(judged)), "key"))
        earlier = met.filter(F.col("best").isNull() | (F.col("place") < F.col("best")))
        first = first.unionByName(first_of(earlier)).groupBy("key").agg(F.min("place").alias("place"))
    first = materialise(first)
    return first.join(phrases.select("place", F.struct("rank", "phrase").alias("first")), "place").select("key", "first")


def with_first_phrase(posts: DataFrame, policy: DataFrame, gate: Column | None = None, whole_words: bool = False,
                      size: int = GRAM) -> DataFrame:
    """`posts` with `_first`, struct(rank, phrase) of the policy's first phrase that the lower-cased text contains.

    NULL where none is, where the text is NULL and where `gate` does not hold. Empty phrases are skipped; a policy without
    phrases finds nothing. Equal texts are merged before anything else, so a text that a third of all posts
    repeat is looked at once.
    """
    low = F.lower("text")
    wanted = posts.filter(F.col("text").isNotNull() & (F.lit(True) if gate is None else F.coalesce(gate, F.lit(False))))
    texts = wanted.select(text_key(low).alias("key"), low.alias("low")).dropDuplicates(["key"])
    first = materialise(first_phrases(texts, policy, whole_words, size))
    keyed = posts.withColumn("_key", F.when(F.lit(True) if gate is None else gate, text_key(low)))
    return keyed.join(first.select(F.col("key").alias("_key"), F.col("first").alias("_first")), "_key", "left").drop("_key")


def match_policy(posts: DataFrame, policy: DataFrame, whole_words: bool = False, size: int = GRAM) -> DataFrame:
    """Posts that contain a policy phrase, with the one of lowest rank: job_id, tweet_id, phrase, reason."""
    judged = with_first_phrase(posts.select("job_id", "tweet_id", "text"), policy, None, whole_words, size)
    hit = judged.filter(F.col("_first").isNotNull()).select("job_id", "tweet_id", F.col("_first.phrase").alias("phrase"))
    return hit.withColumn("reason", F.concat(F.lit(S.REASON_BLOCKED), F.col("phrase")))
