"""Phrase rules: the built-in scorer and the first-match filter cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from postaudit import schema as S
from postaudit.functions.text import bind, bind_lowered, contains_any, is_repost
from postaudit.operators.policy import with_first_phrase

_ABUSIVE, _HATE, _THREAT = 1, 2, 4
_LABELS = {_ABUSIVE: "abusive", _HATE: "hate_speech", _THREAT: "threatening"}


def drop_reposts(posts: DataFrame) -> DataFrame:
    return posts.filter(~is_repost(F.col("text")))


def _bit(hit: Column, bit: int) -> Column:
    return F.when(hit, bit).otherwise(0)


def bind_hits(posts: DataFrame, when: Column | None = None) -> DataFrame:
    """Add `_hits`: which of the three phrase groups hit `_low`, as a bit set; NULL where not `when`."""
    low = F.col("_low")
    bits = (_bit(contains_any(low, S.RULE_ABUSIVE), _ABUSIVE)
            + _bit(contains_any(low, S.RULE_HATE), _HATE)
            + _bit(contains_any(low, S.RULE_THREAT), _THREAT))
    return bind(posts, "_hits", bits if when is None else F.when(when, bits))


def group_hit(posts: DataFrame, phrases: Sequence[str], name: str = "hit") -> DataFrame:
    """Add whether a text holds one of the phrases."""
    return bind(bind_lowered(posts), name, contains_any(F.col("_low"), phrases)).drop("_low")


def rule_result(hits: Column) -> Column:
    """struct(should_flag, score, reason, labels); the later group wins, labels add up."""
    abusive, hate, threat = (hits.bitwiseAND(bit) > 0 for bit in (_ABUSIVE, _HATE, _THREAT))
    # One constant list for every combination of hits.
    combinations = [[name for bit, name in _LABELS.items() if value & bit] for value in range(8)]
    labels = F.get(F.array(*[F.array(*map(F.lit, names)).cast("array<string>") for names in combinations]), hits)
    return F.struct(
        (hits > 0).alias("should_flag"),
        F.when(threat, 0.95).when(hate, 0.9).when(abusive, 0.85).otherwise(0.0).alias("score"),
        F.when(threat, S.REASON_RULE_THREAT).when(hate, S.REASON_RULE_HATE)
        .when(abusive, S.REASON_RULE_ABUSIVE).otherwise(S.REASON_CLEAN).alias("reason"),
        labels.alias("labels"),
    )


def rule_scorer(posts: DataFrame) -> DataFrame:
    """The default scorer: adds `result`."""
    return bind_hits(bind_lowered(posts)).withColumn("result", rule_result(F.col("_hits"))).drop("_low", "_hits")


def keep_flagged(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("result.should_flag"))


def first_phrase(low: Column, phrases: Sequence[str], whole_words: bool = False) -> Column:
    """Position in `phrases` of the first one contained, NULL when none is; empty ones are skipped.

    With `whole_words` a phrase counts only where no letter, digit or underscore adjoins it.
    """
    chain = None
    for rank, phrase in enumerate(phrases):
        if phrase:
            hit = (F.rlike(low, F.lit(rf"(?U)(?<!\w)\Q{phrase.lower()}\E(?!\w)")) if whole_words
                   else F.contains(low, F.lower(F.lit(phrase))))
            chain = F.when(hit, rank) if chain is None else chain.when(hit, rank)
    return F.lit(None).cast("int") if chain is None else chain


def bind_phrase(posts: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """Add `_rank`, the position of the first phrase contained, see first_phrase."""
    return bind(bind_lowered(posts), "_rank", first_phrase(F.col("_low"), phrases)).drop("_low")


def bind_step(posts: DataFrame, phrases: Sequence[str], gate: Column | None = None,
              whole_words: bool = False) -> DataFrame:
    """Add `_step`, the first step of the cascade that hits `_low`.

    A position in `phrases`, then one number for threat and one for hate; NULL for no hit and
    where `gate` does not hold.
    """
    low, threat, hate = F.col("_low"), len(phrases), len(phrases) + 1
    step = F.coalesce(
        first_phrase(low, phrases, whole_words),
        F.when(contains_any(low, S.CASCADE_THREAT), threat),
        F.when(contains_any(low, S.CASCADE_HATE), hate))
    return bind(posts, "_step", step if gate is None else F.when(gate, step))


def cascade_result(step: Column, phrases: Sequence[str]) -> Column:
    """struct(filter_reason, score, reason) of a cascade step, NULL for no hit."""
    threat, hate = len(phrases), len(phrases) + 1
    named = F.get(F.array(*[F.lit(p) for p in phrases]), step) if phrases else F.lit("")
    blocked = step < threat
    return F.when(step.isNotNull(), F.struct(
        F.when(blocked, "blocked_phrase").when(step == threat, "threat").otherwise("hate_speech")
        .alias("filter_reason"),
        F.when(step == hate, 0.95).otherwise(1.0).alias("score"),
        F.when(blocked, F.concat(F.lit(S.REASON_BLOCKED), named))
        .when(step == threat, S.REASON_CASCADE_THREAT).otherwise(S.REASON_CASCADE_HATE).alias("reason"),
    ))


def apply_cascade(posts: DataFrame, phrases: Sequence[str], gate: Column | None = None, whole_words: bool = False,
                  forbidden_words: bool = False) -> DataFrame:
    """Adds `filter_result`; rows for which `gate` does not hold are not looked at.

    With `forbidden_words`, a word that the job's own criteria forbid blocks like a phrase, after the phrases.
    """
    stepped, result = bind_step(bind_lowered(posts), phrases, gate, whole_words), cascade_result(F.col("_step"), phrases)
    if forbidden_words:
        word = forbidden_word(gate)
        result = F.when(F.col("_step") < len(phrases), result).when(word.isNotNull(), _blocked(word)).otherwise(result)
    return stepped.withColumn("filter_result", result).drop("_low", "_step")


def forbidden_word(gate: Column | None) -> Column:
    """The first word that the job's own criteria forbid and `_low` contains."""
    word = F.get(F.filter("criteria.forbidden_words", lambda w: (w != "") & F.contains(F.col("_low"), F.lower(w))), F.lit(0))
    return word if gate is None else F.when(gate, word)


def _blocked(phrase: Column) -> Column:
    return F.struct(F.lit("blocked_phrase").alias("filter_reason"), F.lit(1.0).alias("score"),
                    F.concat(F.lit(S.REASON_BLOCKED), phrase).alias("reason"))


def apply_policy_cascade(posts: DataFrame, policy: DataFrame, gate: Column | None = None, whole_words: bool = False,
                         forbidden_words: bool = False) -> DataFrame:
    """apply_cascade with the phrases of a table (rank, phrase), which is never held as a whole, see with_first_phrase."""
    found = with_first_phrase(posts, policy, gate, whole_words)
    stepped, result = bind_step(bind_lowered(found), [], gate), cascade_result(F.col("_step"), [])
    if forbidden_words:
        word = forbidden_word(gate)
        result = F.when(word.isNotNull(), _blocked(word)).otherwise(result)
    first = F.when(F.col("_first").isNotNull(), _blocked(F.col("_first.phrase"))).otherwise(result)
    return stepped.withColumn("filter_result", first).drop("_low", "_step", "_first")


def has_own_criteria() -> Column:
    """The gate of the cascade: only jobs that brought criteria are filtered before scoring."""
    return F.col("criteria").isNotNull()
