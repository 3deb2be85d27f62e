"""Scalar text expressions: phrase tests, repost test, ids, links, JSON and time edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from postaudit import schema as S


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add `value` as a column that is computed once per row, whatever is done with it later.

    A column added by a plain projection is computed again by every filter on it: the optimizer
    moves the filter below the projection and puts the expression in place of its name, at each
    mention. It does not do so below a generator, here one that yields a single row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def bind_lowered(df: DataFrame, name: str = "_low") -> DataFrame:
    """Add the lower-cased text, empty for none."""
    return bind(df, name, F.lower(F.coalesce("text", F.lit(""))))


def needed(phrases: Sequence[str]) -> list[str]:
    """Phrases that decide a group: one containing another of the group never adds a hit."""
    return [p for p in phrases if not any(q != p and q in p for q in phrases)]


def shared_words(phrases: Sequence[str]) -> dict[str, list[str]]:
    """Phrases by a word of four or more characters they share with another; the rest under ""."""
    groups, left = {}, list(phrases)
    words = sorted({w for p in phrases for w in p.split() if len(w) >= 4})
    for word in sorted(words, key=lambda w: -sum(w in p for p in phrases)):
        members = [p for p in left if word in p]
        if len(members) > 1:
            groups[word] = members
            left = [p for p in left if p not in members]
    return {**groups, "": left}


def contains_any(low: Column, phrases: Sequence[str]) -> Column:
    """True when the lower-cased text holds one of the (lower-case) phrases as a substring.

    Each test reads the text once more. Phrases that share a word are tested only where the word
    is, which takes a quarter of the readings off the built-in lists.
    """
    tests = []
    for word, members in shared_words(needed(phrases)).items():
        if members:
            one_of = reduce(or_, [F.contains(low, F.lit(p)) for p in members])
            tests.append(F.contains(low, F.lit(word)) & one_of if word else one_of)
    return reduce(or_, tests) if tests else F.lit(False)


def contains_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(F.lower(text), F.lower(phrase))


def is_repost(text: Column) -> Column:
    """Text that starts with `RT @` after leading white space; looks at the leading blanks only."""
    return F.startswith(F.ltrim(F.coalesce(text, F.lit("")), F.lit(S.WHITE_SPACE)), F.lit("RT @"))


def post_url(tweet_id: Column, base: str = S.POST_URL_BASE) -> Column:
    return F.concat(F.lit(base), tweet_id)


def post_key(job_id: Column, tweet_id: Column) -> Column:
    return F.concat_ws("_", job_id, tweet_id)


def flag_id(job_id: Column, tweet_id: Column, filter_reason: Column) -> Column:
    """32 hex characters fixed by the flag's own key, so a repeated task writes the same id."""
    return F.md5(F.concat_ws("_", job_id, tweet_id, filter_reason))


def array_to_json(values: Column) -> Column:
    return F.to_json(values)


def json_to_array(text: Column) -> Column:
    return F.from_json(text, "ARRAY<STRING>")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_rfc3339(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def between_first_and_last(text: Column, opening: str, closing: str) -> Column:
    """The part from the first `opening` to the last `closing`, empty when there is none."""
    start = F.instr(text, opening)
    end = F.length(text) - F.length(F.substring_index(text, closing, -1))
    return F.when((start > 0) & (end > start), F.substr(text, start, end - start + 1)).otherwise("")


def _from_array(js: Column) -> Column:
    """`name = [...` without its head when the file opens with an assignment, else all of it.

    Only an assignment at the head of the file counts, so an `= [` within a post is left alone.
    """
    blank = F.lit(S.WHITE_SPACE)
    equals = F.instr(js, "=")
    assigned = F.ltrim(F.substr(js, equals + 1), blank)
    bare = F.startswith(F.ltrim(js, blank), F.lit("["))
    return F.when(~bare & (equals > 0) & F.startswith(assigned, F.lit("[")), assigned).otherwise(js)


def unwrap_js(js: Column) -> Column:
    """The JSON array inside `name = [...];`, or inside bare text; empty when there is none."""
    return between_first_and_last(_from_array(js), "[", "]")


def bind_body(files: DataFrame, js: Column, name: str = "_body") -> DataFrame:
    """Add unwrap_js of `js`, step by step, so that no step goes over a long file twice."""
    opened = bind(bind(files, "_js", js), "_opened", _from_array(F.col("_js")))
    return bind(opened, name, between_first_and_last(F.col("_opened"), "[", "]")).drop("_js", "_opened")
