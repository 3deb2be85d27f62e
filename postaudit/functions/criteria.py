"""Moderation criteria: decoding the request text and the defaults."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postaudit import schema as S

# The criteria of a job that brings none.
DEFAULTS = {
    "forbidden_words": [],
    "professional_check": False,
    "tone": "respectful and thoughtful",
    "exclude_politics": False,
    "exclude_profanity": True,
    "exclude_threats": True,
    "exclude_hate_speech": True,
    "exclude_harassment": True,
}

_REQUEST_DDL = f"a STRUCT<criteria: STRUCT<{S.CRITERIA_DDL}>, {S.CRITERIA_DDL}>, _bad STRING"


def _typed(name: str, value) -> Column:
    return F.array().cast("array<string>") if name == "forbidden_words" else F.lit(value)


def default_criteria() -> Column:
    return F.struct(*[_typed(name, value).alias(name) for name, value in DEFAULTS.items()])


def criteria_or_default(criteria: Column) -> Column:
    return F.coalesce(criteria, default_criteria())


def parse_criteria(text: Column) -> Column:
    """`{"criteria": {...}}` or the bare object; NULL for absent, malformed or wrong-typed text.

    Fields that are absent become empty text, empty list and false.
    """
    parsed = F.from_json(F.concat(F.lit('{"a":'), text, F.lit("}")), _REQUEST_DDL,
                         {"columnNameOfCorruptRecord": "_bad"})
    request = parsed["a"]
    wrapped = request["criteria"].isNotNull()
    zero = {name: _typed(name, "" if name == "tone" else False) for name in DEFAULTS}
    fields = [
        F.coalesce(F.when(wrapped, request["criteria"][name]).otherwise(request[name]), zero[name]).alias(name)
        for name in DEFAULTS
    ]
    return F.when(request.isNotNull() & parsed["_bad"].isNull(), F.struct(*fields))
