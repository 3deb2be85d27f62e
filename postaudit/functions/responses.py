"""Reading what an external model answered: envelope, verdict, error default."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postaudit import schema as S
from postaudit.functions.text import between_first_and_last

EMPTY_ENVELOPE = "the answer holds no text part"
# Error texts.
BAD_ENVELOPE = "failed to decode response"
BAD_FORMAT = "invalid response format: "
BAD_VERDICT = "failed to parse JSON response"

_ENVELOPE_DDL = ("a STRUCT<candidates: ARRAY<STRUCT<content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>>, "
                 "_bad STRING")
_VERDICT_DDL = f"a STRUCT<{S.RESULT_DDL}>, _bad STRING"


def _strict_json(text: Column, ddl: str) -> Column:
    return F.from_json(F.concat(F.lit('{"a":'), text, F.lit("}")), ddl, {"columnNameOfCorruptRecord": "_bad"})


def open_envelope(body: Column) -> Column:
    """struct(text, error): first part of the first candidate, or why there is none."""
    parsed = _strict_json(body, _ENVELOPE_DDL)
    readable = parsed["a"].isNotNull() & parsed["_bad"].isNull()
    part = F.get(F.get(parsed["a"]["candidates"], F.lit(0))["content"]["parts"], F.lit(0))
    error = (F.when(~readable, BAD_ENVELOPE).when(part.isNull(), EMPTY_ENVELOPE))
    return F.struct(F.when(error.isNull(), F.coalesce(part["text"], F.lit(""))).alias("text"), error.alias("error"))


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def parse_verdict(response: Column) -> Column:
    """struct(should_flag, score, reason, labels, error) from text around one JSON object; NULL is no such text."""
    response = F.coalesce(response, F.lit(""))
    body = between_first_and_last(response, "{", "}")
    parsed = _strict_json(body, _VERDICT_DDL)
    verdict = parsed["a"]
    error = (F.when(body == "", F.concat(F.lit(BAD_FORMAT), response))
             .when(verdict.isNull() | parsed["_bad"].isNotNull(), BAD_VERDICT))
    good = error.isNull()
    return F.struct(
        F.when(good, F.coalesce(verdict["should_flag"], F.lit(False))).alias("should_flag"),
        F.when(good, clamp_score(F.coalesce(verdict["score"], F.lit(0.0)))).alias("score"),
        F.when(good, F.coalesce(verdict["reason"], F.lit(""))).alias("reason"),
        F.when(good, verdict["labels"]).alias("labels"),
        error.alias("error"),
    )


def or_error_default(verdict: Column) -> Column:
    """A failed row becomes an unflagged result whose reason tells the error; the rest is kept."""
    failed = verdict["error"].isNotNull()
    return F.struct(
        F.when(failed, F.lit(False)).otherwise(verdict["should_flag"]).alias("should_flag"),
        F.when(failed, F.lit(0.0)).otherwise(verdict["score"]).alias("score"),
        F.when(failed, F.concat(F.lit("Error: "), verdict["error"])).otherwise(verdict["reason"]).alias("reason"),
        F.when(~failed, verdict["labels"]).alias("labels"),
    )
