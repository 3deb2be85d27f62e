"""Outcome classes and retry delays of external calls, over a call log."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from postaudit import schema as S


def call_class(status: Column, body: Column, attempt: Column, max_retries: int = S.MAX_RETRIES) -> Column:
    """ok, critical, permanent, daily_quota, rate_limited or retryable; status NULL = no answer.

    The daily-quota markers count only while a retry is left.
    """
    exhausted = reduce(or_, [F.contains(F.coalesce(body, F.lit("")), F.lit(m)) for m in S.QUOTA_MARKERS])
    return (
        F.when(status == 200, "ok")
        .when(status.isin(401, 403, 404), "critical")
        .when((status == 429) & exhausted & (attempt < max_retries), "daily_quota")
        .when(status == 429, "rate_limited")
        .when((status >= 400) & (status < 500), "permanent")
        .otherwise("retryable")
    )


def retry_delay(outcome: Column, attempt: Column, max_retries: int = S.MAX_RETRIES) -> Column:
    """Seconds to wait after attempt 0, 1, …; NULL when there is no further attempt."""
    doubled = F.pow(F.lit(2.0), attempt)
    return F.when(attempt < max_retries,
                  F.when(outcome == "rate_limited", F.least(F.lit(60.0) * doubled, F.lit(300.0)))
                  .when(outcome == "retryable", doubled))
