"""Page bounds, page arithmetic and the quota reset instant."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postaudit import schema as S


def page_bounds(page: int | None, size: int | None) -> tuple[int, int]:
    """Page below 1 becomes 1, size below 1 the default, size above the maximum the maximum."""
    page = page if page is not None and page >= 1 else 1
    size = size if size is not None and size >= 1 else S.PAGE_SIZE_DEFAULT
    return page, min(size, S.PAGE_SIZE_MAX)


def page_offset(page: int, size: int) -> int:
    return (page - 1) * size


def total_pages(total: Column, size: int) -> Column:
    return F.ceil(total / F.lit(size)).cast("bigint")


def quota_reset_at(ts: Column) -> Column:
    """One minute past the next midnight."""
    return F.date_trunc("day", ts) + F.expr("INTERVAL '1 00:01' DAY TO MINUTE")
