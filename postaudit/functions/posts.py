"""Columns of a normalised post from the raw archive struct."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STAMP = (r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun) ([a-z]{3}) (\d{2}) "
          r"(\d{1,2}:\d{2}:\d{2})(?:[.,]\d+)? \+0000 (\d{4})$")


def post_text(full_text: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(full_text, F.lit("")), text, F.lit(""))


def parse_created_at(created_at: Column) -> Column:
    """`Mon Jan 02 15:04:05 +0000 2006` to a timestamp; anything else, other offsets too, is NULL.

    The weekday must be a weekday name but is not compared with the date.
    """
    plain = F.regexp_replace(created_at, _STAMP, "$4 $1 $2 $3 +0000")
    return F.try_to_timestamp(plain, F.lit("yyyy MMM dd H:mm:ss xx"))


def _kept(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda s: s != "")


def links(urls: Column) -> Column:
    return _kept(F.transform(urls, lambda u: F.coalesce(
        F.nullif(u["expanded_url"], F.lit("")), u["url"], F.lit(""))))


def hashtags(tags: Column) -> Column:
    return F.transform(_kept(F.transform(tags, lambda t: t["text"])), lambda s: F.concat(F.lit("#"), s))


def mentions(users: Column) -> Column:
    return F.transform(_kept(F.transform(users, lambda m: m["screen_name"])), lambda s: F.concat(F.lit("@"), s))


def attachments(media: Column) -> Column:
    return _kept(F.transform(media, lambda m: m["media_url"]))


def post_columns(tweet: Column, run_ts: Column) -> list[Column]:
    """All normalised columns of one raw post; `run_ts` stands in for an unreadable date."""
    stamp = parse_created_at(tweet["created_at"])
    entities = tweet["entities"]
    return [
        F.coalesce(tweet["id_str"], F.lit("")).alias("tweet_id"),
        post_text(tweet["full_text"], tweet["text"]).alias("text"),
        F.coalesce(stamp, run_ts).alias("created_at"),
        stamp.isNotNull().alias("created_at_ok"),
        links(entities["urls"]).alias("links"),
        hashtags(entities["hashtags"]).alias("hashtags"),
        mentions(entities["user_mentions"]).alias("mentions"),
        attachments(entities["media"]).alias("attachments"),
    ]
