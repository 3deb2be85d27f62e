"""Views over the given tables that stand in for archives, jobs, flags and call logs.

Every view keeps all rows of its table. One third of all posts belongs to one job, the others
to jobs of a few posts, so the views are as skewed as real tables may be.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postaudit.functions.criteria import parse_criteria
from postaudit.functions.text import post_url
from postaudit.operators.joins import join_by_job
from postaudit.operators.pending import mark_processed
from postaudit.operators.routing import FLAGGED, flag_in_one_pass, route
from postaudit.operators.rules import drop_reposts, rule_scorer
from postaudit.sources.archives import in_small_batches, one_by_one

BLOCKED = ["", "Crypto", "late"]

PREFIXES = {
    0: "RT @user: ", 1: "\tRT @user ", 2: "I hate this. ", 3: "I'll kill time. ", 4: "You should die. ",
    5: "GOING TO HURT ", 6: "deserves to die: ", 7: "Buy CRYPTO now. ", 8: "All [group] are late. ", 9: "go die ",
}
HEADS = ["window.YTD.tweets.part0 = ", "window.YTD.tweets.part0 =   ", ""]
DAMAGE = ["", "cut", "no array", "junk"]
MEMBERS = [["data/account.js", "data/tweets.js"], ["data/deleted-tweets.js", "data/tweets.js"], ["data/other.js"]]


def _by(key: Column, values: dict[int, str] | list[str], default: str | None = None) -> Column:
    items = values.items() if isinstance(values, dict) else enumerate(values)
    chain = F
    for number, value in items:
        chain = chain.when(key == number, value)
    return chain.otherwise(default) if default is not None else chain


def job_number() -> Column:
    return F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.expr("doc_id div 20"))


def job_name(number: Column) -> Column:
    return F.concat(F.lit("job-"), number.cast("string"))


def job_criteria_text(number: Column) -> Column:
    wrapped = F.concat(
        F.lit('{"criteria": {"forbidden_words": ["crypto", "w'), number.cast("string"),
        F.lit('"], "professional_check": true, "tone": "calm", "exclude_politics": true, "exclude_threats": true}}'))
    return (F.when(number % 5 == 0, wrapped)
            .when(number % 5 == 1, '{"forbidden_words": [], "tone": "", "exclude_profanity": true}')
            .when(number % 5 == 3, '{"forbidden_words": [')
            .when(number % 5 == 4, '{"professional_check": "yes"}'))


def _zip_bytes(members: list[str], body: str) -> bytes:
    """A ZIP whose members after the first hold a different text, so taking the wrong one shows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        fitting = [m for m in members if "tweet" in m]
        for member in members:
            archive.writestr(member, body if member in fitting[:1] else "[]")
    return out.getvalue()


def _zip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def zipped() -> Iterator[tuple[dict, int]]:
        for path, part, body in one_by_one(batches, "path", "part", "body"):
            content = _zip_bytes(MEMBERS[part % 3], body)
            yield {"path": path, "content": content}, len(content)

    return in_small_batches(zipped(), pa.schema([("path", pa.string()), ("content", pa.binary())]))


class Views:
    """Lazily built views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def posts(self) -> DataFrame:
        return self._described_posts.drop("lang", "source")

    @cached_property
    def _described_posts(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.table("documents").select(
            job_name(job_number()).alias("job_id"),
            doc.cast("string").alias("tweet_id"),
            F.concat(_by(doc % 20, PREFIXES, ""), F.col("text")).alias("text"),
            F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"),
            doc.alias("pos"), "lang", "source")

    @cached_property
    def originals(self) -> DataFrame:
        return drop_reposts(self.posts)

    @cached_property
    def posts_dup(self) -> DataFrame:
        """All posts twice, the second copy later in the archive."""
        return self.posts.unionByName(self.posts.withColumn("pos", F.col("pos") + F.lit(1_000_000_000_000)))

    @cached_property
    def policy(self) -> DataFrame:
        rows = ", ".join(f"({rank}, '{phrase}')" for rank, phrase in enumerate(BLOCKED))
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS policy(rank, phrase)")

    @cached_property
    def jobs_in(self) -> DataFrame:
        numbers = self.table("documents").select(job_number().alias("k")).distinct()
        text = job_criteria_text(F.col("k"))
        return numbers.select(job_name(F.col("k")).alias("job_id"), "k", text.alias("criteria_text"),
                              parse_criteria(text).alias("criteria"))

    @cached_property
    def posts_with_job(self) -> DataFrame:
        return join_by_job(self.originals, self.jobs_in.select("job_id", "criteria"))

    @cached_property
    def routed(self) -> DataFrame:
        return route(self.posts_with_job, BLOCKED)

    @cached_property
    def flagged(self) -> DataFrame:
        rows = flag_in_one_pass(self.posts_with_job, BLOCKED, self.flagged_at)
        bare = F.col("tweet_id").cast("bigint") % 17 == 0
        return rows.withColumn("url", F.when(bare, "").otherwise(post_url(F.col("tweet_id"))))

    @property
    def flagged_at(self) -> Column:
        return F.col("created_at") + F.expr("INTERVAL '1' DAY")

    @cached_property
    def scored(self) -> DataFrame:
        """Posts an earlier run has scored: the labelled documents."""
        labelled = self.table("labels").select("doc_id")
        doc = F.col("doc_id")
        return labelled.select(
            job_name(job_number()).alias("job_id"), doc.cast("string").alias("tweet_id"),
            F.expr("timestampadd(MINUTE, 7 * doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("scored_at"))

    @cached_property
    def state(self) -> DataFrame:
        """Original posts with route, needs_scoring, processed and the outcome should_flag."""
        # The text is judged before the join, so only keys and outcomes are shuffled.
        judged = rule_scorer(self.routed).select(
            "job_id", "tweet_id", "route", ((F.col("route") == FLAGGED) | F.col("result.should_flag")).alias("should_flag"),
            "created_at", "pos")
        return mark_processed(judged, self.scored)

    @cached_property
    def job_updates(self) -> DataFrame:
        """Events as updates of ten jobs, two a second, so that flush windows merge many."""
        at = F.expr("timestampadd(SECOND, cast(event_id div 2 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00')")
        return self.table("events").select(
            F.concat(F.lit("job-"), (F.col("user_id") % 10).cast("string")).alias("id"),
            F.concat(F.lit("file-"), F.col("event_id").cast("string")).alias("file_id"),
            F.col("event_type").alias("status"), at.alias("created_at"),
            at.alias("updated_at"), F.col("event_id").alias("n"))

    @cached_property
    def calls(self) -> DataFrame:
        event = F.col("event_id")
        codes = [200, 400, 401, 403, 404, 429, 429, 500, 503]
        return self.table("events").select(
            event.alias("call_id"),
            F.get(F.array(*[F.lit(c) for c in codes]), (event % 9).cast("int")).alias("status"),
            _by(event % 4, ["RESOURCE_EXHAUSTED", "quota exceeded", "slow down", "slow down"]).alias("body"),
            F.expr("int(event_id div 9)").alias("_turn")).withColumn("attempt", F.col("_turn") % 4).drop("_turn")

    @cached_property
    def responses(self) -> DataFrame:
        doc = F.col("doc_id")
        verdict = F.concat(
            F.lit('Here it is: {"should_flag": '), F.when(doc % 2 == 0, "true").otherwise("false"),
            F.lit(', "score": '), (doc % 30 - 10).cast("string"), F.lit('e-1, "reason": "'), F.col("source"),
            F.lit('", "labels": ["abusive", "'), F.col("lang"), F.lit('"]} - done'))
        return self.table("documents").select("doc_id", (
            F.when(doc % 17 == 0, F.lit(None)).when(doc % 11 == 0, F.concat(F.lit("no verdict for "), F.col("source")))
            .when(doc % 13 == 0, F.concat(F.lit('{"should_flag": true, "score": "high", "reason": "'),
                                          F.col("source"), F.lit('"}')))
            .when(doc % 7 == 0, F.concat(F.lit('{"should_flag": tr} '), F.col("source")))
            .otherwise(verdict)).alias("response"))

    @cached_property
    def raw_posts(self) -> DataFrame:
        """Posts in the form of the archives: job_id, part, pos, tweet."""
        doc = F.col("pos")
        stamp = F.date_format("created_at", "EEE MMM dd HH:mm:ss '+0000' yyyy")
        name = doc.cast("string")
        def link(expanded, short):
            return F.struct(F.lit(expanded).alias("expanded_url") if isinstance(expanded, str) else
                            expanded.alias("expanded_url"), short.alias("url"))
        urls = F.array(
            link(F.concat(F.lit("https://example.com/"), name), F.concat(F.lit("https://t.co/"), name)),
            link("", F.concat(F.lit("https://t.co/b"), name)), link("", F.lit("")))
        entities = F.when(doc % 6 != 0, F.struct(
            urls.alias("urls"),
            F.array(F.struct(F.col("lang").alias("text")), F.struct(F.lit("").alias("text"))).alias("hashtags"),
            F.array(F.struct(F.col("source").alias("screen_name"))).alias("user_mentions"),
            F.when(doc % 2 == 0, F.array(F.struct(F.concat(
                F.lit("https://example.com/"), name, F.lit(".jpg")).alias("media_url")))).alias("media")))
        tweet = F.struct(
            F.col("tweet_id").alias("id_str"),
            F.when(doc % 4 == 3, "").otherwise(F.col("text")).alias("full_text"),
            F.when(doc % 4 == 3, F.col("text")).alias("text"),
            F.when(doc % 13 == 5, "some day").otherwise(stamp).alias("created_at"),
            entities.alias("entities"))
        return self._described_posts.select("job_id", F.expr("pos div 20").alias("part"), "pos", tweet.alias("tweet"))

    @cached_property
    def archives(self) -> DataFrame:
        """Wrapped JS files of at most 20 posts each: path, job_id, part, body."""
        # A part is 20 document ids wide, so the list below is bounded.
        element = F.to_json(F.struct("tweet"))
        listed = F.sort_array(F.collect_list(F.struct("pos", element.alias("element"))))
        body = F.concat(_by(F.col("part") % 3, HEADS), F.lit("[\n"),
                        F.array_join(F.transform("_l", lambda e: e["element"]), ",\n"), F.lit("\n];"))
        return (self.raw_posts.groupBy("job_id", "part").agg(listed.alias("_l"))
                .select(self._path().alias("path"), "job_id", "part", body.alias("body")))

    @staticmethod
    def _path() -> Column:
        return F.concat_ws("/", F.col("job_id"), F.col("part").cast("string"))

    @cached_property
    def js_files(self) -> DataFrame:
        return self.archives.select("path", "part", F.encode("body", "UTF-8").alias("content"))

    @cached_property
    def zip_files(self) -> DataFrame:
        return self.archives.select("path", "part", "body").mapInArrow(_zip_batches, "path STRING, content BINARY")

    @cached_property
    def damaged_files(self) -> DataFrame:
        """Files of which every first of four is whole."""
        kind = _by(F.col("part") % 4, DAMAGE)
        body = (F.when(kind == "cut", F.expr("left(body, length(body) - 10)"))
                .when(kind == "no array", F.concat(F.lit("not an archive: "), F.col("job_id")))
                .when(kind == "junk", F.concat(F.col("body"), F.lit(" junk];")))
                .otherwise(F.col("body")))
        return self.archives.select("path", "part", F.encode(body, "UTF-8").alias("content"))

    @cached_property
    def js_texts(self) -> DataFrame:
        """One small script per document around its whole text."""
        doc, text = F.col("doc_id"), F.col("text")
        script = (F.when(doc % 4 == 0, F.concat(F.lit("window.YTD.tweets.part0 = ["), text, F.lit("];")))
                  .when(doc % 4 == 1, F.concat(F.lit("["), text, F.lit("]")))
                  .when(doc % 4 == 2, F.concat(F.lit('window["YTD"].x =  ['), text, F.lit("];")))
                  .otherwise(text))
        return self.table("documents").select(doc.cast("string").alias("tweet_id"), script.alias("js"))
