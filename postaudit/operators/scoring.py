"""Plugging a scorer in: any function DataFrame -> DataFrame that adds the struct `result`."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from postaudit import schema as S
from postaudit.functions.calls import call_class, retry_delay
from postaudit.functions.prompts import build_prompt
from postaudit.functions.responses import or_error_default, parse_verdict
from postaudit.session import materialise

Scorer = Callable[[DataFrame], DataFrame]
Answer = str | tuple[int, str] | None
Model = Callable[[list[str]], list[Answer]]

SCORED, FAILED, WAITING = "scored", "failed", "waiting"

WAVE = 200
"""Posts of the first wave of calls, about; each next wave is up to ten times as large."""
HALTED = "halted"
_ENDS = ("critical", "daily_quota")
_STEPS = 1 << 30


def _ask(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds status and response; a plain text answer has status 200, a call without any answer none."""
    def one(prompt: str) -> Answer:
        try:
            return model([prompt])[0]
        except Exception as failure:
            return None, str(failure)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = batch["prompt"].tolist()
            try:
                answers = list(model(prompts))
            except Exception:  # a failing batch is asked again post by post
                answers = [one(p) for p in prompts]
            if len(answers) != len(prompts):
                answers = [(400, f"{len(answers)} answers to {len(prompts)} prompts")] * len(prompts)
            pairs = [a if isinstance(a, tuple) else (200, a) for a in answers]
            yield batch.assign(status=pd.array([s for s, _ in pairs], "Int32"), response=[b for _, b in pairs])

    return run


def waves(n: int, first: int = WAVE) -> list[int]:
    """Bounds in a hash's 2**30 values that deal `n` rows to waves: `first`, ten times as many, and so on."""
    bounds, total, size = [], 0, first
    while total + size < n:
        total += size
        bounds.append(_STEPS * total // n)
        size *= 10
    return [*bounds, _STEPS]


def model_scorer(model: Model, retries: int = S.MAX_RETRIES, pause: Callable[[float], None] = time.sleep,
                 wave: int = WAVE) -> Scorer:
    """A scorer that sends each post's prompt to `model`, a function from prompts to answers.

    An answer is the response text, or (status, body) as the service gave it; an exception is a call without
    answer. Calls that may work later are asked again after their delay, up to `retries` times, all of an
    attempt together. A post that meets the daily quota gets score_status `waiting` and is not scored;
    one whose call, format or batch is bad gets the unflagged error result and `failed`. Each attempt is
    written, so answers that were paid for are not asked for again. Posts must carry `criteria`;
    they do not go to Python, being part of the prompt.

    Calls go out in growing waves. An answer that says that no call can work now (a critical status, such as a
    wrong key, or the day's quota) ends the run: what has been asked ends as above, the posts not yet asked, or to be asked
    again, wait for a later run, so a whole table is never used up by a model that is out of order.
    """
    def score(posts: DataFrame) -> DataFrame:
        prompt = build_prompt(F.col("text"), F.col("created_at"), F.col("criteria"))
        asked, done = posts.withColumn("prompt", prompt).drop("criteria"), None
        answer = T.StructType([*asked.schema.fields, T.StructField("status", T.IntegerType()),
                               T.StructField("response", T.StringType())])
        asked = materialise(asked.withColumn("_turn", F.pmod(F.xxhash64("prompt", "job_id", "tweet_id"), F.lit(_STEPS))))
        bounds = waves(asked.count(), wave)

        def ask(rows: DataFrame, attempt: int) -> tuple[DataFrame, bool]:
            outcome = call_class(F.col("status"), F.col("response"), F.lit(attempt), retries)
            delay = retry_delay(F.col("outcome"), F.lit(attempt), retries)
            tried = materialise(rows.drop("_turn").mapInPandas(_ask(model), answer).withColumn("outcome", outcome)
                                .withColumn("delay", delay))
            return tried, not tried.filter(F.col("outcome").isin(*_ENDS)).isEmpty()

        low, halted, again, unasked = 0, False, None, asked.limit(0).drop("_turn")
        for high in bounds:
            tried, halted = ask(asked.filter((F.col("_turn") >= low) & (F.col("_turn") < high)), 0)
            done = tried if done is None else done.unionByName(tried)
            low = high
            if halted:
                unasked = asked.filter(F.col("_turn") >= high).drop("_turn")
                break
        for attempt in range(1, retries + 1):
            again, done = done.filter("delay IS NOT NULL"), done.filter("delay IS NULL")
            wait = again.agg(F.max("delay")).first()[0]
            if wait is None:
                break
            if halted:
                unasked = unasked.unionByName(again.select(*unasked.columns))
                break
            pause(wait)
            tried, halted = ask(again.select(*unasked.columns), attempt)
            done = done.unionByName(tried)
        none = {"status": "int", "response": "string", "delay": "double"}
        done = done.unionByName(unasked.withColumns({n: F.lit(None).cast(t) for n, t in none.items()}).withColumn(
            "outcome", F.lit(HALTED)))
        read = done.withColumn("_verdict", parse_verdict(F.col("response")))
        good = F.col("outcome") == "ok"
        error = F.when(good, F.col("_verdict.error")).otherwise(
            F.concat_ws(": ", F.col("outcome"), F.col("status").cast("string"), F.col("response")))
        outcome = F.struct(*[F.col(f"_verdict.{n}").alias(n) for n in ("should_flag", "score", "reason", "labels")],
                           error.alias("error"))
        status = F.when(error.isNull(), SCORED).when(F.col("outcome").isin("daily_quota", HALTED), WAITING).otherwise(FAILED)
        return (read.withColumn("result", or_error_default(outcome)).withColumn("score_status", status)
                .withColumn("score_error", error)
                .drop("_verdict", "response", "status", "outcome", "delay", "prompt"))

    return score
