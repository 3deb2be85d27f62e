"""Prompt, response and call handling around an external model, played by a function."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postaudit.functions import calls as C, responses as R
from postaudit.functions.criteria import criteria_or_default, parse_criteria
from postaudit.functions.prompts import build_prompt, escape_text
from postaudit.operators.scoring import model_scorer, waves
from postaudit.plans.audit import History, audit_posts


def prompt_for(spark, text, criteria):
    frame = spark.createDataFrame([(text, dt.datetime(2024, 3, 5), criteria)], "t STRING, at TIMESTAMP, c STRING")
    return frame.select(build_prompt(F.col("t"), F.col("at"), criteria_or_default(parse_criteria(F.col("c"))))).first()[0]


def test_prompt_defaults(spark):
    lines = prompt_for(spark, 'say "hi"\nthere', None).split("\n")
    assert lines[:13] == [
        "You are a content moderation assistant. Evaluate this tweet based on the provided criteria.", "",
        "Tweet posted on: March 5, 2024", 'Tweet text: "say \\"hi\\" there"', "", "MODERATION CRITERIA:",
        "Flag tweets that contain:", "   - Threats of violence or harm",
        "   - Hate speech or discrimination targeting groups", "   - Harassment or targeted abuse",
        "   - Severe profanity used aggressively", "", "DO NOT flag tweets that are:"]
    assert lines[17] == "   - Express political opinions (unless they violate other criteria)"
    assert lines[18:22] == [
        "", "4. Expected tone: respectful and thoughtful. Flag tweets that significantly deviate from this tone.",
        "", '3. Consider context - a tweet saying "I hate Mondays" is NOT hate speech unless it targets a specific group.']


def test_prompt_own_criteria(spark):
    text = prompt_for(spark, "x", '{"forbidden_words": ["a", "b c"], "professional_check": true, "exclude_politics": true}')
    assert ("   - Unprofessional language or tone\n   - Political content or statements\n"
            "   - Contains forbidden words/phrases: a, b c\n\nDO NOT") in text
    assert "   - Use profanity in non-aggressive contexts\n\n\n3. Consider" in text
    assert "Expected tone" not in text and "political opinions" not in text
    assert "   None specified\n" in prompt_for(spark, "x", "{}")


def test_escape(spark):
    frame = spark.createDataFrame([('a"b\r\nc\\',)], "t STRING")
    assert frame.select(escape_text(F.col("t"))).first()[0] == 'a\\"b  c\\'


@pytest.mark.parametrize("response, expected", [
    ('ok {"should_flag": true, "score": 0.7, "reason": "r", "labels": ["a"]} bye', (True, 0.7, "r", ["a"], None)),
    ('{"should_flag": false, "score": -3}', (False, 0.0, "", None, None)),
    ('{"score": 7}', (False, 1.0, "", None, None)), ("{}", (False, 0.0, "", None, None)),
    ("no", (None, None, None, None, "invalid response format: no")),
    ("", (None, None, None, None, "invalid response format: ")),
    (None, (None, None, None, None, "invalid response format: ")),
    ("} {", (None, None, None, None, "invalid response format: } {")),
    ('{"score": "high"}', (None, None, None, None, R.BAD_VERDICT)),
    ('{"should_flag": true', (None, None, None, None, 'invalid response format: {"should_flag": true')),
    ('{"a": 1} and {"b": 2}', (None, None, None, None, R.BAD_VERDICT))])
def test_verdict(spark, response, expected):
    frame = spark.createDataFrame([(response,)], "r STRING").select(R.parse_verdict(F.col("r")).alias("v"))
    assert tuple(frame.first().v) == expected
    safe = frame.select(R.or_error_default(F.col("v")).alias("s")).first().s
    if expected[4]:
        assert tuple(safe) == (False, 0.0, "Error: " + expected[4], None)
    else:
        assert tuple(safe) == expected[:4]


@pytest.mark.parametrize("body, text, error", [
    ('{"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}, {}]}', "a", None),
    ('{"candidates": []}', None, R.EMPTY_ENVELOPE), ("{}", None, R.EMPTY_ENVELOPE),
    ('{"candidates": [{"content": {"parts": []}}]}', None, R.EMPTY_ENVELOPE), ("<html>", None, R.BAD_ENVELOPE)])
def test_envelope(spark, body, text, error):
    row = spark.createDataFrame([(body,)], "b STRING").select(R.open_envelope(F.col("b")).alias("o")).first().o
    assert (row.text, row.error) == (text, error)


@pytest.mark.parametrize("status, body, attempt, outcome, delay", [
    (200, "", 0, "ok", None), (401, "", 0, "critical", None), (404, "", 0, "critical", None),
    (400, "", 0, "permanent", None), (429, "Daily quota hit", 2, "daily_quota", None),
    (429, "Daily quota hit", 3, "rate_limited", None), (429, "slow", 0, "rate_limited", 60.0),
    (429, "slow", 2, "rate_limited", 240.0), (429, "DAILY QUOTA", 1, "rate_limited", 120.0),
    (503, "", 2, "retryable", 4.0), (503, "", 3, "retryable", None), (None, "timeout", 0, "retryable", 1.0)])
def test_calls(spark, status, body, attempt, outcome, delay):
    frame = spark.createDataFrame([(status, body, attempt)], "s INT, b STRING, a INT")
    row = frame.select(C.call_class(F.col("s"), F.col("b"), F.col("a")).alias("c"), "a").select(
        "c", C.retry_delay(F.col("c"), F.col("a")).alias("d")).first()
    assert (row.c, row.d) == (outcome, delay)


def test_delay_is_capped(spark):
    frame = spark.createDataFrame([(3,)], "a INT")
    assert frame.select(C.retry_delay(F.lit("rate_limited"), F.col("a"), 9)).first()[0] == 300.0


def fake_model():
    def answer(prompts):
        if any("crash" in p for p in prompts):
            raise ValueError("boom")
        return ['{"should_flag": true, "score": 2, "reason": "bad tone"}' if "rude" in p else
                "nothing to say" if "mute" in p else '{"should_flag": false}' for p in prompts]

    return answer


def posts_of(spark, texts):
    rows = [("j", str(i), t, dt.datetime(2024, 1, 1), i) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "job_id STRING, tweet_id STRING, text STRING, created_at TIMESTAMP, pos BIGINT").coalesce(1)


def job_j(spark):
    return spark.createDataFrame([("j", None)], "job_id STRING, criteria STRING").select(
        "job_id", parse_criteria(F.col("criteria")).alias("criteria"))


def test_model_scorer_in_an_audit(spark):
    posts = posts_of(spark, ["rude", "nice", "mute", "crash", "rude"])
    waits = []
    scorer = model_scorer(fake_model(), pause=waits.append)
    audit = audit_posts(posts, job_j(spark), [], dt.datetime(2024, 2, 1), scorer=scorer)
    got = {r.tweet_id: (r.result.should_flag, r.result.score, r.result.reason, r.score_status)
           for r in audit.scored.collect()}
    assert got == {
        "0": (True, 1.0, "bad tone", "scored"), "1": (False, 0.0, "", "scored"),
        "2": (False, 0.0, "Error: invalid response format: nothing to say", "failed"),
        "3": (False, 0.0, "Error: retryable: boom", "failed"), "4": (True, 1.0, "bad tone", "scored")}
    assert waits == [1.0, 2.0, 4.0]
    assert {(r.tweet_id, r.text, r.filter_reason) for r in audit.flagged.collect()} == {
        ("0", "rude", "llm_scorer"), ("4", "rude", "llm_scorer")}
    p = audit.progress.first()
    assert (p.total, p.processed, p.calls, p.flagged) == (5, 5, 3, 2)


def service():
    def answer(prompts):
        kinds = {"spent": (429, "daily quota reached"), "locked": (401, "no key"), "broken": (400, "bad"), "silent": None}
        return [next((a for k, a in kinds.items() if k in p), (200, '{"should_flag": true}')) for p in prompts]

    return answer


def test_statuses_of_a_service(spark):
    posts = posts_of(spark, ["fine", "spent", "locked", "broken", "silent"])
    audit = audit_posts(posts, job_j(spark), [], dt.datetime(2024, 2, 1), scorer=model_scorer(service(), pause=[].append))
    got = {r.tweet_id: (r.score_status, r.score_error, r.result.should_flag) for r in audit.scored.collect()}
    assert got == {"0": ("scored", None, True), "2": ("failed", "critical: 401: no key", False),
                   "3": ("failed", "permanent: 400: bad", False),
                   "4": ("failed", "invalid response format: ", False)}
    assert [r.tweet_id for r in audit.waiting.collect()] == ["1"]
    assert audit.status.first().status == "paused_quota"


def test_rate_limited_calls_are_asked_again(spark, tmp_path):
    def answer(prompts):
        first = not (tmp_path / "seen").exists()
        (tmp_path / "seen").touch()
        return [(429, "slow down") if first else "{}" for _ in prompts]

    waits = []
    rows = model_scorer(answer, pause=waits.append)(
        posts_of(spark, ["a", "b"]).crossJoin(job_j(spark).select(criteria_or_default(F.col("criteria")).alias("criteria"))))
    assert {r.score_status for r in rows.collect()} == {"scored"} and waits == [60.0]


def test_a_wrong_number_of_answers_fails_the_batch(spark):
    rows = model_scorer(lambda prompts: ["{}"] * (len(prompts) + 1), pause=[].append)(
        posts_of(spark, ["a", "b"]).crossJoin(job_j(spark).select(criteria_or_default(F.col("criteria")).alias("criteria"))))
    assert {(r.score_status, r.score_error) for r in rows.collect()} == {("failed", "permanent: 400: 3 answers to 2 prompts")}


def test_waves_grow():
    assert waves(0) == waves(200) == [1 << 30]
    assert waves(2500, 200) == [(1 << 30) * 200 // 2500, (1 << 30) * 2200 // 2500, 1 << 30]
    assert len(waves(10 ** 10)) == 9


@pytest.mark.parametrize("answer,asked_as", [((401, "no key"), "failed"), ((429, "daily quota reached"), "waiting")])
def test_a_model_out_of_order_gets_one_wave(spark, tmp_path, answer, asked_as):
    """The posts that were not asked wait, and are answered by a later run once the model works."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def down(prompts):
        for p in prompts:
            (calls / str(hash(p))).touch()
        return [answer] * len(prompts)

    posts, now = posts_of(spark, [f"text number {i}" for i in range(500)]), dt.datetime(2024, 2, 1)
    audit = audit_posts(posts, job_j(spark), [], now, scorer=model_scorer(down, pause=[].append, wave=20))
    asked = len(list(calls.iterdir()))
    assert 5 <= asked <= 60
    rows = audit.scored.collect()
    assert {r.score_status for r in rows} == ({"failed"} if asked_as == "failed" else set())
    assert len(rows) == (asked if asked_as == "failed" else 0) and audit.waiting.count() == 500 - len(rows)
    assert audit.status.first().status != "done" and audit.progress.first().processed == len(rows)

    before = History(audit.posts, audit.flagged, audit.scored, audit.waiting)
    later = audit_posts(posts, job_j(spark), [], now, scorer=model_scorer(fake_model(), wave=20), before=before)
    assert later.waiting.count() == 0 and later.progress.first().processed == 500
    assert later.new_scores.filter("score_status = 'scored'").count() == 500 - len(rows)
