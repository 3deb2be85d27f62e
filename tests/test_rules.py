"""Truth tables of the repost filter, the scorer and the cascade."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postaudit import catalog, schema as S
from postaudit.functions.text import is_repost, needed, shared_words, unwrap_js
from postaudit.operators import policy, routing, rules


def texts(spark, values):
    return spark.createDataFrame([("j", str(i), t, i) for i, t in enumerate(values)],
                                 "job_id STRING, tweet_id STRING, text STRING, pos BIGINT")


@pytest.mark.parametrize("text, expected", [
    ("RT @ann: lunch at noon", True), ("RT @bob no colon", True), (" \n RT @c", True), ("lunch, RT @ann", False),
    ("rt @ann: small letters", False), ("RT @", True), ("RT", False), ("\t\n \u3000 RT @x", True),
    ("\u200bRT @x", False), ("", False), (None, False), ("   ", False)])
def test_repost(spark, text, expected):
    row = texts(spark, [text]).select(is_repost(F.col("text")).alias("r")).first()
    assert row.r is expected


@pytest.mark.parametrize("js, expected", [
    ('posts.part7 = [{"k": 9}];', '[{"k": 9}]'),
    ('[{"k": 9}, 2]', '[{"k": 9}, 2]'),
    ('posts.part7 =   [{"k": 9}];\n', '[{"k": 9}]'),
    ('a.b["c"] =\n [\n{"t": "y = [2]"}\n]\n;', '[\n{"t": "y = [2]"}\n]'),
    ('[{"t": "p = [q]"}]', '[{"t": "p = [q]"}]'),
    ("plain words", ""), ("][", ""), ("", ""), ("k = 5", "")])
def test_unwrap(spark, js, expected):
    assert texts(spark, [js]).select(unwrap_js(F.col("text")).alias("v")).first().v == expected


def scored(spark, values):
    return [r.result for r in rules.rule_scorer(texts(spark, values)).orderBy("pos").collect()]


def test_scorer_truth_table(spark):
    got = scored(spark, ["What a MORON", "they were threatening us", "we despise / I despise it", "rain until noon", "a good idea"])
    assert [(r.should_flag, r.reason) for r in got] == [
        (True, S.REASON_RULE_ABUSIVE), (True, S.REASON_RULE_THREAT), (True, S.REASON_RULE_HATE),
        (False, S.REASON_CLEAN), (False, S.REASON_CLEAN)]


def test_later_group_wins_and_labels_add_up(spark):
    [both, none] = scored(spark, ["stupid, I hate it, threaten", ""])
    assert (both.score, both.reason) == (0.95, S.REASON_RULE_THREAT)
    assert both.labels == ["abusive", "hate_speech", "threatening"]
    assert (none.should_flag, none.score, none.reason, none.labels) == (False, 0.0, S.REASON_CLEAN, [])


def test_every_listed_phrase_hits(spark):
    for phrases in (S.RULE_ABUSIVE, S.RULE_HATE, S.RULE_THREAT):
        frame = texts(spark, [f"well {p.upper()}!" for p in phrases])
        assert rules.group_hit(frame, phrases).filter("NOT hit").count() == 0
    assert needed(["threaten", "threatening"]) == ["threaten"]


@pytest.mark.parametrize("phrases", [
    S.RULE_ABUSIVE, S.RULE_HATE, S.RULE_THREAT, S.CASCADE_THREAT, S.CASCADE_HATE, ["kill a", "kill b", "b kill", "kill"]])
def test_every_phrase_is_kept_under_some_word(phrases):
    groups = shared_words(phrases)
    assert sorted(p for members in groups.values() for p in members) == sorted(phrases)
    assert all(word in p for word, members in groups.items() for p in members)


def test_brackets_are_literal(spark):
    [literal, other] = scored(spark, ["all [group] are late", "all g are late"])
    assert literal.should_flag and not other.should_flag


CASES = ["I love Crypto and you should die", "you should DIE", "he deserves to die", "KYS", "fine", None]


def test_cascade_first_hit_wins(spark):
    rows = rules.apply_cascade(texts(spark, CASES), ["", "zzz", "cRyPto", "love"]).orderBy("pos").collect()
    got = [r.filter_result and (r.filter_result.filter_reason, r.filter_result.score, r.filter_result.reason)
           for r in rows]
    assert got == [
        ("blocked_phrase", 1.0, "Contains blocked phrase: cRyPto"),
        ("threat", 1.0, S.REASON_CASCADE_THREAT),
        ("hate_speech", 0.95, S.REASON_CASCADE_HATE),
        ("threat", 1.0, S.REASON_CASCADE_THREAT), None, None]


@pytest.mark.parametrize("phrases", [[], [""]])
def test_cascade_without_phrases(spark, phrases):
    rows = rules.apply_cascade(texts(spark, CASES), phrases).orderBy("pos").collect()
    assert [r.filter_result and r.filter_result.filter_reason for r in rows] == [
        "threat", "threat", "hate_speech", "threat", None, None]


@pytest.mark.parametrize("size", [1, 2, 4])
def test_policy_table(spark, size):
    phrases = ["", "zz", "Stupid", "a", "ÄRGER", "late", "quick brown", "é", "LATE"]
    table = spark.createDataFrame(list(enumerate(phrases)), "rank INT, phrase STRING")
    frame = texts(spark, ["the Quick Brown fox", "stupid and late", "zZ", "", None, "xyz", "große ärger", "café É",
                          "lat", "quick brow", "bb" * 2000 + "LATE"])
    expected = {}
    for row in frame.collect():
        hit = next((p for p in phrases if p and row.text and p.lower() in row.text.lower()), None)
        if hit:
            expected[row.tweet_id] = hit
    matched = policy.match_policy(frame, table, size=size)
    assert {r.tweet_id: r.phrase for r in matched.collect()} == expected
    assert matched.first().reason.startswith("Contains blocked phrase: ")
    assert policy.match_policy(frame, table.limit(0)).count() == 0


def test_policy_plan_moves_no_phrases_to_the_driver(spark, monkeypatch):
    frame = texts(spark, [f"text {i} with word{i % 7} and the rest" for i in range(300)] + ["same words here"] * 200)
    table = spark.createDataFrame([(i, f"word{i}") for i in range(5)] + [(9, "the rest"), (3, "same words")], "rank INT, phrase STRING")
    monkeypatch.setattr(policy, "HOT_SHARE", 10 ** 6)
    got = policy.match_policy(frame, table)
    want = {f"word{i}": sum(1 for j in range(300) if j % 7 == i) for i in range(5)}
    want |= {"the rest": sum(1 for j in range(300) if j % 7 > 4), "same words": 200}
    assert {r.phrase: r["count"] for r in got.groupBy("phrase").count().collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_hot_grams_are_dealt(spark, monkeypatch):
    """Every text has the phrases' grams, so with a low bound all are hot; the result stays the same."""
    frame = texts(spark, [f"abab {i}" for i in range(3000)])
    table = spark.createDataFrame([(2, "abab"), (1, "bab 1"), (0, "ab 29")], "rank INT, phrase STRING")
    plain = sorted(policy.match_policy(frame, table).collect())
    monkeypatch.setattr(policy, "SAMPLE", 1)
    monkeypatch.setattr(policy, "HOT_LEAST", 10)
    assert sorted(policy.match_policy(frame, table).collect()) == plain and len(plain) == 3000


def first_held(text, policy, whole_words=False):
    """The phrase of least (rank, spelling) that a text holds, a missing rank before all others."""
    def held(low, phrase):
        return re.search(rf"(?<!\w){re.escape(phrase)}(?!\w)", low) if whole_words else phrase in low

    order = sorted((rank is not None, rank or 0, phrase) for rank, phrase in policy if phrase)
    return next((phrase for *_, phrase in order if held(text.lower(), phrase.lower())), None)


@pytest.mark.parametrize("whole_words", [False, True])
@pytest.mark.parametrize("few, many", [(500, 100_000), (500, 0), (0, 100_000), (0, 0)])
def test_phrases_of_words_and_within_words(spark, monkeypatch, few, many, whole_words):
    monkeypatch.setattr(policy, "FEW_SHORT", few)
    monkeypatch.setattr(policy, "MANY_LONG", many)
    monkeypatch.setattr(policy, "SAMPLE", 1)
    monkeypatch.setattr(policy, "HOT_LEAST", 10)
    rng = random.Random(7)
    words = ["a", "fog", "Foggy", "late", "plate", "é", "x,", "\nrow", ""]
    frame = texts(spark, [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(400)] + ["", " ", "nothing"])
    table = [(rng.choice([None, 1, 2, 3, 50, 60]), " ".join(rng.choices(words, k=rng.randint(1, 5)))) for _ in range(40)]
    table += [(70, " "), (71, "  "), (40, "og a"), (41, "ate late fo"), (42, " fog "), (43, "oggy é x"), (44, "no such inner words")]
    if whole_words:  # next to an empty side a blank is no word
        table = [(rank, phrase) for rank, phrase in table if phrase.strip()]
    got = policy.match_policy(frame, spark.createDataFrame(table, "rank INT, phrase STRING"), whole_words)
    assert {r.tweet_id: r.phrase for r in got.collect()} == {
        r.tweet_id: first for r in frame.collect() if (first := first_held(r.text, table, whole_words))}


def test_few_phrases_need_no_grams_of_the_texts(spark, monkeypatch):
    """Inner words and a handful of short phrases do without the grams of all characters of all texts."""
    def refused(*_):
        raise AssertionError("the texts' characters were split")

    monkeypatch.setattr(policy, "grams", refused)
    frame = texts(spark, ["one two three four", "Late again", "plates"])
    table = spark.createDataFrame([(1, "e two three f"), (2, "late")], "rank INT, phrase STRING")
    got = policy.match_policy(frame, table)
    assert {r.tweet_id: r.phrase for r in got.collect()} == {"0": "e two three f", "1": "late", "2": "late"}


def test_hot_short_phrases_found_by_grams(spark, monkeypatch):
    monkeypatch.setattr(policy, "FEW_SHORT", 0)
    test_hot_grams_are_dealt(spark, monkeypatch)


def test_options_of_a_table(spark):
    crit = "named_struct('forbidden_words', array('', 'Fog', 'zz'))"
    frame = texts(spark, ["a cat.", "category", "dense FOG, cat", "fog and go die", "go die", "clear", None]).withColumn(
        "criteria", F.expr(f"CASE WHEN pos <> 5 THEN {crit} END"))
    table = spark.createDataFrame([(0, "Cat")], "rank INT, phrase STRING")
    for options in ({}, {"whole_words": True}, {"forbidden_words": True}, {"whole_words": True, "forbidden_words": True}):
        by_list, by_table = ([(r.pos, r.filter_result) for r in routing.route(frame, p, **options).orderBy("pos").collect()]
                             for p in (["Cat"], table))
        assert by_list == by_table


def test_routes_by_list_table_and_without_policy(spark):
    phrases = ["", "zzz", "cRyPto", "love"]
    frame = texts(spark, CASES).withColumn("criteria", F.expr("CASE WHEN pos <> 3 THEN named_struct('tone', 'x') END"))
    table = spark.createDataFrame(list(enumerate(phrases)), "rank INT, phrase STRING")
    by_list, by_table, without = ([(r.pos, r.route, r.filter_result) for r in routing.route(frame, p).orderBy("pos").collect()]
                                  for p in (phrases, table, None))
    assert by_list == by_table and [r[1] for r in by_list] == ["flagged_now"] * 3 + ["needs_scoring"] * 3
    assert {r[1:] for r in without} == {("needs_scoring", None)}


def test_gate_and_routes(spark):
    crit = "named_struct('tone', 'x')"
    frame = texts(spark, ["kys", "kys", "hello"]).withColumn(
        "criteria", F.expr(f"CASE WHEN pos <> 1 THEN {crit} END"))
    got = [r.route for r in routing.route(frame, []).orderBy("pos").collect()]
    assert got == ["flagged_now", "needs_scoring", "needs_scoring"]
    without = [r.route for r in routing.route(frame, [], scorer_present=False).orderBy("pos").collect()]
    assert without == ["flagged_now", "processed", "processed"]


def test_one_pass_equals_union(spark):
    frame = texts(spark, ["kys", "I hate it", "ok", "deserves to die", "crypto stupid"]).withColumn(
        "criteria", F.expr("CASE WHEN pos <> 0 THEN named_struct('tone', 'x') END")).withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))
    stamp = F.lit("2024-02-01").cast("timestamp")
    judged = routing.route(frame, ["crypto"])
    rest = rules.rule_scorer(judged.filter("route = 'needs_scoring'"))
    union = routing.union_flags(routing.filter_flags(judged, stamp), routing.scorer_flags(rest, stamp))
    once = routing.flag_in_one_pass(frame, ["crypto"], stamp)
    assert sorted(union.collect()) == sorted(once.collect())
    assert union.count() == 4


def test_options_of_a_list(spark):
    crit = "named_struct('forbidden_words', array('', 'Fog', 'zz'))"
    frame = texts(spark, ["a cat.", "category", "dense FOG, cat", "fog and go die", "go die", "clear"]).withColumn(
        "criteria", F.expr(f"CASE WHEN pos <> 5 THEN {crit} END"))

    def reasons(**options):
        rows = routing.route(frame, ["Cat"], **options).orderBy("pos").collect()
        return [r.filter_result and r.filter_result.reason for r in rows]

    cat, fog, threat = "Contains blocked phrase: Cat", "Contains blocked phrase: Fog", S.REASON_CASCADE_THREAT
    assert reasons() == [cat, cat, cat, threat, threat, None]
    assert reasons(whole_words=True) == [cat, None, cat, threat, threat, None]
    assert reasons(forbidden_words=True) == [cat, cat, cat, fog, threat, None]


def test_policy_join_needs_no_grams(spark, monkeypatch):
    """The query's two phrases are looked for in the texts as they stand; no text is split into characters."""
    monkeypatch.setattr(policy, "explode_grams", lambda *_: pytest.fail("grams of all texts"))
    rows = catalog.queries()["policy_join"](spark, "/root/testdata/sf0.001").collect()
    assert {r.phrase for r in rows} == {"Crypto", "late"}
