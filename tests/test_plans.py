"""Properties of physical plans that decide how the queries behave on large data."""

import re

import pytest

import __spark_entry__ as E
from postaudit import catalog
from postaudit.fixtures import Views
from postaudit.operators import rules, serving

FOLDER = "/root/testdata/sf0.001"
SMALL_RESULTS = {"flagged_by_id", "page_meta"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_cross_join_and_no_one_task_window(spark, name):
    text = plan(E.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    if name != "quota_admission":  # sums the sizes of partitions, one row each
        assert not re.search(r"Window \[.*\], \[\], ", text)


def test_scorer_scans_two_columns_and_shuffles_nothing(spark):
    text = plan(E.queries()["rule_flags"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "Exchange" not in text


def test_text_is_lowered_once_per_row(spark):
    text = plan(E.queries()["rule_flags"](spark, FOLDER))
    assert text.count("lower(") == 1


def test_key_only_queries_do_not_read_texts(spark):
    for name in ("post_key", "post_url", "flag_id", "quota_usage"):
        assert "text:string" not in plan(E.queries()[name](spark, FOLDER))


def test_texts_are_not_shuffled_for_progress(spark):
    text = plan(E.queries()["job_progress"](spark, FOLDER))
    for line in text.splitlines():
        if "Exchange" in line:
            assert "text" not in line


def test_page_is_a_top_k(spark):
    views = Views(spark, FOLDER)
    assert "TakeOrderedAndProject" in plan(serving.flagged_page(views.flagged, page=2))


def test_scorer_stays_in_generated_code(spark):
    views = Views(spark, FOLDER)
    body = plan(rules.keep_flagged(rules.rule_scorer(views.originals)))
    for line in body.splitlines():
        if re.search(r"(Generate|Filter|Project) ", line) and "FileScan" not in line:
            assert re.search(r"\*\(\d+\)", line)
