"""What the optimiser makes of the queries."""

import re

import pytest

from postlark import views
from postlark.catalog import queries
from postlark.operators import dedup, filters, stats

QUERIES = queries()
PYTHON = re.compile("PythonUDF|ArrowEval|EvalPython|MapInPandas|FlatMapGroups")

NATIVE = [
    "flagship_top_matches", "score_breakdown", "multi_profile_scores", "multi_profile_top", "max_achievable", "content_key",
    "location_normalised", "location_fix_counts", "comp_display", "emails", "escaped_texts", "list_filtered", "recent_context",
    "by_status", "score_tiers", "alert_stats", "daily_trend", "by_search_term", "zero_result_runs", "dup_groups", "dedup_keepers",
    "rescore_changes", "rescore_summary", "rescore_state", "status_fold", "backfill_keys", "report_high", "export_rows", "page_prefix",
    "task_fanout", "seen_first", "task_cap",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def details_of(df):
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", NATIVE)
def test_native_and_without_products(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert not PYTHON.search(plan)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    rows = views.stored(spark, sf)
    plan = details_of(filters.list_postings(rows, status="new", min_score=20, source="src1").select("id", "score"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "EqualTo(status,new)" in pushed and "GreaterThanOrEqual(score,20)" in pushed and "EqualTo(source,src1)" in pushed
    assert "TakeOrderedAndProject" in plan
    for df in (stats.by_status(rows), stats.alert_stats(rows, views.SCRAPE_NOW), dedup.keepers(rows), filters.list_postings(rows).select("id")):
        read = re.search(r"ReadSchema: (.*)", details_of(df)).group(1)
        assert "description" not in read and "url" not in read


def test_alert_stats_is_one_pass(spark, sf):
    plan = plan_of(stats.alert_stats(views.stored(spark, sf), views.SCRAPE_NOW))
    assert plan.count("FileScan") == 1 and plan.count("partial_count") == 4


def test_scores_are_computed_once(spark, sf):
    """The filter on the score reads it; the text searches stay below and appear once per keyword."""
    plan = plan_of(QUERIES["flagship_top_matches"](spark, sf))
    assert plan.count("Contains(_text") == sum(len(words) for words in views.P0.keywords.values())
    assert "Generate inline" in plan


def test_groups_are_reduced_before_the_shuffle(spark, sf):
    keepers = plan_of(QUERIES["dedup_keepers"](spark, sf))
    assert "partial_min" in keepers and "Window" not in keepers
    assert plan_of(QUERIES["multi_profile_top"](spark, sf)).count("WindowGroupLimit") == 2
    folded = plan_of(QUERIES["status_fold"](spark, sf))
    assert "partial_max" in folded and "Window" not in folded
