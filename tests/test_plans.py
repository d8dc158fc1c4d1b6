"""Physical plans: what must and must not be in them."""

import re

import pytest

from checks.queries import QUERIES
from clickloom.operators import insights, periods, sessions
from clickloom.sources import sample

SF = "/root/testdata/sf0.001"
# these run a job while they are defined, or are covered by their batch twin
EAGER = ("stream", "pipeline", "load_history", "load_live", "event_table", "insights_report", "report_", "sessionize_fixed")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", text)


def test_filters_and_columns_reach_the_files(spark):
    events = sample.clickstream(spark, SF, since="2024-01-24 00:00:00")
    text = plan(insights.activity_heatmap(events))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


@pytest.mark.parametrize("name", ["kpis", "funnel", "activity_trends_daily", "top_paths", "cta_leaderboard", "visitor_mix"])
def test_one_scan(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["kpis", "funnel", "activity_trends_daily", "top_events", "visitor_mix", "rates", "event_counters", "session_summary"])
def test_counts_aggregate_by_hash(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "SortAggregate" not in text and "partial_" in text


@pytest.mark.parametrize("name", ["dedupe_events", "top_paths"])
def test_ranks_are_cut_before_the_shuffle(spark, name):
    limits = re.findall("WindowGroupLimit.*(Partial|Final)", plan(QUERIES[name](spark, SF)))
    assert set(limits) == {"Partial", "Final"}


def test_pages_are_read_once(spark):
    rows = sessions.session_rows(periods.events_in_window(sample.clickstream(spark, SF), 30 * 86400, sample.AS_OF))
    rows.collect()
    final = plan(rows).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 2


def test_lists_end_in_a_top_k(spark):
    for name in ("top_pages", "top_events", "event_page", "verify_table", "preferred_topk", "top_components"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["dedupe_events", "offset_gaps"])
def test_messages_are_parsed_once(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("from_json") == 1
