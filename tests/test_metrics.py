import pytest
from pyspark.sql import functions as F

from clickloom.operators import metrics
from clickloom.sources import documents
from conftest import AS_OF, DAY


def observed(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "duration_s double")


def test_buckets_are_cumulative_and_inclusive(spark):
    rows = metrics.latency_histogram(observed(spark, [0.05, 0.06, 45, 46]), "duration_s", (0.05, 1.0, 45.0)).collect()
    assert [(r["le"], r["cumulative"]) for r in rows] == [(0.05, 1), (1.0, 2), (45.0, 3), (float("inf"), 4)]
    assert {(r["count"], round(r["sum"], 2)) for r in rows} == {(4, 91.11)}


@pytest.mark.parametrize("q,want", [(0.5, 1.0), (0.25, 0.5), (0.75, 1.5), (1.0, 2.0)])
def test_quantile_is_linear_inside_a_bucket(spark, q, want):
    histogram = metrics.latency_histogram(observed(spark, [0.5, 0.6, 1.5, 1.6]), "duration_s", (1.0, 2.0))
    assert metrics.histogram_quantile(histogram, q).first()["value"] == want


def test_quantile_above_the_last_bound(spark):
    histogram = metrics.latency_histogram(observed(spark, [0.5, 9, 9]), "duration_s", (1.0, 2.0))
    assert metrics.histogram_quantile(histogram, 0.95).first()["value"] == 2.0


def test_quantile_of_nothing(spark):
    histogram = metrics.latency_histogram(observed(spark, [1]).where("false"), "duration_s", (1.0, 2.0))
    assert metrics.histogram_quantile(histogram, 0.5).first()["value"] is None


def test_components(make_events):
    events = make_events(
        {"props": '{"button":"a"}', "t": 3}, {"props": '{"button":"a"}', "t": 4}, {"props": '{"tab":"b"}', "t": 1}, {"t": 0}, {"t": 0},
    )
    counters = {(r["event_name"], r["component"]): r["total"] for r in metrics.event_counters(events).collect()}
    assert counters == {("$pageview", "button:a"): 2, ("$pageview", "tab:b"): 1, ("$pageview", "-"): 2}
    assert [(r["component"], r["total"]) for r in metrics.top_components(events).collect()] == [("button:a", 2), ("tab:b", 1)]
    rates = {r["component"]: r["per_second"] for r in metrics.component_rate(events, DAY, AS_OF).collect()}
    assert rates == {"button:a": 2 / DAY, "tab:b": 1 / DAY}
    assert metrics.throughput(events, DAY, AS_OF).first()[0] == 5 / DAY


def test_rates_and_outcomes(spark):
    df = spark.createDataFrame([("error", "2024-01-10 23:59:59"), ("success", "2024-01-10 23:59:50"), ("success", "2024-01-01 00:00:00")], "status string, t string")
    df = df.select("status", F.col("t").cast("timestamp").alias("received_at"))
    assert {tuple(r) for r in metrics.publish_outcomes(df).collect()} == {("error", 1), ("success", 2)}
    assert tuple(metrics.error_rate(df, 60, AS_OF).first()) == (2 / 60, 1 / 60, 0.5)


LINES = [
    "# HELP clicks_total help", "clicks_total 3", 'clicks_total{a="x",b="y}"} 4.5 1700000', 'clicks_total{b="y}",a="x"} 7',
    'other_total{a="x"} 1', "clicks_total{a=\"q\\\"u\\\\o\\nte\"} 1e3", "clicks_bad{} word", "clicks_created 5", "clicks_inf +Inf",
]


def test_exposition_lines(spark):
    df = spark.createDataFrame([(line, i) for i, line in enumerate(LINES)], "value string, line_no long")
    rows = documents.parse_samples(df, "clicks_", exclude_prefix="clicks_created").collect()
    got = {(r["line_no"], r["metric"]): (r["labels"], r["value"]) for r in rows}
    assert got[(1, "clicks_total")] == ({}, 3.0)
    assert got[(2, "clicks_total")] == ({"a": "x", "b": "y}"}, 4.5)
    assert got[(5, "clicks_total")] == ({"a": 'q"u\\o\nte'}, 1000.0)
    assert sorted(k[0] for k in got) == [1, 2, 3, 5, 8]


def test_later_source_and_line_win(spark):
    rows = [("m", {"a": "1", "b": "2"}, 0, 0, 1.0), ("m", {"b": "2", "a": "1"}, 1, 0, 2.0), ("m", {"b": "2", "a": "1"}, 1, 1, 3.0), ("m", {}, 0, 5, 9.0)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, source_rank int, line_no long, value double")
    got = {r["label_text"]: (r["value"], r["source_rank"]) for r in metrics.latest_samples(df).collect()}
    assert got == {"a=1,b=2": (3.0, 1), "": (9.0, 0)}


def test_old_relay_files_are_left_out(spark, tmp_path):
    import os

    for name, at in (("fresh.prom", 1704931195), ("stale.prom", 1704931100)):
        (tmp_path / name).write_text("clicks_total 1\nother 2\n")
        os.utime(tmp_path / name, (at, at))
    lines = documents.metric_lines(spark, str(tmp_path), AS_OF)
    assert documents.parse_samples(lines, "clicks_").count() == 1
