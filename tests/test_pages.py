"""Pages at any depth, statistics from file footers, and quantile sketches."""

import random

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from clickloom.operators import ingest_checks, live, metrics

SF = "/root/testdata/sf0.001"
ORDER = "received_at timestamp, kafka_partition int, kafka_offset long, event_id string"


@pytest.fixture
def narrow(monkeypatch):
    """Pages leave the top-k early and ranges are cut often."""
    monkeypatch.setattr(live, "SHALLOW", 3)
    monkeypatch.setattr(live, "RANGES", 32)
    monkeypatch.setattr(live, "SORTED_ROWS", 5)


def made(spark, rows):
    df = spark.createDataFrame(rows, "us long, kafka_partition int, kafka_offset long, event_id string")
    return df.coalesce(2).select(F.timestamp_micros("us").alias("received_at"), "kafka_partition", "kafka_offset", "event_id")


def ordered(df):
    return df.orderBy(*live.newest_first()).collect()


SHAPES = {
    "spread": lambda d, i: (d.randrange(10**9), i % 3, i, f"e{i}"),
    "one time": lambda d, i: (7, d.randrange(3), d.randrange(20), f"e{i}"),
    "two times": lambda d, i: (d.choice([5, 10**9]), 0, i, f"e{i}"),
    "one place": lambda d, i: (7, 1, 1, f"e{i:03}"),
    "missing": lambda d, i: (d.choice([None, 3, 10**15]), d.choice([None, 1]), d.choice([None, i]), d.choice([None, f"e{i}"])),
}


@pytest.mark.parametrize("shape", list(SHAPES))
def test_deep_pages(spark, narrow, shape):
    draw = random.Random(3)
    df = made(spark, [SHAPES[shape](draw, i) for i in range(90)])
    want = ordered(df)
    for limit, offset in ((5, 40), (10, 85), (3, 500), (200, 2)):
        got = live.page_events(df, limit, offset).collect()
        key = lambda r: tuple((x is None, x) for x in r)
        assert [key(r) for r in got] == [key(r) for r in want[offset:offset + limit]], (limit, offset)


def test_pages_of_an_empty_table(spark, narrow):
    assert live.page_events(made(spark, []), 5, 50).count() == 0


def test_pages_by_key_walk_through_all_rows(spark):
    draw = random.Random(4)
    df = made(spark, [SHAPES["missing"](draw, i) for i in range(60)]).dropDuplicates().coalesce(2)
    want, at = ordered(df), 0
    page = live.page_events(df, 25)
    while rows := page.collect():
        assert rows == want[at:at + len(rows)]
        at += len(rows)
        page = live.page_after(df, rows[-1], 25)
    assert at == len(want)
    with pytest.raises(ValueError):
        live.page_after(df, want[0], 0)


def test_a_deep_page_sorts_its_range_only(spark, monkeypatch):
    monkeypatch.setattr(live, "SORTED_ROWS", 50)
    df = made(spark, [(i * 1000, 0, i, f"e{i}") for i in range(5000)])
    rows, offset = live.narrow_to(df, 20, 4000)
    assert rows.count() <= 50 and offset < 50


def test_footers_answer_counts(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 2 == 0).alias("even"), F.col("id").cast("string").alias("s"), (F.col("id") % 3).alias("part"))
    df.write.partitionBy("part").parquet(str(tmp_path / "t"))
    found = ingest_checks.footer_stats(spark, str(tmp_path / "t"), ["id"])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id)]" in text and "ReadSchema: struct<count(*)" in text
    assert tuple(found.first()) == (1000, 0, 999)
    by = {r["part"]: r["row_count"] for r in ingest_checks.footer_stats(spark, str(tmp_path / "t"), by=["part"]).collect()}
    assert by == {0: 334, 1: 333, 2: 333}
    assert tuple(ingest_checks.footer_stats(spark, str(tmp_path / "t"), ["s"]).first()) == (1000, "0", "999")
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_sketches_merge_and_stay_inside_their_bound(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("status"), F.sqrt(F.xxhash64("id") % 1000 + 1000).alias("v"))
    for q in (0.05, 0.5, 0.99):
        merged = metrics.sketch_quantile(metrics.value_sketches(df, "v", "day", "status"), q, "status")
        rows = metrics.quantile_check(df, "v", merged, "status").collect()
        assert len(rows) == 2 and all(r["within"] for r in rows) and sum(r["n"] for r in rows) == 20_000
    wrong = merged.withColumn("value", F.lit(0.0))
    assert not any(r["within"] for r in metrics.quantile_check(df, "v", wrong, "status").collect())


def test_footer_query_reads_no_column(spark):
    text = QUERIES["footer_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in text
