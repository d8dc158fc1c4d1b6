"""Counters, histograms, quantiles and merged metric samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from clickloom import taxonomy as tx
from clickloom.operators import envelope, periods


def _with_component(events: DataFrame) -> DataFrame:
    return events if "component" in events.columns else envelope.with_component(events)


def event_counters(events: DataFrame) -> DataFrame:
    """Events per name and component; the same on a stream, as running totals."""
    return _with_component(events).groupBy("event_name", "component").agg(F.count("*").alias("total"))


def publish_outcomes(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("status").agg(F.count("*").alias("total"))


def latency_histogram(
    observations: DataFrame, column: str = "duration_s", bounds: Sequence[float] = tx.PUBLISH_LATENCY_BOUNDS, *by: str
) -> DataFrame:
    """Cumulative buckets per ``le`` with sum and count; the last bound is infinity."""
    v = F.col(column)
    wide = observations.where(v.isNotNull()).groupBy(*by).agg(
        *[F.count_if(v <= b).alias(f"_le{i}") for i, b in enumerate(bounds)],
        F.count("*").alias("count"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_le{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cumulative")))
    return wide.select(*by, F.inline(F.array(*rows)), "count", "sum")


def histogram_quantile(histogram: DataFrame, q: float, *by: str) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket holding the rank.

    Above the last finite bound the answer is that bound. The windows run over the
    buckets of one histogram, a fixed number of rows.
    """
    keys = list(by) or [F.lit(0)]
    w = W.Window.partitionBy(*keys).orderBy("le")
    placed = histogram.select(
        *by,
        "le",
        "cumulative",
        (F.col("count") * F.lit(q)).alias("rank"),
        F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"),
        F.coalesce(F.lag("cumulative").over(w), F.lit(0)).alias("below"),
    ).where((F.col("cumulative") >= F.col("rank")) & (F.col("cumulative") > 0))
    hit = placed.groupBy(*by).agg(F.min_by(F.struct("le", "low", "below", "cumulative", "rank"), "le").alias("b"))
    b = F.col("b")
    inside = b["low"] + (b["le"] - b["low"]) * F.try_divide(b["rank"] - b["below"], b["cumulative"] - b["below"])
    value = F.when(b["le"] == float("inf"), b["low"]).otherwise(F.coalesce(inside, b["low"]))
    return hit.select(*by, F.lit(q).alias("q"), value.alias("value"))


def events_by_type(events: DataFrame, window_seconds: float, as_of) -> DataFrame:
    """Total per event name, and the rate per second in the trailing window."""
    recent = F.col("received_at") >= periods.before(as_of, window_seconds)
    return events.groupBy("event_name").agg(
        F.count("*").alias("total"), (F.count_if(recent) / F.lit(float(window_seconds))).alias("per_second")
    )


def _named(counted: DataFrame, total: str) -> DataFrame:
    """Drop the group without a component after the aggregation.

    The counts skip ``-``, so that group is 0. A filter on the component itself would
    be pushed below the aggregation and evaluate the whole label rule a second time.
    """
    return counted.where(F.col(total) > 0)


def top_components(events: DataFrame, k: int = 12) -> DataFrame:
    """Most frequent (name, component) pairs; events without a component are left out."""
    counted = (
        _with_component(events)
        .groupBy("event_name", "component")
        .agg(F.count(F.nullif("component", F.lit("-"))).alias("total"), F.min("received_at").alias("_first"))
    )
    ranked = _named(counted, "total").orderBy(F.desc("total"), "_first", "event_name", "component")
    return ranked.limit(k).drop("_first")


def component_rate(events: DataFrame, window_seconds: float, as_of) -> DataFrame:
    """Events per second of each component in the trailing window."""
    recent = periods.events_in_window(events, window_seconds, as_of)
    total = F.count(F.nullif("component", F.lit("-"))).alias("total")
    counted = _named(_with_component(recent).groupBy("component").agg(total), "total")
    return counted.select("component", (F.col("total") / F.lit(float(window_seconds))).alias("per_second"))


def error_rate(attempts: DataFrame, window_seconds: float, as_of, ts: str = "received_at") -> DataFrame:
    """Attempts and errors per second in the trailing window, and their ratio."""
    recent = attempts.where(F.col(ts) >= periods.before(as_of, window_seconds))
    errors = F.count_if(F.col("status") == "error")
    return recent.agg(
        (F.count("*") / F.lit(float(window_seconds))).alias("attempts_per_second"),
        (errors / F.lit(float(window_seconds))).alias("errors_per_second"),
        F.coalesce(F.try_divide(errors, F.count("*")), F.lit(0.0)).alias("error_ratio"),
    )


def throughput(events: DataFrame, window_seconds: float, as_of) -> DataFrame:
    recent = periods.events_in_window(events, window_seconds, as_of)
    return recent.agg((F.count("*") / F.lit(float(window_seconds))).alias("per_second"))


def sorted_labels(labels: Column) -> Column:
    """Labels as a sorted list of pairs, a grouping key independent of their order."""
    return F.array_sort(F.map_entries(labels))


def latest_samples(samples: DataFrame) -> DataFrame:
    """One sample per metric and label set: the one of the highest ``source_rank``.

    Within a source the later line wins.
    """
    latest = (
        samples.withColumn("labels", sorted_labels(F.col("labels")))
        .groupBy("metric", "labels")
        .agg(F.max(F.struct("source_rank", "line_no", "value")).alias("s"))
    )
    pairs = F.transform("labels", lambda e: F.concat_ws("=", e["key"], e["value"]))
    return latest.select(
        "metric",
        "labels",
        F.array_join(pairs, ",").alias("label_text"),
        F.col("s.value").alias("value"),
        F.col("s.source_rank").alias("source_rank"),
    )


#: Size of the sketches, and twice the rank error that they keep with 99 % probability.
SKETCH_K, SKETCH_ERROR = 400, 0.017


def value_sketches(rows: DataFrame, value: str, *by: str, k: int = SKETCH_K) -> DataFrame:
    """A quantile sketch of ``value`` per group, of bounded size; those of finer groups merge to coarser ones."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value), F.lit(k)).alias("sketch"))


def sketch_quantile(sketches: DataFrame, q: float, *by: str) -> DataFrame:
    """The ``q`` quantile of each group from the merged sketches of its parts, with the values ``n`` behind it."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(
        *by, F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value"),
        F.kll_sketch_get_n_double("sketch").alias("n"))


def quantile_check(rows: DataFrame, value: str, quantiles: DataFrame, *by: str, error: float = SKETCH_ERROR) -> DataFrame:
    """Cross-check of quantiles with the rows: ``within`` when the rank of each value is at most ``error`` away.

    Quantiles are one row per group, and there is one column to group by at least.
    """
    joined = rows.join(quantiles.select(*by, "q", F.col("value").alias("_at")), list(by))
    ranks = joined.groupBy(*by, "q", F.col("_at").alias("value")).agg(
        F.count(value).alias("n"), (F.count_if(F.col(value) < F.col("_at")) / F.count(value)).alias("_below"),
        (F.count_if(F.col(value) <= F.col("_at")) / F.count(value)).alias("_upto"))
    return ranks.select(*by, "q", "value", "n", ((F.col("_below") <= F.col("q") + error) & (F.col("_upto") >= F.col("q") - error)).alias("within"))
