"""State of the event table: counts, freshness, positions, lag, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import periods


def verify_table(events: DataFrame, n: int = 10, time_col: str = "ingested_at") -> DataFrame:
    """The newest ``n`` rows, each with the table's row count."""
    newest = events.orderBy(
        F.desc(time_col), F.desc("kafka_partition"), F.desc("kafka_offset"), F.desc("event_id")
    ).limit(n)
    return newest.withColumn("row_count", events.agg(F.count("*")).scalar())


def next_offsets(events: DataFrame) -> DataFrame:
    """Position per partition: one past the last offset."""
    return events.groupBy("kafka_partition").agg((F.max("kafka_offset") + 1).alias("next_offset"))


def ingest_status(events: DataFrame, time_col: str = "ingested_at") -> DataFrame:
    """Per partition: rows, newest arrival, next offset; and one row for the table, also an empty one."""
    per = events.groupBy("kafka_partition").agg(
        F.count("*").alias("row_count"),
        F.max(time_col).alias("last_ingested_at"),
        (F.max("kafka_offset") + 1).alias("next_offset"),
    ).select(F.lit("partition").alias("scope"), "*")
    table = per.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.max("last_ingested_at").alias("last_ingested_at"))
    return per.unionByName(table.withColumn("scope", F.lit("table")), allowMissingColumns=True)


def ingest_lag(end_offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """Messages not yet read per partition: log end minus next offset.

    Both sides hold one row per log partition.
    """
    joined = end_offsets.join(committed, "kafka_partition", "left")
    position = F.coalesce("next_offset", F.lit(0))
    return joined.select(
        "kafka_partition", "end_offset", position.alias("next_offset"),
        F.greatest(F.lit(0), F.col("end_offset") - position).alias("lag"),
    )


def reconcile_ingest(events: DataFrame, boundary, published: int | None = None, time_col: str = "ingested_at") -> DataFrame:
    """Rows before and since the boundary; ``ok`` when rows came, or as many as published."""
    fresh = F.col(time_col) >= periods.instant(boundary)
    counts = events.agg(
        F.count_if(~fresh).alias("rows_before"), F.count("*").alias("rows_after"), F.count_if(fresh).alias("delta")
    )
    ok = F.col("delta") > 0 if published is None else F.col("delta") >= published
    return counts.withColumn("ok", ok)


def offset_gaps(events: DataFrame) -> DataFrame:
    """Missing and repeated offsets per partition.

    Offsets shrink to distinct ones first, on an evenly spread key.
    """
    distinct = events.groupBy("kafka_partition", "kafka_offset").agg(F.count("*").alias("n"))
    spans = distinct.groupBy("kafka_partition").agg(
        F.min("kafka_offset").alias("first_offset"),
        F.max("kafka_offset").alias("last_offset"),
        F.count("*").alias("offsets"),
        (F.sum("n") - F.count("*")).alias("repeated"),
    )
    return spans.withColumn("missing", F.col("last_offset") - F.col("first_offset") + 1 - F.col("offsets"))


def footer_stats(spark: SparkSession, path: str, columns: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Rows of Parquet files, and least and greatest value of ``columns``, from the file footers alone.

    ``by`` are partition columns. Footers answer for whole numbers, dates and booleans; Spark
    reads the column of any other type. The reader has a session of its own, in which
    the aggregates are pushed to the files.
    """
    own = spark.newSession()
    v1 = [f for f in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if f != "parquet"]
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return own.read.parquet(path).groupBy(*by).agg(F.count("*").alias("row_count"), *ends)
