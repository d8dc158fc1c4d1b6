"""The event table: create, append, scan."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom import schema
from clickloom.operators import envelope, periods

DDL_ATTEMPTS = 3


def create_event_table(
    spark: SparkSession, table: str, fmt: str = "parquet", location: str | None = None, wait_seconds: float = 5, batches: bool = False
) -> None:
    """Create database and table when absent; the metastore gets three attempts.

    With ``batches`` the table is partitioned by micro-batch below the day, so that a
    stream can repeat a batch without repeating its rows.
    """
    for attempt in range(1, DDL_ATTEMPTS + 1):
        try:
            for statement in schema.table_ddl(table, fmt, location, batches):
                spark.sql(statement)
            return
        except Exception:
            if attempt == DDL_ATTEMPTS:
                raise
            time.sleep(wait_seconds)


def with_partition(events: DataFrame) -> DataFrame:
    return events.withColumn(schema.PARTITION_COLUMN, F.to_date("ingested_at"))


def gathered_by_day(events: DataFrame) -> DataFrame:
    """Rows of a day brought together for writing, in files of the advisory size.

    Adaptive execution splits a day that is too big and merges small ones, so neither
    a hot day nor many small files come out.
    """
    return events.hint("rebalance", schema.PARTITION_COLUMN)


def append_rows(events: DataFrame, table: str, batch_id: int | None = None) -> None:
    """Append by column name, not by position.

    With a ``batch_id``, and in a table partitioned by it, the batch replaces its own partitions.
    """
    names = events.sparkSession.table(table).columns
    if schema.PARTITION_COLUMN in names:
        events = gathered_by_day(with_partition(events))
    if batch_id is None or schema.BATCH_COLUMN not in names:
        events.withColumn(schema.BATCH_COLUMN, F.lit(batch_id).cast("long")).select(*names).write.insertInto(table)
        return
    rows = events.withColumn(schema.BATCH_COLUMN, F.lit(batch_id).cast("long")).select(*names)
    rows.write.option("partitionOverwriteMode", "dynamic").insertInto(table, overwrite=True)


def append_v2(events: DataFrame, table: str) -> None:
    """Append to a catalog table of a v2 format such as Iceberg."""
    events.select(*schema.EVENT_COLUMNS).writeTo(table).append()


def scan_events(
    spark: SparkSession,
    table: str,
    days: int | None = None,
    as_of=None,
    columns: Sequence[str] = schema.REPORT_COLUMNS,
    comparison: bool = False,
) -> DataFrame:
    """Events of the last ``days`` days, twice that for a period comparison.

    No row limit. The date predicate prunes directories, the time predicate reaches
    the files, and only ``columns`` are read.
    """
    rows = spark.table(table)
    seconds = periods.window_days(days) * periods.DAY * (2 if comparison else 1)
    since = periods.before(F.current_timestamp() if as_of is None else as_of, seconds)
    if schema.PARTITION_COLUMN in rows.columns:
        rows = rows.where(F.col(schema.PARTITION_COLUMN) >= F.to_date(since))
    return rows.where(F.col("ingested_at") >= since).select(*columns)


def load_events(
    spark: SparkSession, source: str, days: int | None = None, as_of=None, seconds: int = 300, comparison: bool = False
) -> DataFrame:
    """Canonical, deduplicated events from ``history:<table>`` or ``live:<snapshot path>``.

    A failing source is an error; there is no silent fallback to the other one.
    """
    kind, _, name = source.partition(":")
    if kind == "history":
        return envelope.dedupe_events(envelope.to_canonical(scan_events(spark, name, days, as_of, comparison=comparison)))
    if kind == "live":
        clock = F.current_timestamp() if as_of is None else as_of
        if seconds < 1:
            raise ValueError("the window has at least one second")
        recent = periods.events_in_window(spark.read.parquet(name), seconds, clock)
        return envelope.dedupe_events(envelope.with_keys(recent))
    raise ValueError("source must be history:<table> or live:<path>")
