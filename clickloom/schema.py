"""Schemas of the wire envelope and of the event table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of the JSON envelope that become table columns, read as text so that one
#: badly typed field never discards the rest of the message.
ENVELOPE_TEXT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "event_id",
            "project_id",
            "name",
            "event_name",
            "properties",
            "timestamp",
            "source",
            "user_id",
            "anonymous_id",
            "session_id",
            "page_path",
            "context",
        )
    ]
)

#: The event table.
EVENT_TABLE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("properties_json", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("anonymous_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("page_path", T.StringType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("kafka_timestamp", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("raw_payload", T.StringType()),
    ]
)
EVENT_COLUMNS = tuple(EVENT_TABLE.names)

#: Columns the reports read; the payload and Kafka time stay on disk.
REPORT_COLUMNS = tuple(c for c in EVENT_COLUMNS if c not in ("kafka_timestamp", "raw_payload"))

#: Messages as they come from the log.
RAW_MESSAGE = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("event_timestamp", T.TimestampType()),
    ]
)

#: Date partition added to the table so that time filters prune directories.
PARTITION_COLUMN = "ingest_date"
#: Micro-batch of a row, in tables that streams write.
BATCH_COLUMN = "batch_id"

#: Total order of events: arrival time first, then log position, then id.
ORDER_COLUMNS = ("received_at", "kafka_partition", "kafka_offset", "event_id")


def event_order() -> Column:
    """The total order as one comparable value."""
    return F.struct(*[F.col(c) for c in ORDER_COLUMNS])


def table_ddl(table: str, fmt: str = "parquet", location: str | None = None, batches: bool = False) -> list[str]:
    """Statements that create the database and the event table when absent.

    The table is partitioned by ingest date: every report filters on arrival time,
    so a seven-day report over years of history lists seven directories. With
    ``batches`` each micro-batch has a partition of its own below the day.
    """
    database = table.rpartition(".")[0]
    columns = ",\n  ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_TABLE)
    if fmt == "iceberg":
        batch, parts = (f",\n  {BATCH_COLUMN} bigint", f", {BATCH_COLUMN}") if batches else ("", "")
        layout = f"{columns}{batch}\n) USING iceberg PARTITIONED BY (days(ingested_at){parts})"
    else:
        batch, parts = (f",\n  {BATCH_COLUMN} bigint", f", {BATCH_COLUMN}") if batches else ("", "")
        layout = f"{columns},\n  {PARTITION_COLUMN} date{batch}\n) USING {fmt} PARTITIONED BY ({PARTITION_COLUMN}{parts})"
    if location:
        layout += f" LOCATION '{location}'"
    statements = [f"CREATE DATABASE IF NOT EXISTS {database}"] if database else []
    return statements + [f"CREATE TABLE IF NOT EXISTS {table} (\n  {layout}"]
