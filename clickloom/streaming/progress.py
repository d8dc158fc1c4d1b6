"""Recorded progress of streams: status over restarts, lag and late rows.

Spark keeps the latest progress reports of a query in the driver only. A
``ProgressRecorder`` writes each report to a shared folder, one file per query and
batch, so they outlive the driver. What follows reads these files as a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StreamingQueryListener

from clickloom import runtime

#: The fields of a report that are read. Offsets stay JSON text, whatever the source has in them.
REPORT = (
    "id string, runId string, name string, timestamp string, batchId long, numInputRows long, "
    "durationMs map<string,long>, "
    "stateOperators array<struct<operatorName:string, numRowsTotal:long, numRowsUpdated:long, numRowsRemoved:long, "
    "numRowsDroppedByWatermark:long>>, "
    "sources array<struct<description:string, startOffset:string, endOffset:string, latestOffset:string, numInputRows:long>>"
)
#: How a run began or ended; kept beside its reports.
EVENT = "id string, runId string, at string, kind string, error string"
KINDS = ("started", "terminated")


class ProgressRecorder(StreamingQueryListener):
    """Writes every progress report, start and end of all queries of a session below ``path``.

    A batch that is repeated after a failure replaces its report, so totals count it
    once. Only small files are written, straight to the file system; no job is run.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        self._event(event, "started", event.timestamp, None)

    def onQueryProgress(self, event) -> None:
        report = event.progress
        # a trigger that ran no batch reports the next batch's number
        if report.numInputRows == 0 and "addBatch" not in report.durationMs:
            return
        self._write(f"reports/{report.id}/{report.batchId}.json", report.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._event(event, "terminated", None, event.exception)

    def _event(self, event, kind: str, at, error) -> None:
        row = {"id": str(event.id), "runId": str(event.runId), "at": at, "kind": kind, "error": error}
        self._write(f"events/{event.id}/{event.runId}-{kind}.json", json.dumps(row))

    def _write(self, name: str, text: str) -> None:
        runtime.write_text(self.spark, f"{self.path}/{name}", " ".join(text.split("\n")))


@contextmanager
def recording(spark: SparkSession, path: str) -> Iterator[ProgressRecorder]:
    """Record what runs inside; on leaving, all reports that were sent are written."""
    recorder = ProgressRecorder(spark, path)
    spark.streams.addListener(recorder)
    try:
        yield recorder
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(recorder)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """All recorded reports, one row per query and batch; none where nothing was recorded."""
    return _read(spark, f"{path}/reports", REPORT)


def recorded_events(spark: SparkSession, path: str) -> DataFrame:
    """Starts and ends of all runs."""
    return _read(spark, f"{path}/events", EVENT)


def _read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    if not runtime.children(spark, path):
        return spark.createDataFrame([], columns)
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.from_json("value", columns).alias("r")).select("r.*")


def batch_status(reports: DataFrame) -> DataFrame:
    """One row per query and batch: rows, duration, rows held in state and dropped as late."""
    held = F.coalesce("stateOperators", F.array().cast(reports.schema["stateOperators"].dataType))

    def total(field: str):
        return F.aggregate(held, F.lit(0).cast("long"), lambda s, o: s + F.coalesce(o[field], F.lit(0)))

    return reports.select(
        F.col("id").alias("query_id"), F.col("runId").alias("run_id"), F.col("batchId").alias("batch_id"),
        F.to_timestamp("timestamp").alias("at"), F.col("numInputRows").alias("input_rows"),
        F.coalesce(F.col("durationMs")["triggerExecution"], F.lit(0)).alias("duration_ms"),
        total("numRowsTotal").alias("state_rows"), total("numRowsDroppedByWatermark").alias("late_rows"),
    )


def status_totals(reports: DataFrame, events: DataFrame) -> DataFrame:
    """One row per query over all its runs: batches, rows, late rows, runs, last batch, last error and status.

    ``running`` while a run has begun and not ended, ``error`` when the last run that
    ended did so with one, else ``stopped``.
    """
    batches = batch_status(reports).groupBy("query_id").agg(
        F.count("*").alias("batches"), F.sum("input_rows").alias("total_received"), F.sum("late_rows").alias("late_rows"),
        F.max("batch_id").alias("last_batch"), F.max("at").alias("last_batch_at"),
        F.max_by("state_rows", "batch_id").alias("state_rows"),
    )
    began = F.max(F.when(F.col("kind") == "started", F.to_timestamp("at")))
    runs = events.groupBy(F.col("id").alias("query_id"), "runId").agg(
        began.alias("began"), F.max(F.when(F.col("kind") == "terminated", F.lit(1)).otherwise(F.lit(0))).alias("ended"),
        F.max("error").alias("error"),
    )
    latest = F.struct("began", "runId")
    per_query = runs.groupBy("query_id").agg(
        F.count("*").alias("runs"), F.max_by("ended", latest).alias("_ended"), F.max_by("error", latest).alias("last_error"),
    )
    joined = per_query.join(batches, "query_id", "left")
    status = F.when(F.col("_ended") == 0, "running").when(F.col("last_error").isNotNull(), "error").otherwise("stopped")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("batches", "total_received", "late_rows", "state_rows")]
    return joined.select("query_id", "runs", *counts, "last_batch", "last_batch_at", "last_error", status.alias("status"))


# Lag


def source_positions(reports: DataFrame) -> DataFrame:
    """Where each query stands after its newest batch, one row per source and log partition.

    ``next_offset`` is what the batch committed, ``end_offset`` where the source ended when
    the batch was planned. A log source has offsets by topic and partition. A source that
    counts rows, such as a rate source, has one number. A source that only numbers its
    files has neither: its position is the rows read in all batches and its end is NULL.
    """
    per_source = reports.select("id", "batchId", F.posexplode("sources").alias("source", "s"))
    newest = F.max_by("s", "batchId")
    last = per_source.groupBy("id", "source").agg(newest.alias("s"), F.sum("s.numInputRows").alias("rows_read"))
    by_topic = "map<string,map<string,bigint>>"
    log, ends = F.from_json("s.endOffset", by_topic), F.from_json("s.latestOffset", by_topic)
    number = F.col("s.endOffset").try_cast("bigint")
    typed = last.select(
        F.col("id").alias("query_id"), "source", F.col("s.description").alias("description"), "rows_read",
        F.when(~F.rlike("s.endOffset", F.lit("\"logOffset\"")), log).alias("log"), ends.alias("ends"), number.alias("number"),
        F.col("s.latestOffset").try_cast("bigint").alias("number_end"),
    )
    topics = typed.where("log IS NOT NULL").select("*", F.explode("log").alias("topic", "offsets"))
    partitions = topics.select("*", F.explode("offsets").alias("part", "next_offset"))
    logs = partitions.select(
        "query_id", "source", "topic", F.col("part").cast("int").alias("kafka_partition"), "next_offset",
        F.col("ends")[F.col("topic")][F.col("part")].alias("end_offset"),
    )
    single = typed.where("log IS NULL").select(
        "query_id", "source", F.col("description").alias("topic"), F.lit(0).alias("kafka_partition"),
        F.coalesce("number", "rows_read").alias("next_offset"), "number_end",
    )
    return logs.unionByName(single.withColumnRenamed("number_end", "end_offset"))


def stream_lag(reports: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Messages not read yet per query, topic and partition.

    The end is the source's own from its newest report; ``ends`` (``kafka_partition``,
    ``end_offset``) replaces it where the source reports none or the log has grown since.
    A partition the stream has not met begins at 0.
    """
    at = source_positions(reports)
    if ends is not None:
        # every query reads every partition of the log, so its end is asked for as an array per query
        known = ends.agg(F.collect_list(F.struct(F.col("kafka_partition").alias("p"), F.col("end_offset").alias("e")))).scalar()
        stream = ["query_id", "source", "topic"]
        wanted = at.select(*stream).distinct().select(*stream, F.explode(known).alias("k"))
        wanted = wanted.select(*stream, F.col("k.p").alias("kafka_partition"), F.col("k.e").alias("_end"))
        place = [*stream, "kafka_partition"]
        at = at.join(wanted, place, "full").select(
            *place, F.coalesce("next_offset", F.lit(0)).alias("next_offset"), F.greatest("_end", "end_offset").alias("end_offset"),
        )
    return at.withColumn("lag", F.greatest(F.lit(0), F.col("end_offset") - F.col("next_offset")))


# Late rows


def late_rows(reports: DataFrame) -> DataFrame:
    """Rows that the stateful operators of each query dropped behind the watermark, over all batches.

    Spark counts them where they reach the operator: after a partial aggregate these are
    groups, so only ``split_late`` gives the events themselves.
    """
    operators = reports.select("id", "batchId", F.posexplode("stateOperators").alias("operator", "o"))
    return operators.groupBy(F.col("id").alias("query_id"), "operator", F.col("o.operatorName").alias("name")).agg(
        F.sum("o.numRowsDroppedByWatermark").alias("late_rows"), F.sum("o.numRowsRemoved").alias("removed"),
        F.max_by("o.numRowsTotal", "batchId").alias("state_rows"),
    )


def batch_rates(reports: DataFrame, smooth: int = 5) -> DataFrame:
    """Rows per second of every batch, and over the last ``smooth`` batches of its query."""
    status = batch_status(reports)
    recent = W.Window.partitionBy("query_id").orderBy("batch_id").rowsBetween(1 - smooth, 0)
    seconds = F.col("duration_ms") / 1000
    return status.select(
        "query_id", "batch_id", "input_rows", "duration_ms",
        F.try_divide(F.col("input_rows"), seconds).alias("per_second"),
        F.try_divide(F.sum("input_rows").over(recent), F.sum(seconds).over(recent)).alias("smoothed_per_second"),
    )
