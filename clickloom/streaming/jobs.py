"""Continuous ingest, live state and stateful operators.

Arrival time drives windows and watermarks, so nothing is late unless a caller picks
the client clock.
"""

from __future__ import annotations

import math

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from clickloom import runtime, schema
from clickloom.functions import scalars as sf
from clickloom.operators import live, sessionize
from clickloom.sources import events as table_io

INGEST_INTERVAL = "30 seconds"
COMMIT_INTERVAL = "60 seconds"
LIVE_INTERVAL = "5 seconds"


def append_batch(path: str, fmt: str = "parquet"):
    """A ``foreachBatch`` writer that is safe to repeat.

    Every batch writes below its own ``batch_id``; a replayed batch replaces exactly
    those directories, so the files hold every row once. Events are also split by
    ingest date. Stamp ``ingested_at`` on the stream, where Spark keeps one clock
    reading per batch, so that a replay finds the same date. No counting pass: row
    counts come from the query progress.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, parts = batch.withColumn("batch_id", F.lit(batch_id)), ["batch_id"]
        if "ingested_at" in batch.columns:
            rows = table_io.gathered_by_day(table_io.with_partition(rows))
            parts = [schema.PARTITION_COLUMN, "batch_id"]
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*parts).format(fmt).save(path)

    return write


def append_table(table: str):
    """A ``foreachBatch`` writer for a catalog table that is safe to repeat.

    A table made with ``batches`` is partitioned by batch as well, and a repeated batch
    replaces its own partitions. A table without that column is appended to, which
    may run twice after a failure; ``dedupe_events`` removes the repeats on reading.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table_io.append_rows(batch, table, batch_id)

    return write


def run_stream(df: DataFrame, writer, checkpoint: str, interval: str = INGEST_INTERVAL) -> StreamingQuery:
    """Keep ingesting in micro-batches."""
    return (
        df.writeStream.foreachBatch(writer)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )


class _Enough(Exception):
    """Raised before the batch after the last one wanted; that batch is not committed."""


def run_available(
    df: DataFrame, writer, checkpoint: str, timeout: float | None = None, max_batches: int | None = None
) -> StreamingQuery:
    """Ingest what is there and stop. Batch size is the source's ``max...PerTrigger``.

    With ``max_batches`` the run ends after that many; the next run goes on from there.
    """
    if max_batches is not None and max_batches < 1:
        raise ValueError("max_batches is at least 1")
    written = 0

    def counted(batch: DataFrame, batch_id: int) -> None:
        nonlocal written
        if written == max_batches:
            raise _Enough(f"{max_batches} batches are written")
        writer(batch, batch_id)
        written += 1

    query = (
        df.writeStream.foreachBatch(counted)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        _finish(query, timeout)
    except StreamingQueryException as error:
        if written != max_batches or _Enough.__name__ not in str(error):
            raise
    return query


def stream_to_table(df: DataFrame, table: str, checkpoint: str, interval: str = COMMIT_INTERVAL) -> StreamingQuery:
    """Continuous exactly-once append, partitioned by ingest date."""
    return (
        table_io.with_partition(df)
        .writeStream.option("checkpointLocation", checkpoint)
        .partitionBy(schema.PARTITION_COLUMN)
        .trigger(processingTime=interval)
        .toTable(table)
    )


def drain_to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append", timeout: float | None = None) -> StreamingQuery:
    """Run a stream over what is there and leave its result as files.

    ``append`` uses the exactly-once file sink. ``complete`` and ``update`` results
    are written per batch, for ``complete`` the last batch is the result.
    """
    stream = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = stream.format("parquet").outputMode("append").option("path", path).start()
    else:
        query = stream.outputMode(mode).foreachBatch(append_batch(path)).start()
    _finish(query, timeout)
    return query


def _finish(query: StreamingQuery, timeout: float | None) -> None:
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(int(timeout)):
        query.stop()
        raise TimeoutError(f"stream did not finish within {timeout} seconds")


def last_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the highest ``batch_id`` directory; no other one is opened."""
    return spark.read.parquet(f"{path}/batch_id={_batch_before(spark, path)}")


# Stateful operators


def stream_dedupe(events: DataFrame, ttl: str = "1 hour", ts: str = "received_at", spread: int = 1) -> DataFrame:
    """First event per id within ``ttl``; events without an id all pass.

    An event without an id gets a key of its own from its log position, so the
    missing ids do not share one state entry. With ``spread`` > 1 an id repeated very
    often is first thinned out on that many tasks, at the price of a second state.
    """
    position = F.concat_ws("/", F.lit("\x00"), "kafka_partition", "kafka_offset")
    keyed = events.withColumn("_id", F.coalesce(sf.present(F.col("event_id")), position)).withWatermark(ts, ttl)
    if spread > 1:
        salt = F.pmod(F.xxhash64("kafka_partition", "kafka_offset"), F.lit(spread))
        keyed = keyed.withColumn("_salt", salt).dropDuplicatesWithinWatermark(["_id", "_salt"]).drop("_salt")
    return keyed.dropDuplicatesWithinWatermark(["_id"]).drop("_id")


def stream_sessions_gap(
    events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", key: str = "actor_key", ts: str = "received_at"
) -> DataFrame:
    """Sessions by idle gap, emitted once the watermark has passed their end."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("events"), F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"))
        .select(key, "started_at", "ended_at", "events")
    )


def stream_sessions_fixed(
    events: DataFrame, timeout_seconds: int = 1800, key: str = "actor_key", ts: str = "received_at", delay: str = "10 minutes"
) -> DataFrame:
    """Sessions by fixed age, as updates: the current numbers of each session.

    For steady streams. State per key is the open session, which goes when the watermark
    (``delay`` behind the newest event) passes its end; events behind the watermark are
    late and are dropped. An arrival time before the open session joins that session.
    Events without a key have no session. One key's times of one micro-batch (eight bytes
    each) meet in a task, so set the source's ``max...PerTrigger``; for a backlog in one
    batch use ``keep_sessions``.
    """
    timeout = timeout_seconds * 1_000_000
    columns = [key, "started_us", "ended_us", "events"]

    def advance(keys, batches, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([b["us"].to_numpy() for b in batches]))
        start, end, n = state.get if state.exists else (int(times[0]), int(times[0]), 0)
        rows, at = [], 0
        while True:
            stop = int(np.searchsorted(times, start + timeout, side="left"))
            if stop > at:
                end, n = max(end, int(times[stop - 1])), n + stop - at
            rows.append((keys[0], start, end, n))
            at = max(at, stop)
            if at >= len(times):
                break
            start, end, n = int(times[at]), int(times[at]), 0
        state.update((start, end, n))
        # a row may be older than the watermark that its own batch has moved
        state.setTimeoutTimestamp(max((start + timeout) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=columns)

    timed = events.where(F.col(key).isNotNull()).withWatermark(ts, delay).select(key, ts, F.unix_micros(ts).alias("us"))
    state_schema = "started_us long, ended_us long, events long"
    return timed.groupBy(key).applyInPandasWithState(
        advance, f"{key} string, {state_schema}", state_schema, "update", "EventTimeTimeout"
    )


def keep_sessions(
    path: str, timeout_seconds: int = 1800, key: str = "actor_key", ts: str = "received_at", delay_seconds: int = 600
):
    """A ``foreachBatch`` writer for sessions by fixed age, for batches of any size.

    The open session of every key is a table, one version per batch; the last two stay.
    A batch puts the start of a key's open session before the key's events and runs the
    batch operator, which spreads a busy key over tasks. Updates go to ``sessions``, the
    open sessions to ``open``; a repeated batch writes the same files. A session whose
    end lies ``delay_seconds`` behind the newest event is open no longer; a later arrival
    from before then starts a session of its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        taken = f"{path}/input/batch_id={batch_id}"
        # the batch is read once, what follows reads this copy
        batch.where(F.col(key).isNotNull()).select(key, F.col(ts).alias("at")).write.mode("overwrite").parquet(taken)
        known = spark.read.parquet(taken)
        earlier = _batch_before(spark, f"{path}/open", batch_id)
        if earlier is None:
            rows = known.withColumns({"ended_at": F.lit(None).cast("timestamp"), "events": F.lit(None).cast("long")})
        else:
            before = spark.read.parquet(f"{path}/open/batch_id={earlier}")
            # a time before the open session counts as its start
            joined = known.join(before.select(key, "started_at"), key, "left")
            clamped = joined.select(key, F.greatest("at", "started_at").alias("at"))
            touched = before.join(known.select(key).distinct(), key, "left_semi")
            seeds = touched.select(key, F.col("started_at").alias("at"), "ended_at", "events")
            rows = clamped.unionByName(seeds, allowMissingColumns=True)
        numbered = sessionize.sessionize(rows, key, timeout_seconds, "fixed", "at")
        spans = numbered.groupBy(key, "session_no").agg(
            F.min("at").alias("started_at"),
            F.max(F.coalesce("ended_at", "at")).alias("ended_at"),
            F.sum(F.coalesce("events", F.lit(1))).alias("events"),
        )
        spans.drop("session_no").write.mode("overwrite").parquet(f"{path}/sessions/batch_id={batch_id}")

        updates = spark.read.parquet(f"{path}/sessions/batch_id={batch_id}").drop("batch_id")
        last = F.max(F.struct("started_at", "ended_at", "events")).alias("s")
        still_open = updates.groupBy(key).agg(last).select(key, "s.*")
        if earlier is not None:
            still_open = still_open.unionByName(before.join(updates.select(key).distinct(), key, "left_anti"))
        newest = still_open.agg(F.max(F.unix_micros("ended_at"))).scalar()
        closes = F.unix_micros("started_at") + (timeout_seconds + delay_seconds) * 1_000_000
        still_open.where(closes > newest).write.mode("overwrite").parquet(f"{path}/open/batch_id={batch_id}")
        runtime.delete(spark, taken)
        _drop_before(spark, f"{path}/open", batch_id if earlier is None else earlier)

    return write


def kept_sessions(spark: SparkSession, path: str, key: str = "actor_key") -> DataFrame:
    """Final numbers of each session that ``keep_sessions`` wrote."""
    return _numbered(spark.read.parquet(f"{path}/sessions"), key)


def latest_sessions(updates: DataFrame, key: str = "actor_key") -> DataFrame:
    """Final numbers of each session from its updates: they only grow."""
    times = {name: F.timestamp_micros(micros) for name, micros in (("started_at", "started_us"), ("ended_at", "ended_us"))}
    return _numbered(updates.withColumns(times), key)


def _numbered(updates: DataFrame, key: str) -> DataFrame:
    """One row per session, numbered by start. The sessions of a key are bounded by its
    time range."""
    sessions = updates.groupBy(key, "started_at").agg(F.max("ended_at").alias("ended_at"), F.max("events").alias("events"))
    number = F.row_number().over(W.Window.partitionBy(key).orderBy("started_at")).cast("long")
    return sessions.select(key, number.alias("session_no"), "started_at", "ended_at", "events")


def client_clock_rates(
    events: DataFrame, window: str, slide: str | None = None, *by: str, event_time: str = "event_time", delay: str = "10 minutes",
    closed: bool = False,
) -> DataFrame:
    """Window rates by the client clock. Events more than ``delay`` behind the newest of
    the batches before are late and do not count; ``count_late`` marks them."""
    return live.window_rates(events.withWatermark(event_time, delay), window, slide, *by, ts=event_time, closed=closed)


def count_late(events: DataFrame, delay: str, event_time: str, ts: str = "received_at") -> DataFrame:
    """Client-clock mode: mark events whose own time lies ``delay`` behind arrival."""
    return events.withColumn("is_late", F.col(event_time) < F.col(ts) - F.expr(f"INTERVAL {delay}"))


def split_late(path: str, delay_seconds: int, event_time: str = "event_time"):
    """A ``foreachBatch`` writer that keeps late events apart instead of losing them.

    The watermark of a batch is ``delay_seconds`` behind the newest event of the batches before,
    in whole milliseconds, and an event at or before it is late. Spark's stateful operators
    drop by the same rule, but one batch later. Events without a time are not late. Every batch writes its own
    folders, so a repeated batch gives the same files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = _batch_before(spark, f"{path}/newest", batch_id)
        newest = spark.read.parquet(f"{path}/newest/batch_id={earlier}").first()["us"] if earlier is not None else None
        us = F.unix_micros(F.col(event_time).cast("timestamp"))
        late = F.lit(False)
        if newest is not None:
            late = F.coalesce(us <= newest // 1000 * 1000 - delay_seconds * 1_000_000, F.lit(False))
        seen = Observation()
        rows = batch.observe(seen, F.max(us).alias("us")).withColumn("is_late", late)
        rows.write.mode("overwrite").partitionBy("is_late").parquet(f"{path}/rows/batch_id={batch_id}")
        times = [t for t in (newest, seen.get["us"]) if t is not None]
        now = F.lit(max(times) if times else None).cast("long")
        spark.range(1).select(now.alias("us")).write.mode("overwrite").parquet(f"{path}/newest/batch_id={batch_id}")
        _drop_before(spark, f"{path}/newest", batch_id if earlier is None else earlier)

    return write


def split_rows(spark: SparkSession, path: str) -> DataFrame:
    """What ``split_late`` wrote, with ``batch_id`` and ``is_late``."""
    return spark.read.parquet(f"{path}/rows").withColumn("is_late", F.col("is_late").cast("boolean"))


# Live buffer


def keep_latest(path: str, n: int = live.BUFFER_SIZE):
    """A ``foreachBatch`` writer that keeps the newest ``n`` events and a running total.

    Batch ``b`` reads what the newest batch before it left and writes its own folders,
    so a repeated batch gives the same files; the last two versions stay. The rows are
    counted while they are ranked, without a second pass.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = _batch_before(spark, f"{path}/total", batch_id)
        counted = Observation()
        newest = live.latest_n(batch.observe(counted, F.count(F.lit(1)).alias("n")), n)
        received = 0
        if earlier is not None:
            newest = newest.unionByName(spark.read.parquet(f"{path}/buffer/batch_id={earlier}"))
            received = spark.read.parquet(f"{path}/total/batch_id={earlier}").first()["total_received"]
        live.latest_n(newest, n).write.mode("overwrite").parquet(f"{path}/buffer/batch_id={batch_id}")
        total = spark.range(1).select(F.lit(received + counted.get["n"]).cast("long").alias("total_received"))
        total.write.mode("overwrite").parquet(f"{path}/total/batch_id={batch_id}")
        for folder in (f"{path}/buffer", f"{path}/total"):
            _drop_before(spark, folder, batch_id if earlier is None else earlier)

    return write


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers that have a folder."""
    names = runtime.children(spark, path)
    return [int(name.partition("=")[2]) for name in names if name.startswith("batch_id=")]


def _batch_before(spark: SparkSession, path: str, batch_id: float = math.inf) -> int | None:
    """Highest batch number below ``batch_id`` that has a folder."""
    return max((b for b in _batches(spark, path) if b < batch_id), default=None)


def _drop_before(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete the versions no later batch and no repeat of the last one reads."""
    for b in _batches(spark, path):
        if b < batch_id:
            runtime.delete(spark, f"{path}/batch_id={b}")


def live_buffer(spark: SparkSession, path: str) -> DataFrame:
    """The buffer that ``keep_latest`` left, with the running total."""
    total = last_batch(spark, f"{path}/total").select("total_received")
    return last_batch(spark, f"{path}/buffer").withColumn("total_received", total.scalar())


# Status


class StatusListener(StreamingQueryListener):
    """Running totals per query: rows, batches and the last error.

    Spark keeps only the latest progress reports of a query; a listener sees them all.
    """

    def __init__(self) -> None:
        self.totals: dict[str, dict] = {}

    def _entry(self, query_id) -> dict:
        return self.totals.setdefault(str(query_id), {"rows": 0, "batches": 0, "error": None, "active": True})

    def onQueryStarted(self, event) -> None:
        self._entry(event.id)["active"] = True

    def onQueryProgress(self, event) -> None:
        entry = self._entry(event.progress.id)
        entry["rows"] += event.progress.numInputRows
        entry["batches"] += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        entry = self._entry(event.id)
        entry["active"], entry["error"] = False, event.exception


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per recent micro-batch of a query, from its own progress reports."""
    rows = [
        (
            str(p["id"]), int(p["batchId"]), p["timestamp"], int(p["numInputRows"]),
            int(p["durationMs"].get("triggerExecution", 0)),
        )
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, "query_id string, batch_id long, at string, input_rows long, duration_ms long")


def pipeline_status(
    spark: SparkSession,
    query: StreamingQuery,
    buffer: DataFrame | None = None,
    buffer_size: int = live.BUFFER_SIZE,
    listener: StatusListener | None = None,
) -> DataFrame:
    """Health of a stream: active, last error, rows received, batches, buffer used.

    The totals cover the recent progress reports, or the whole run with a listener.
    """
    error = query.exception()
    seen = listener.totals.get(str(query.id)) if listener else None
    if seen is None:
        reports = query.recentProgress
        seen = {"rows": sum(int(p["numInputRows"]) for p in reports), "batches": len(reports)}
    state = "error" if error else "running" if query.isActive else "stopped"
    used = F.lit(0).cast("long") if buffer is None else buffer.agg(F.count("*")).scalar()
    return spark.range(1).select(
        F.lit(query.isActive).alias("stream_active"),
        F.lit(state).alias("status"),
        F.lit(str(error) if error else None).cast("string").alias("last_error"),
        F.lit(seen["rows"]).cast("long").alias("total_received"),
        F.lit(seen["batches"]).cast("long").alias("batches"),
        F.lit(buffer_size).alias("buffer_size"),
        used.alias("buffer_used"),
    )
