import random

import pytest
from pyspark.sql import functions as F

from clickloom import runtime
from clickloom.operators import envelope, live, metrics, sessionize
from clickloom.streaming import compaction, jobs, progress, state

T0 = 1704067200


@pytest.fixture
def source(spark, tmp_path):
    """Files of events, one per micro-batch, in order."""
    folder = tmp_path / "in"
    folder.mkdir()

    class Source:
        count = 0

        def add(self, *rows):
            """Rows are (event_id, user, seconds)."""
            import os

            df = spark.createDataFrame([(i, u, float(t), n) for n, (i, u, t) in enumerate(rows)], "event_id string, user_id string, s double, n long")
            timed = df.select(
                "event_id", "user_id", F.timestamp_micros(((F.col("s") + T0) * 1e6).cast("long")).alias("received_at"),
                F.lit(Source.count).alias("kafka_partition"), F.col("n").alias("kafka_offset"),
            )
            part = str(tmp_path / f"part{Source.count}")
            timed.coalesce(1).write.parquet(part)
            made = next(f for f in os.listdir(part) if f.endswith(".parquet"))
            target = folder / f"{Source.count:04}.parquet"
            target.write_bytes(open(f"{part}/{made}", "rb").read())
            os.utime(target, (T0 + Source.count, T0 + Source.count))
            Source.count += 1

        def stream(self):
            schema = "event_id string, user_id string, received_at timestamp, kafka_partition int, kafka_offset long"
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

        def batch(self):
            return spark.read.parquet(str(folder))

    Source.count = 0
    return Source()


def drain(spark, df, mode="append"):
    folder = runtime.run_dir(spark, "test")
    jobs.drain_to_files(df, f"{folder}/out", f"{folder}/checkpoint", mode, timeout=120)
    return folder + "/out"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("spread", [1, 4])
def test_dedupe_across_batches(spark, source, spread):
    source.add(("a", "u", 0), ("b", "u", 1), (None, "u", 2), (None, "u", 2))
    source.add(("a", "u", 300), ("c", "u", 301), ("", "u", 302), ("", "u", 302))
    out = spark.read.parquet(drain(spark, jobs.stream_dedupe(source.stream(), spread=spread)))
    assert rows(out.fillna("-", "event_id"), "event_id") == [("",), ("",), ("-",), ("-",), ("a",), ("b",), ("c",)]


def test_gap_sessions_close_behind_the_watermark(spark, source):
    source.add(("1", "u", 0), ("2", "u", 600), ("3", "u", 2400))
    source.add(("4", "u", 2500), ("5", "v", 4000))
    source.add(("flush", "w", 90000))
    out = spark.read.parquet(drain(spark, jobs.stream_sessions_gap(source.stream(), key="user_id")))
    closed = source.batch().where("event_id <> 'flush'")
    want = sessionize.session_spans(sessionize.sessionize(closed, "user_id"), "user_id")
    columns = ("user_id", "started_at", "ended_at", "events")
    assert rows(out, *columns) == rows(want, *columns)


SPAN = ("user_id", "session_no", "started_at", "ended_at", "events")


def fixed_by_state(spark, source):
    sessions = jobs.stream_sessions_fixed(source.stream(), key="user_id", delay="2 hours")
    updates = spark.read.parquet(drain(spark, sessions, "update"))
    return jobs.latest_sessions(updates, "user_id")


def fixed_by_batch(spark, source):
    folder = runtime.run_dir(spark, "kept")
    jobs.run_available(source.stream(), jobs.keep_sessions(folder, key="user_id"), f"{folder}/checkpoint", timeout=120)
    return jobs.kept_sessions(spark, folder, "user_id")


@pytest.mark.parametrize("run", [fixed_by_state, fixed_by_batch])
def test_fixed_sessions_equal_the_batch_operator(spark, source, run):
    dice = random.Random(3)
    t = 0
    for users in ("uvw", "u", "vw", "uvw"):
        chunk = []
        for _ in range(25):
            t += dice.choice([0, 50, 700, 1799, 1800, 1801])
            chunk.append((str(t), dice.choice(users), t))
        source.add(*chunk)
    want = sessionize.session_spans(sessionize.sessionize(source.batch(), "user_id", mode="fixed"), "user_id")
    assert rows(run(spark, source), *SPAN) == rows(want, *SPAN)


@pytest.mark.parametrize("run", [fixed_by_state, fixed_by_batch])
def test_a_time_before_the_open_session_joins_it(spark, source, run):
    source.add(("1", "u", 5000), ("2", "u", 5100))
    source.add(("late", "u", 100), ("3", "u", 5200))
    got = run(spark, source).select("session_no", F.unix_seconds("started_at") - T0, F.unix_seconds("ended_at") - T0, "events")
    assert [tuple(r) for r in got.collect()] == [(1, 5000, 5200, 4)]


def test_rows_just_behind_the_watermark_do_not_stop_the_stream(spark, source):
    source.add(("1", "u", 0), ("2", "v", 5000))
    source.add(("3", "u", 1900), ("4", "w", 100))
    source.add(("5", "u", 5000))
    updates = spark.read.parquet(drain(spark, jobs.stream_sessions_fixed(source.stream(), key="user_id"), "update"))
    got = jobs.latest_sessions(updates, "user_id").select("user_id", F.unix_seconds("started_at") - T0, "events")
    assert sorted(map(tuple, got.collect())) == [("u", 0, 1), ("u", 1900, 1), ("u", 5000, 1), ("v", 5000, 1), ("w", 100, 1)]


def test_state_of_fixed_sessions_goes_with_the_watermark(spark, source):
    source.add(*[(str(i), f"u{i}", i) for i in range(5)])
    source.add(("x", "v", 5000))
    source.add(("flush", "w", 90000))
    folder = runtime.run_dir(spark, "test")
    query = jobs.drain_to_files(
        jobs.stream_sessions_fixed(source.stream(), key="user_id"), f"{folder}/out", f"{folder}/checkpoint", "update", timeout=120
    )
    left = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]
    assert left[0] == 5 and left[-1] == 1, left  # the flush alone


def test_kept_sessions_keep_two_versions_and_close(spark, source):
    for t in (0, 100, 5000, 9000):
        source.add((str(t), f"u{t}", t))
    folder = runtime.run_dir(spark, "kept")
    jobs.run_available(source.stream(), jobs.keep_sessions(folder, key="user_id"), f"{folder}/checkpoint", timeout=120)
    assert sorted(runtime.children(spark, f"{folder}/open")) == ["batch_id=2", "batch_id=3"]
    assert runtime.children(spark, f"{folder}/input") == []
    assert rows(jobs.last_batch(spark, f"{folder}/open"), "user_id") == [("u9000",)]
    assert jobs.kept_sessions(spark, folder, "user_id").count() == 4


def test_a_run_of_some_batches_goes_on_later(spark, source, tmp_path):
    for t in range(5):
        source.add((str(t), "u", t))

    def run(n):
        stamped = source.stream().withColumn("ingested_at", F.col("received_at"))
        writer = jobs.append_batch(str(tmp_path / "out"))
        jobs.run_available(stamped, writer, str(tmp_path / "check"), 120, max_batches=n)
        return rows(spark.read.parquet(str(tmp_path / "out")), "event_id")

    assert run(2) == [("0",), ("1",)]
    assert run(2) == [("0",), ("1",), ("2",), ("3",)]
    assert run(None) == [(str(t),) for t in range(5)]
    with pytest.raises(ValueError):
        run(0)


def test_late_by_the_client_clock(spark, source):
    source.add(("1", "u", 0), ("2", "u", 30), ("3", "u", 1000))
    source.add(("4", "u", 1010))
    source.add(("late", "u", 40))
    source.add(("flush", "u", 90000))
    rates = jobs.client_clock_rates(source.stream(), "1 minute", event_time="received_at", delay="5 minutes")
    got = spark.read.parquet(drain(spark, rates)).select(F.unix_seconds("window_start") - T0, "events")
    assert sorted(map(tuple, got.collect())) == [(0, 2), (960, 2)]


def test_running_counters(spark, source):
    source.add(("1", "u", 0), ("2", "u", 1))
    source.add(("3", "v", 2))
    named = lambda df: df.withColumns({"event_name": F.col("user_id"), "properties_json": F.lit('{"tab":"x"}')})
    path = drain(spark, metrics.event_counters(named(source.stream())), "complete")
    assert rows(jobs.last_batch(spark, path), "event_name", "component", "total") == [("u", "tab:x", 2), ("v", "tab:x", 1)]


def test_windows_equal_the_batch_operator(spark, source):
    source.add(*[(str(i), "u", 7 * i) for i in range(40)])
    source.add(*[(str(i), "u", 7 * i) for i in range(40, 90)])
    stream = source.stream().withWatermark("received_at", "1 minute")
    path = drain(spark, live.window_rates(stream, "1 minute", "15 seconds"), "complete")
    want = live.window_rates(source.batch(), "1 minute", "15 seconds")
    assert rows(jobs.last_batch(spark, path), *want.columns) == rows(want, *want.columns)


def test_live_buffer_keeps_the_newest_and_counts_all(spark, source):
    source.add(*[(f"a{i}", "u", i) for i in range(8)])
    source.add(("late", "u", 2.5), ("x", "u", 100))
    source.add(*[(f"c{i}", "u", 50 + i) for i in range(3)])
    folder = runtime.run_dir(spark, "live")
    query = jobs.run_available(source.stream(), jobs.keep_latest(folder, 5), f"{folder}/checkpoint", timeout=120)
    buffer = jobs.live_buffer(spark, folder)
    assert rows(buffer, "event_id") == [("a7",), ("c0",), ("c1",), ("c2",), ("x",)]
    assert rows(buffer.select("total_received").distinct(), "total_received") == [(13,)]
    status = jobs.pipeline_status(spark, query, buffer, 5).first()
    assert (status["stream_active"], status["status"], status["total_received"], status["buffer_used"]) == (False, "stopped", 13, 5)
    assert jobs.progress_rows(spark, query).agg(F.sum("input_rows")).first()[0] == 13
    # a replayed batch changes nothing
    before = rows(buffer, "event_id", "total_received")
    jobs.keep_latest(folder, 5)(source.batch().where("kafka_partition = 2"), 2)
    again = jobs.live_buffer(spark, folder)
    assert rows(again, "event_id", "total_received") == before


def test_replayed_batches_are_written_once(spark, source, tmp_path):
    source.add(("1", "u", 0), ("2", "u", 90000))
    stamped = source.batch().withColumn("ingested_at", F.col("received_at"))
    write = jobs.append_batch(str(tmp_path / "table"))
    write(stamped, 0)
    write(stamped, 1)
    write(stamped, 0)
    out = spark.read.parquet(str(tmp_path / "table"))
    assert out.count() == 4 and {"ingest_date", "batch_id"} <= set(out.columns)
    assert rows(out.select("batch_id").distinct(), "batch_id") == [(0,), (1,)]


def test_resume_from_the_checkpoint(spark, source, tmp_path):
    def run():
        stamped = source.stream().withColumn("ingested_at", F.col("received_at"))
        jobs.run_available(stamped, jobs.append_batch(str(tmp_path / "out")), str(tmp_path / "check"), timeout=120)
        return spark.read.parquet(str(tmp_path / "out")).count()

    source.add(("1", "u", 0))
    assert run() == 1
    source.add(("2", "u", 1), ("3", "u", 2))
    assert run() == 3
    assert run() == 3


def test_continuous_run_and_listener(spark, source, tmp_path):
    source.add(("1", "u", 0), ("2", "u", 1))
    listener = jobs.StatusListener()
    spark.streams.addListener(listener)
    try:
        stamped = source.stream().withColumn("ingested_at", F.col("received_at"))
        query = jobs.run_stream(stamped, jobs.append_batch(str(tmp_path / "out")), str(tmp_path / "check"), "1 second")
        query.processAllAvailable()
        assert jobs.pipeline_status(spark, query).first()["status"] == "running"
        query.stop()
    finally:
        spark.streams.removeListener(listener)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert all(entry["rows"] <= 2 for entry in listener.totals.values())


def test_stream_to_table(spark, source, tmp_path):
    source.add(("1", "u", 0), ("2", "u", 1))
    stamped = source.stream().withColumn("ingested_at", F.col("received_at"))
    query = jobs.stream_to_table(stamped, "streamed_events", str(tmp_path / "check"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.table("streamed_events").count() == 2


def test_failed_stream_reports_its_error(spark, source, tmp_path):
    source.add(("1", "u", 0))

    def broken(batch, batch_id):
        raise RuntimeError("sink is gone")

    query = source.stream().writeStream.foreachBatch(broken).option("checkpointLocation", str(tmp_path / "c")).start()
    with pytest.raises(Exception):
        query.awaitTermination(60)
    status = jobs.pipeline_status(spark, query).first()
    assert status["status"] == "error" and "sink is gone" in status["last_error"]


def test_late_events_are_counted(spark):
    df = spark.createDataFrame([("a", 0, 700), ("b", 0, 10)], "id string, own long, got long")
    timed = df.select("id", F.timestamp_seconds("own").alias("own"), F.timestamp_seconds("got").alias("received_at"))
    assert rows(jobs.count_late(timed, "10 minutes", "own"), "id", "is_late") == [("a", True), ("b", False)]


def test_parse_stamps_one_clock_per_batch(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.txt").write_text('{"name":"x","event_id":"1"}\n{bad\n')
    lines = spark.readStream.text(str(raw)).select(
        F.col("value").alias("message"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"),
        F.current_timestamp().alias("event_timestamp"),
    )
    parsed = envelope.parse_envelope(lines)
    jobs.run_available(parsed, jobs.append_batch(str(tmp_path / "out")), str(tmp_path / "check"), timeout=120)
    good, bad = envelope.quarantined(spark.read.parquet(str(tmp_path / "out")))
    assert (good.count(), bad.count()) == (1, 1)
    assert good.select("ingested_at").union(bad.select("ingested_at")).distinct().count() == 1


# Recorded progress, late rows, state, compaction


LOG_REPORTS = [
    '{"id":"q","runId":"r1","batchId":0,"timestamp":"2024-01-01T00:00:00.000Z","numInputRows":5,"durationMs":{"addBatch":10,"triggerExecution":20},'
    '"stateOperators":[],"sources":[{"description":"KafkaV2[Subscribe[a]]","startOffset":null,"endOffset":{"a":{"0":3,"1":2}},"latestOffset":{"a":{"0":9,"1":2}},"numInputRows":5}]}',
    '{"id":"q","runId":"r1","batchId":1,"timestamp":"2024-01-01T00:00:05.000Z","numInputRows":4,"durationMs":{"addBatch":10,"triggerExecution":2000},'
    '"stateOperators":[{"operatorName":"stateStoreSave","numRowsTotal":7,"numRowsDroppedByWatermark":2,"numRowsRemoved":1}],'
    '"sources":[{"description":"KafkaV2[Subscribe[a]]","startOffset":{"a":{"0":3,"1":2}},"endOffset":{"a":{"0":7,"1":2}},"latestOffset":{"a":{"0":9,"1":4}},"numInputRows":4}]}',
    '{"id":"rate","runId":"r2","batchId":3,"timestamp":"2024-01-01T00:00:05.000Z","numInputRows":1,"durationMs":{},"stateOperators":[],'
    '"sources":[{"description":"RateStreamV2","startOffset":4,"endOffset":6,"latestOffset":10,"numInputRows":1}]}',
    '{"id":"files","runId":"r3","batchId":0,"timestamp":"2024-01-01T00:00:05.000Z","numInputRows":8,"durationMs":{},"stateOperators":[],'
    '"sources":[{"description":"FileStreamSource[x]","startOffset":null,"endOffset":{"logOffset":0},"latestOffset":null,"numInputRows":8}]}',
]


@pytest.fixture
def reports(spark):
    lines = spark.createDataFrame([(r,) for r in LOG_REPORTS], "j string")
    return lines.select(F.from_json("j", progress.REPORT).alias("r")).select("r.*")


def test_lag_from_reports_of_all_kinds_of_sources(spark, reports):
    got = rows(progress.stream_lag(reports), "query_id", "kafka_partition", "next_offset", "end_offset", "lag")
    assert got[0][:4] == ("files", 0, 8, None) and got[1:] == [("q", 0, 7, 9, 2), ("q", 1, 2, 4, 2), ("rate", 0, 6, 10, 4)]
    ends = spark.createDataFrame([(0, 20), (1, 4), (2, 5)], "kafka_partition int, end_offset long")
    lag = progress.stream_lag(reports.where("id = 'q'"), ends)
    assert rows(lag, "kafka_partition", "next_offset", "lag") == [(0, 7, 13), (1, 2, 2), (2, 0, 5)]
    assert progress.stream_lag(reports.where("false")).count() == 0


def test_status_and_rates_from_reports(spark, reports):
    late = progress.late_rows(reports)
    assert rows(late, "query_id", "name", "late_rows", "removed", "state_rows") == [("q", "stateStoreSave", 2, 1, 7)]
    begun = [("q", "r0", "2024-01-01T00:00:00Z", "started", None), ("q", "r0", None, "terminated", "broken"), ("q", "r1", "2024-01-02T00:00:00Z", "started", None)]
    status = progress.status_totals(reports, spark.createDataFrame(begun, progress.EVENT))
    assert rows(status, "query_id", "runs", "batches", "total_received", "late_rows", "state_rows", "status") == [("q", 2, 2, 9, 2, 7, "running")]
    failed = progress.status_totals(reports, spark.createDataFrame(begun[:2], progress.EVENT)).first()
    assert (failed["status"], failed["last_error"]) == ("error", "broken")
    rates = progress.batch_rates(reports).where("query_id = 'q'").orderBy("batch_id").collect()
    assert [r["per_second"] for r in rates] == [250.0, 2.0] and rates[1]["smoothed_per_second"] == pytest.approx(9 / 2.02)


def test_recorder_keeps_reports_over_a_restart(spark, source, tmp_path):
    for i in range(3):
        source.add((f"e{i}", "u", i), (f"f{i}", "u", i))
    at = runtime.run_dir(spark, "progress")
    assert progress.recorded(spark, at).count() == 0 and progress.recorded_events(spark, at).count() == 0
    with progress.recording(spark, at):
        for most in (1, None):
            jobs.run_available(source.stream(), lambda batch, _: batch.count(), str(tmp_path / "check"), max_batches=most)
    total = progress.status_totals(progress.recorded(spark, at), progress.recorded_events(spark, at)).first()
    assert (total["runs"], total["batches"], total["total_received"], total["status"]) == (2, 3, 6, "stopped")
    jobs.run_available(source.stream(), lambda batch, _: None, str(tmp_path / "other"))
    assert progress.recorded(spark, at).count() == 3


def test_late_events_are_kept_apart(spark, source, tmp_path):
    source.add(("a", "u", 0), ("b", "u", 1000))
    source.add(("c", "u", 900), ("d", "u", 400), ("e", "u", 700))
    source.add(("f", "u", 699.9999), ("g", "u", 2000))
    writer = jobs.split_late(str(tmp_path / "out"), 300, "received_at")

    def twice(batch, batch_id):
        writer(batch, batch_id)
        writer(batch, batch_id)

    jobs.run_available(source.stream(), twice, str(tmp_path / "check"))
    got = jobs.split_rows(spark, str(tmp_path / "out"))
    assert rows(got.where("is_late"), "event_id", "batch_id") == [("d", 1), ("e", 1), ("f", 2)]
    assert got.count() == 7


def test_timed_sessions_equal_the_batch_and_leave_the_state(spark, source):
    draw = random.Random(5)
    for part in range(3):
        at = [part * 4000 + draw.randrange(4000) + draw.random() for _ in range(150)]
        source.add(*[(f"{part}-{i}", draw.choice(["hot", "hot", "u1", "u2", None]), t) for i, t in enumerate(at)])
    source.add(("end", None, 10**6))
    source.add(("end2", None, 10**6 + 1))
    before = spark.conf.get(state.PROVIDER)
    state.use_rocksdb(spark)
    try:
        folder = runtime.run_dir(spark, "timed")
        out = state.stream_sessions_timed(source.stream(), 600, "user_id", delay="2 hours", slice_seconds=30)
        with progress.recording(spark, f"{folder}/progress"):
            jobs.drain_to_files(out, f"{folder}/out", f"{folder}/check", "update", timeout=240)
    finally:
        spark.conf.set(state.PROVIDER, before)
    got = jobs.latest_sessions(spark.read.parquet(f"{folder}/out"), "user_id")
    spans = sessionize.session_spans(sessionize.sessionize(source.batch().where("user_id IS NOT NULL"), "user_id", 600, "fixed"), "user_id")
    columns = ("user_id", "session_no", "started_at", "ended_at", "events")
    assert rows(got, *columns) == rows(spans, *columns)
    held = progress.batch_status(progress.recorded(spark, f"{folder}/progress")).orderBy("batch_id").collect()
    assert max(r["state_rows"] for r in held) > 0 and held[-1]["state_rows"] == 0


def test_packed_slices_hold_every_time(spark, source):
    source.add(*[(f"e{i}", "hot" if i % 3 else None, i * 0.37) for i in range(500)])
    packed = state.pack_slices(source.batch(), "user_id", "received_at", 60).collect()
    assert len(packed) <= 2 * 4 * 8
    assert sum(len(r["packed"]) // 8 for r in packed) == 500


def test_stream_windows_are_two_operators_without_expanding_events(spark, source):
    source.add(("a", "u", 0), ("b", "u", 100), ("c", "u", 1000))
    source.add(("z", "u", 10**6))
    source.add(("z2", "u", 2 * 10**6))
    made = live.window_rates(source.stream().withWatermark("received_at", "1 minute"), "1 hour", "15 minutes", closed=True)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("Aggregate [") == 2
    # the copies for overlapping windows are made above the first aggregate, from its counts
    assert plan.count("Expand [") == 1 and plan.index("Expand [") < plan.rindex("Aggregate [")
    got = spark.read.parquet(drain(spark, made)).where("events < 3 OR events = 3").where(F.col("window_start") < F.lit("2024-01-02").cast("timestamp"))
    want = live.window_rates(source.batch(), "1 hour", "15 minutes").where(F.col("window_start") < F.lit("2024-01-02").cast("timestamp"))
    assert rows(got, "window_start", "events") == rows(want, "window_start", "events")


def test_compaction_swaps_days_and_survives_replay(spark, source, tmp_path):
    for part in range(4):
        source.add(*[(f"{part}-{i}", "u", part * 30 + i * 40_000) for i in range(6)])
    path, check = str(tmp_path / "out"), str(tmp_path / "check")
    writer, batches = jobs.append_batch(path), {}

    def keep(batch, batch_id):
        batches[batch_id] = batch.sparkSession.createDataFrame(batch.collect(), batch.schema)
        writer(batch, batch_id)

    stamped = source.stream().withColumn("ingested_at", F.col("received_at"))
    jobs.run_available(stamped, keep, check, max_batches=3)
    assert compaction.committed_batch(spark, check) == 2
    want = rows(source.batch().where("kafka_partition < 3"), "event_id")
    files = {r["ingest_date"]: r["files"] for r in compaction.count_files(spark, path).collect()}
    assert compaction.compact_days(spark, path, "2024-01-03", 2) == ["2024-01-01", "2024-01-02"]
    after = {r["ingest_date"]: r["files"] for r in compaction.count_files(spark, path).collect()}
    assert sorted(f"{d}" for d in files if after[d] < files[d]) == ["2024-01-01", "2024-01-02"]
    assert rows(compaction.read_batches(spark, path), "event_id") == want
    # a batch that comes back is not read twice, and one that is late joins the next generation
    writer(batches[1], 1)
    assert rows(compaction.read_batches(spark, path), "event_id") == want
    jobs.run_available(stamped, keep, check)
    everything = rows(source.batch(), "event_id")
    assert rows(compaction.read_batches(spark, path), "event_id") == everything
    assert compaction.compact_days(spark, path, "2024-01-03", 3, least=1) == ["2024-01-01", "2024-01-02"]
    assert compaction.compact_days(spark, path, "2024-01-03", 3, least=1) == []
    assert rows(compaction.read_batches(spark, path), "event_id") == everything
    assert {str(r[0]) for r in compaction.read_batches(spark, path, "2024-01-02").select("ingest_date").distinct().collect()} == {"2024-01-02", "2024-01-03"}
    with pytest.raises(FileNotFoundError):
        compaction.read_batches(spark, str(tmp_path / "none"))


def test_repeated_batches_of_a_table(spark, make_events):
    from clickloom.sources import events as table_io

    for batches, want in ((True, 4), (False, 8)):
        name = f"repeated_{batches}".lower()
        table_io.create_event_table(spark, name, batches=batches)
        for number in (0, 1):
            batch = make_events({"id": f"a{number}"}, {"id": f"b{number}", "t": 90_000})
            writer = jobs.append_table(name)
            writer(batch, number)
            writer(batch, number)
        assert spark.table(name).count() == want
        spark.sql(f"DROP TABLE {name}")
