"""Fixed-age sessions by a state processor with timers, fed by packed slices.

A micro-batch's times are first packed per key and time slice inside each map task: one row with
the sorted times of the slice as bytes. A busy key thus sends few rows, and the processor
holds the times of one slice at a time, never those of a whole batch. What waits for its turn lies in
the state store (RocksDB, on disk), not in memory.

State per key is the open session, and leaves with its timer when the watermark has
passed the session's end.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Seconds of a slice.
SLICE = 60
OUTPUT = "started_us long, ended_us long, events long"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, which the processor needs."""
    spark.conf.set(PROVIDER, ROCKSDB)


def pack_slices(events: DataFrame, key: str, ts: str, slice_seconds: int = SLICE) -> DataFrame:
    """``key``, ``slice``, ``at`` (newest time) and ``packed``: a task's times of one key and slice, sorted.

    Works on batches and on streams, without a shuffle and without state.
    """
    length = slice_seconds * 1_000_000

    def pack(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            owner, us = codes.indices.to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort([us, owner])
            owner, us = owner[order], us[order]
            part = us // length
            begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]))
            end = np.append(begin[1:], len(us))
            packed = [us[a:b].astype("<i8").tobytes() for a, b in zip(begin, end)]
            yield pa.RecordBatch.from_arrays(
                [codes.dictionary.take(pa.array(owner[begin])), pa.array(part[begin]), pa.array(us[end - 1]), pa.array(packed, pa.binary())],
                [key, "slice", "us", "packed"])

    rows = events.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias(key), F.unix_micros(ts).alias("us"))
    found = rows.mapInArrow(pack, f"{key} string, slice long, us long, packed binary")
    return found.select(key, "slice", F.timestamp_micros("us").alias("at"), "packed")


class FixedSessions(StatefulProcessor):
    """Advances one key's sessions slice by slice and gives their current numbers as updates."""

    def __init__(self, key: str, timeout_us: int):
        self.key, self.timeout = key, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OUTPUT)
        self.waiting = handle.getMapState("waiting", "slice long", "packed binary")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        # only the numbers of the slices are kept here
        slices = set()
        for frame in rows:
            for number, packed in zip(frame["slice"], frame["packed"]):
                number = (int(number),)
                held = self.waiting.getValue(number)[0] if self.waiting.containsKey(number) else b""
                self.waiting.updateValue(number, (held + bytes(packed),))
                slices.add(number)
        out = []
        current = self.open.get()
        start, end, n = (int(x) for x in current) if current is not None else (None, None, 0)
        for number in sorted(slices):
            times = np.sort(np.frombuffer(self.waiting.getValue(number)[0], dtype="<i8"))
            self.waiting.removeKey(number)
            at = 0
            while at < len(times):
                if start is None or times[at] >= start + self.timeout:
                    if start is not None:
                        out.append((key[0], start, end, n))
                    start, end, n = int(times[at]), int(times[at]), 0
                # times before the open session join it
                stop = int(np.searchsorted(times, start + self.timeout, side="left"))
                end, n, at = max(end, int(times[stop - 1])), n + stop - at, stop
        out.append((key[0], start, end, n))
        self.open.update((start, end, n))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((start + self.timeout) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield pd.DataFrame(out, columns=[self.key, "started_us", "ended_us", "events"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_sessions_timed(
    events: DataFrame, timeout_seconds: int = 1800, key: str = "actor_key", ts: str = "received_at", delay: str = "10 minutes",
    slice_seconds: int = SLICE,
) -> DataFrame:
    """Sessions by fixed age, as updates that ``jobs.latest_sessions`` turns into final numbers.

    Equal to the batch operator for events that are not late. A packed slice is late, and
    dropped, when its newest time is behind the watermark; an arrival time before the
    open session joins that session. Events without a key have none. Call
    ``use_rocksdb`` before the stream starts.
    """
    packed = pack_slices(events, key, ts, slice_seconds).withWatermark("at", delay)
    # events without a key still move the watermark: a condition on the key alone would be applied below it
    packed = packed.where(F.when(F.col("at").isNotNull(), F.col(key)).isNotNull())
    return packed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=FixedSessions(key, timeout_seconds * 1_000_000), outputStructType=f"{key} string, {OUTPUT}", outputMode="update", timeMode="EventTime",
    )
