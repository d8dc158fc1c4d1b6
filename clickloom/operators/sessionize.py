"""Sessions derived from time alone, by idle gap or by fixed age.

A user may hold a third of all events, so no step orders one user's whole history in
one task. Time is cut into slices; events meet only inside their (user, slice), and
what crosses slices is carried by one summary row per slice. The number of those rows
per user is bounded by the time range, not by the number of events.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from clickloom import runtime

MODES = ("gap", "fixed")
TIMEOUT = 1800
#: Seconds of one user's events that meet in a task when gaps are looked for.
GAP_SLICE = 60
#: Parts of a fixed-age timeout; one user's distinct times of a part meet in a task.
AGE_PARTS = 64
#: Events and slices of a stretch that one task walks through; longer ones go by pointers.
WALKED_EVENTS, WALKED_SLICES = 10_000, 1_000


def sessionize(
    events: DataFrame,
    key: str = "actor_key",
    timeout_seconds: int = TIMEOUT,
    mode: str = "gap",
    time_col: str = "received_at",
    **options,
) -> DataFrame:
    """Add ``session_no`` (from 1 per key) and ``session_started_at``.

    ``gap``    a session ends when the next event comes more than the timeout later
    ``fixed``  a session ends the timeout after its first event, however busy it is

    Events without a key are kept, with both columns NULL.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = events.where(F.col(key).isNotNull()).withColumn("_us", F.unix_micros(F.col(time_col)))
    build = _by_gap if mode == "gap" else _by_age
    numbered = build(rows, key, timeout_seconds * 1_000_000, **options)
    sessions = numbered.withColumn("session_started_at", F.timestamp_micros("_start")).drop("_us", "_slice", "_start")
    # events without a key share no window, however many they are
    lonely = events.where(F.col(key).isNull()).withColumns(
        {"session_no": F.lit(None).cast("long"), "session_started_at": F.lit(None).cast("timestamp")}
    )
    return sessions.unionByName(lonely)


def session_spans(sessionized: DataFrame, key: str = "actor_key", time_col: str = "received_at") -> DataFrame:
    """One row per derived session."""
    return sessionized.where("session_no IS NOT NULL").groupBy(key, "session_no").agg(
        F.min(time_col).alias("started_at"),
        F.max(time_col).alias("ended_at"),
        F.count("*").alias("events"),
    )


def _slice_of(column: str, length: int) -> Column:
    """Number of the time slice, rounding down also before 1970."""
    return F.expr(f"({column} - pmod({column}, {length})) div {length}")


def _earlier(window):
    return window.rowsBetween(W.Window.unboundedPreceding, -1)


def _up_to_here(window):
    return window.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)


def _by_gap(rows: DataFrame, key: str, timeout: int, slice_seconds: int = GAP_SLICE) -> DataFrame:
    sliced = rows.withColumn("_slice", _slice_of("_us", slice_seconds * 1_000_000))
    inside = W.Window.partitionBy(key, "_slice").orderBy("_us")
    breaks = F.col("_us") - F.lag("_us").over(inside) > timeout
    marked = sliced.withColumn("_break", F.when(breaks, F.col("_us")))

    # same grouping as the window above, so no further shuffle
    slices = marked.groupBy(key, "_slice").agg(
        F.min("_us").alias("_first"),
        F.max("_us").alias("_last"),
        F.max("_break").alias("_last_break"),
        F.count("_break").alias("_breaks"),
    )
    along = W.Window.partitionBy(key).orderBy("_slice")
    idle = F.col("_first") - F.lag("_last").over(along)
    opened = slices.withColumn("_opens", F.coalesce(idle > timeout, F.lit(True)))
    latest = F.coalesce("_last_break", F.when(F.col("_opens"), F.col("_first")))
    began = F.col("_breaks") + F.col("_opens").cast("long")
    carried = opened.select(
        key,
        "_slice",
        F.when(F.col("_opens"), F.col("_first"))
        .otherwise(F.last(latest, ignorenulls=True).over(_earlier(along)))
        .alias("_entering"),
        (F.coalesce(F.sum(began).over(_earlier(along)), F.lit(0)) + F.col("_opens").cast("long")).alias("_base"),
    )
    here = _up_to_here(inside)
    return (
        marked.withColumn("_seen", F.last("_break", ignorenulls=True).over(here))
        .withColumn("_count", F.count("_break").over(here))
        .join(carried, [key, "_slice"], "left")
        .withColumn("_start", F.coalesce("_seen", "_entering"))
        .withColumn("session_no", F.col("_base") + F.col("_count"))
        .drop("_break", "_seen", "_count", "_entering", "_base")
    )


def _by_age(rows: DataFrame, key: str, timeout: int, parts: int = AGE_PARTS) -> DataFrame:
    """Slices as long as the timeout: each holds at most one session start.

    A start at s closes at s + timeout, which is never before the end of its slice.
    So an event belongs to the start in its own slice, or to the last one before.
    """
    sliced = rows.withColumn("_slice", _slice_of("_us", timeout))
    # written once: the summaries are read by every step below
    slices, _ = _written(_islands(sliced, key, timeout))
    walked = F.col("_long") & (F.col("_events") <= WALKED_EVENTS) & (F.col("_slices") <= WALKED_SLICES)
    starts = slices.where("_slice = _island_slice").where(~walked).select(key, F.col("_island").alias("_at"))
    some, widest = slices.agg(F.max(walked), F.max(F.when(F.col("_long") & ~walked, F.col("_slices")))).first()

    def times_of(chosen: Column) -> DataFrame:
        stretches = slices.where(chosen).select(key, "_slice", "_island")
        return sliced.select(key, "_slice", "_us").join(stretches, [key, "_slice"]).select(key, "_island", "_us")

    # a stretch that reaches the timeout lies in two slices at least
    if widest:
        pointers = _next_starts(times_of(F.col("_long") & ~walked).distinct(), key, timeout, parts)
        starts = _reached(starts, pointers, key, math.ceil(math.log2(widest)))
    if some:
        starts = starts.unionByName(_walked_starts(times_of(walked), key, timeout))

    along = W.Window.partitionBy(key).orderBy("_slice")
    carried = (
        slices.select(key, "_slice")
        .join(starts.withColumn("_slice", _slice_of("_at", timeout)), [key, "_slice"], "left")
        .withColumn("_before", F.last("_at", ignorenulls=True).over(_earlier(along)))
        .withColumn("_base", F.count("_at").over(_earlier(along)))
    )
    own = F.col("_us") >= F.col("_at")
    return (
        sliced.join(carried, [key, "_slice"], "left")
        .withColumn("_start", F.when(own, F.col("_at")).otherwise(F.col("_before")))
        .withColumn("session_no", F.col("_base") + F.coalesce(own, F.lit(False)).cast("long"))
        .drop("_at", "_before", "_base")
    )


def _walked_starts(times: DataFrame, key: str, timeout: int) -> DataFrame:
    """All starts of stretches whose times fit an array, by one walk through each."""

    def walk(found: Column, us: Column) -> Column:
        return F.when((F.size(found) > 0) & (us < F.element_at(found, -1) + timeout), found).otherwise(F.concat(found, F.array(us)))

    none = F.array().cast("array<bigint>")
    along = F.sort_array(F.collect_set("_us"))
    return times.groupBy(key, "_island").agg(along.alias("_times")).select(key, F.explode(F.aggregate("_times", none, walk)).alias("_at"))


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a table in the shared folder, and its path."""
    path = runtime.passing_dir(df.sparkSession, "sessionize")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _islands(sliced: DataFrame, key: str, timeout: int) -> DataFrame:
    """Slices grouped into stretches without a pause of the timeout.

    The first event after such a pause always starts a session, so stretches are
    independent. One shorter than the timeout is a single session.
    """
    along = W.Window.partitionBy(key).orderBy("_slice")
    slices = sliced.groupBy(key, "_slice").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count("*").alias("_n"))
    pause = F.col("_first") - F.lag("_last").over(along) >= timeout
    island = W.Window.partitionBy(key, "_island")
    return (
        slices.withColumn("_open_at", F.when(F.coalesce(pause, F.lit(True)), F.col("_first")))
        .withColumn("_island", F.last("_open_at", ignorenulls=True).over(_up_to_here(along)))
        .withColumn("_long", F.max("_last").over(island) - F.col("_island") >= timeout)
        .withColumn("_slices", F.count("*").over(island))
        .withColumn("_events", F.sum("_n").over(island))
        .withColumn("_island_slice", _slice_of("_island", timeout))
        .drop("_open_at", "_first", "_last", "_n")
    )


def _next_starts(times: DataFrame, key: str, timeout: int, parts: int) -> DataFrame:
    """Per (key, time): ``_next``, the first time of the stretch a timeout later or more.

    Times and wanted times meet in parts of a slice. A wanted time with nothing after
    it in its part takes the first time of the next part that has one.
    """
    length = max(1, timeout // parts)
    events = times.withColumnsRenamed({"_us": "_t"}).withColumn("_kind", F.lit(0))
    wanted = times.select(key, "_island", (F.col("_us") + timeout).alias("_t"), F.lit(1).alias("_kind"))
    points = events.unionByName(wanted).withColumn("_part", _slice_of("_t", length))
    event_time = F.when(F.col("_kind") == 0, F.col("_t"))
    place = [key, "_island", "_part"]
    here = W.Window.partitionBy(*place).orderBy(F.desc("_t"), "_kind")
    backwards = W.Window.partitionBy(key, "_island").orderBy(F.desc("_part"))
    later = points.groupBy(*place).agg(F.min(event_time).alias("_first")).select(
        *place, F.last("_first", ignorenulls=True).over(_earlier(backwards)).alias("_later")
    )
    return (
        points.withColumn("_found", F.last(event_time, ignorenulls=True).over(_up_to_here(here)))
        .where("_kind = 1")
        .join(later, place)
        .select(key, (F.col("_t") - timeout).alias("_us"), F.coalesce("_found", "_later").alias("_next"))
        .where("_next IS NOT NULL")
    )


def _reached(starts: DataFrame, pointers: DataFrame, key: str, rounds: int) -> DataFrame:
    """All starts that pointers lead to, by pointer doubling.

    Each round doubles the length of the pointers, so a stretch over n slices takes
    log2(n) rounds of joins on (key, time), which are spread evenly. A round reaches
    starts no round before has reached, so nothing repeats, and its tables replace those
    of the round before.
    """
    spark = starts.sparkSession

    def with_next(reached: DataFrame, pointers: DataFrame) -> DataFrame:
        ahead = reached.join(pointers.withColumnRenamed("_us", "_at"), [key, "_at"])
        return reached.unionByName(ahead.select(key, F.col("_next").alias("_at")))

    (pointers, old), reached, done = _written(pointers), starts, None
    with ThreadPoolExecutor(2) as pool:
        for _ in range(rounds - 1):
            further = pointers.select(key, F.col("_us").alias("_next"), F.col("_next").alias("_beyond"))
            longer = pointers.join(further, [key, "_next"]).select(key, "_us", F.col("_beyond").alias("_next"))
            # starts and pointers of a round are independent jobs
            (reached, now), (pointers, new) = pool.map(_written, (with_next(reached, pointers), longer))
            for path in filter(None, (old, done)):
                runtime.remove(spark, path)
            old, done = new, now
    return with_next(reached, pointers)
