"""Live view: filters, pages of newest events, windowed counts and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import schema
from clickloom.functions import scalars as sf
from clickloom.operators import envelope, periods

BUFFER_SIZE = 200
WINDOW_SECONDS = 300

#: Columns of the live view that are always there, and those shown when non-empty.
LIVE_COLUMNS = (
    "event_name", "event_timestamp", "user_id", "page_path", "component",
    "properties_json", "kafka_timestamp", "received_at",
)
OPTIONAL_COLUMNS = ("event_id", "project_id", "anonymous_id", "session_id", "source")


def filter_events(events: DataFrame, name: str | None = None, user_id: str | None = None) -> DataFrame:
    if name:
        events = events.where(F.col("event_name") == name)
    if user_id:
        events = events.where(F.col("user_id") == user_id)
    return events


def newest_first() -> list[Column]:
    return [F.col(c).desc() for c in schema.ORDER_COLUMNS]


def latest_n(events: DataFrame, n: int = BUFFER_SIZE) -> DataFrame:
    return events.orderBy(*newest_first()).limit(n)


def page_events(events: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first.

    A page near the top ends in a top-k of ``offset + limit`` rows. For a deeper one the
    rows are first counted by ranges of their arrival time, and only the ranges that
    hold the page are sorted; this reads one column a few times while the page is defined.
    """
    if limit < 1 or offset < 0:
        raise ValueError("a page has a limit of at least 1 and an offset of at least 0")
    if offset + limit > SHALLOW:
        events, offset = narrow_to(events, limit, offset)
    return events.orderBy(*newest_first()).offset(offset).limit(limit)


#: Pages that end within so many rows are found by a top-k of all rows.
SHALLOW = 1000
#: Ranges counted at a time, and rows that are sorted without a further cut.
RANGES, SORTED_ROWS = 1024, 10_000
#: Numbers that order events, first to last; a missing one comes last.
ORDER_KEYS = ("unix_micros(received_at)", "CAST(kafka_partition AS bigint)", "kafka_offset")
MISSING = -(1 << 62)


def narrow_to(events: DataFrame, limit: int, offset: int) -> tuple[DataFrame, int]:
    """The rows of the narrowest ranges that hold a page, and the page's offset among them.

    The ranges of the first key are cut until they hold few rows. Rows that share one
    value of a key are cut by the next key. At most ``RANGES`` counts reach the driver.
    """
    for key in ORDER_KEYS:
        value = F.coalesce(F.expr(key), F.lit(MISSING))
        bounds = events.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
        low, high = bounds["low"], bounds["high"]
        while low is not None and low < high:
            width = -(-(high - low + 1) // RANGES)
            inside = events.where((value >= low) & (value <= high))
            place = F.expr(f"div({high} - coalesce({key}, {MISSING}), {width})")
            counts = sorted((r["place"], r["n"]) for r in inside.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect())
            first = last = None
            passed = rows = 0
            for number, n in counts:
                if first is None and passed + n <= offset:
                    passed += n
                    continue
                first = number if first is None else first
                last, rows = number, rows + n
                if passed + rows >= offset + limit:
                    break
            if first is None:
                # the page is past the end
                return events.where(F.lit(False)), 0
            offset -= passed
            span = high - low
            low, high = max(low, high - (last + 1) * width + 1), high - first * width
            # a page that spans most of its range is not narrowed further
            if rows - limit <= SORTED_ROWS or width == 1 or high - low > span * 9 // 10:
                break
        if low is None:
            return events, offset
        events = events.where((value >= low) & (value <= high))
        if low < high or rows_within(events, SORTED_ROWS):
            break
    return events, offset


def rows_within(events: DataFrame, n: int) -> bool:
    return events.limit(n + 1).count() <= n


def page_after(events: DataFrame, last, limit: int = 50) -> DataFrame:
    """The page that follows a row in the newest-first order, at the same cost at any depth.

    ``last`` has the order columns of the last row seen, as a row or a mapping.
    """
    if limit < 1:
        raise ValueError("a page has a limit of at least 1")
    behind, equal = F.lit(False), F.lit(True)
    for c in schema.ORDER_COLUMNS:
        seen = F.lit(last[c]).cast(events.schema[c].dataType)
        after = F.coalesce(F.col(c) < seen, seen.isNotNull() & F.col(c).isNull())
        behind = behind | (equal & after)
        equal = equal & F.col(c).eqNullSafe(seen)
    return events.where(behind).orderBy(*newest_first()).limit(limit)


def page_meta(events: DataFrame, page: DataFrame, limit: int, offset: int) -> DataFrame:
    return events.agg(F.count("*").alias("total_matched")).select(
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        page.agg(F.count("*")).scalar().alias("returned"),
        "total_matched",
    )


def live_projection(events: DataFrame) -> DataFrame:
    """The live row: eight columns, the ids that are non-empty, and the context if any."""
    rows = events if "component" in events.columns else envelope.with_component(events)
    extra = [c for c in (*OPTIONAL_COLUMNS, "context_json") if c in rows.columns]
    return rows.select(*LIVE_COLUMNS, *[sf.present(F.col(c)).alias(c) for c in extra])


def legacy_projection(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("raw_payload").alias("message"), F.col("event_name").alias("name"), "kafka_timestamp", "received_at"
    )


def live_stats(events: DataFrame, seconds: int, as_of) -> DataFrame:
    """Counts and rate per minute in the window: one row for all, then one per name.

    The total adds up the names' counts; a window without events has a total of 0.
    Names with equal counts are in the order in which they were first seen.
    """
    if seconds < 1:
        raise ValueError("the window has at least one second")
    recent = periods.events_in_window(events, seconds, as_of)
    names = recent.groupBy(F.col("event_name").alias("name")).agg(F.count("*").alias("events"), F.min("received_at").alias("_seen"))
    total = names.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"))
    counts = names.select(F.lit("name").alias("scope"), "name", "events", "_seen").unionByName(
        total.select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("name"), "events", F.lit(None).cast("timestamp").alias("_seen"))
    )
    return counts.orderBy("scope", F.desc("events"), "_seen", "name").select(
        "scope", "name", "events",
        F.bround(F.col("events") / seconds * 60, 2).alias("rate_per_minute"),
        F.lit(seconds).alias("window_seconds"),
    )


def distinct_names(events: DataFrame) -> DataFrame:
    named = events.where(sf.present(F.col("event_name")).isNotNull())
    return named.select(F.col("event_name").alias("name")).distinct().orderBy("name")


def new_since(page: DataFrame, last_seen: Column, known: DataFrame) -> DataFrame:
    """Add ``is_new``: later than the last seen event and not shown before.

    Both frames are pages of the live view, so they hold at most a buffer of rows.
    """
    key = sf.event_clock_key(*[F.col(c) for c in ("event_name", "event_timestamp", "received_at", "user_id", "page_path")])
    shown = known.select(key.alias("_key")).distinct().withColumn("_shown", F.lit(True))
    later = F.col("received_at") > last_seen
    return (
        page.withColumn("_key", key)
        .join(shown, "_key", "left")
        .withColumn("is_new", F.coalesce(later, F.lit(True)) & F.col("_shown").isNull())
        .drop("_key", "_shown")
    )


def live_snapshot(
    events: DataFrame, as_of, name: str | None = None, user_id: str | None = None,
    limit: int = 50, offset: int = 0, seconds: int = WINDOW_SECONDS, status: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Page, page numbers, window statistics and, where given, the status of the stream."""
    matched = filter_events(events, name, user_id)
    page = page_events(matched, limit, offset)
    shot = {
        "events": live_projection(page),
        "meta": page_meta(matched, page, limit, offset),
        "stats": live_stats(events, seconds, as_of),
    }
    return shot if status is None else shot | {"status": status}


def window_rates(events: DataFrame, window: str, slide: str | None = None, *by: str, ts: str = "received_at", closed: bool = False) -> DataFrame:
    """Events and rates per sliding window.

    Events are first counted per slide, so the windows multiply counts and not events.
    On a stream that takes ``closed`` these are two stateful operators, the second on the
    time of the first's windows; such a stream needs a watermark and output mode ``append``,
    and gives a window once it is closed. For other output modes Spark allows one
    stateful operator, and events go into their windows directly.
    """
    if slide is None or (events.isStreaming and not closed):
        counts = events.groupBy(F.window(ts, window, slide), *by).agg(F.count("*").alias("events"))
    else:
        per_slide = events.groupBy(F.window(ts, slide).alias("_s"), *by).agg(F.count("*").alias("n"))
        if events.isStreaming:
            at = F.window_time("_s").alias("_t")
            counts = per_slide.select(at, *by, "n").groupBy(F.window("_t", window, slide), *by).agg(F.sum("n").alias("events"))
        else:
            stamped = per_slide.withColumn("_t", F.col("_s.start"))
            counts = stamped.groupBy(F.window("_t", window, slide), *by).agg(F.sum("n").alias("events"))
    length = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return counts.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *by,
        "events",
        (F.col("events") / length).alias("per_second"),
        (F.col("events") / length * 60).alias("per_minute"),
    )
