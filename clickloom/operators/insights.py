"""Product analytics over canonical events: KPIs, funnel, trends, boards, paths.

Counts aggregate by hash with partial aggregation; ranked lists end in a top-k that
keeps k rows per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from clickloom import schema, taxonomy as tx
from clickloom.functions import scalars as sf
from clickloom.operators import periods, quantiles, sessions
from clickloom.operators.sessions import is_in

KPI_COLUMNS = (
    "sessions",
    "actors",
    "identified_users",
    "form_submissions",
    "conversion_rate_pct",
    "marketplace_engagement_rate_pct",
    "multi_page_session_rate_pct",
    "engaged_session_rate_pct",
)
COMPARED_KPIS = (
    "sessions",
    "form_submissions",
    "conversion_rate_pct",
    "identified_users",
    "marketplace_engagement_rate_pct",
)
ENGAGED_EVENTS = 3


def top_k(events: DataFrame, key: str, k: int | None, count: str = "count") -> DataFrame:
    """Rows per key, most first; ties go to the key seen first, then by key."""
    counts = events.groupBy(key).agg(F.count("*").alias(count), F.min("received_at").alias("_first"))
    ranked = counts.orderBy(F.desc(count), "_first", key)
    return (ranked if k is None else ranked.limit(k)).select(key, count)


# KPIs


def _session_totals(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    return frame.groupBy(*by).agg(
        F.count("*").alias("sessions"),
        F.sum("has_pageview").alias("pageview_sessions"),
        F.sum("has_marketplace").alias("marketplace_sessions"),
        F.sum("has_form_submit").alias("form_sessions"),
        F.sum("form_submissions").alias("form_submissions"),
        F.count_if("multi_page").alias("multi_page_sessions"),
        F.count_if(F.col("event_count") >= ENGAGED_EVENTS).alias("engaged_sessions"),
    )


def _actor_totals(actors: DataFrame, by: Sequence[str]) -> DataFrame:
    return actors.groupBy(*by).agg(
        F.count("*").alias("actors"), F.sum("identified").alias("identified_users")
    )


def actor_flags(events: DataFrame, *by: str, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """One row per actor; ``identified`` is 1 with a user id or an identify event."""
    known = sf.present(F.col("user_id")).isNotNull() | is_in(taxonomy.identify)
    return events.groupBy(*by, "actor_key").agg(
        F.max(F.when(known, F.lit(1)).otherwise(F.lit(0))).alias("identified")
    )


def kpis_from(frame: DataFrame, actors: DataFrame, *by: str) -> DataFrame:
    """KPIs from a session frame and an actor frame, one row per value of ``by``."""
    parts = _session_totals(frame, by).unionByName(_actor_totals(actors, by), allowMissingColumns=True)
    names = [c for c in parts.columns if c not in by]
    total = parts.groupBy(*by).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])
    return _kpi_rates(total, *by)


def _kpi_rates(total: DataFrame, *by: str) -> DataFrame:
    """Rates of the KPIs; an empty base counts as 1."""
    viewed, all_sessions = (F.greatest(F.col(c), F.lit(1)) for c in ("pageview_sessions", "sessions"))
    return total.select(
        *by,
        "sessions",
        "actors",
        "identified_users",
        "form_submissions",
        sf.pct(F.col("form_sessions"), viewed).alias("conversion_rate_pct"),
        sf.pct(F.col("marketplace_sessions"), viewed).alias("marketplace_engagement_rate_pct"),
        sf.pct(F.col("multi_page_sessions"), all_sessions).alias("multi_page_session_rate_pct"),
        sf.pct(F.col("engaged_sessions"), all_sessions).alias("engaged_session_rate_pct"),
    )


def kpis(events: DataFrame, *by: str, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """KPIs straight from events, in one scan.

    Two grouping sets over the same rows: (session, page), which also answers whether
    a session saw two pages, and (actor). All buffers are numbers, so every step
    aggregates by hash.
    """
    form, pageview = is_in(taxonomy.form_submit), F.col("event_name") == taxonomy.pageview
    known = sf.present(F.col("user_id")).isNotNull() | is_in(taxonomy.identify)
    flag = lambda c: F.max(F.when(c, F.lit(1)).otherwise(F.lit(0)))
    seen = ("has_pageview", "has_marketplace", "has_form_submit", "identified")
    rows = events.withColumn("_page", sf.present(F.col("page_path")))
    parts = rows.groupingSets(
        [[*by, "session_key", "_page"], [*by, "actor_key"]], *by, "session_key", "_page", "actor_key"
    ).agg(
        F.count("*").alias("event_count"),
        F.sum(F.when(form, 1).otherwise(0)).alias("form_submissions"),
        flag(pageview).alias("has_pageview"),
        flag(is_in(taxonomy.marketplace)).alias("has_marketplace"),
        flag(form).alias("has_form_submit"),
        flag(known).alias("identified"),
        F.grouping("session_key").alias("is_actor"),
    )
    both = parts.groupBy(*by, "is_actor", "session_key", "actor_key").agg(
        *[F.max(c).alias(c) for c in seen],
        *[F.sum(c).alias(c) for c in ("event_count", "form_submissions")],
        (F.count("_page") >= 2).alias("multi_page"),
    )
    frame = F.col("is_actor") == 0
    of_session = lambda c: F.sum(F.when(frame, F.col(c)))
    total = both.groupBy(*by).agg(
        F.count_if(frame).alias("sessions"),
        F.count_if(~frame).alias("actors"),
        F.sum(F.when(~frame, F.col("identified"))).alias("identified_users"),
        of_session("form_submissions").alias("form_submissions"),
        of_session("has_pageview").alias("pageview_sessions"),
        of_session("has_marketplace").alias("marketplace_sessions"),
        of_session("has_form_submit").alias("form_sessions"),
        F.count_if(frame & F.col("multi_page")).alias("multi_page_sessions"),
        F.count_if(frame & (F.col("event_count") >= ENGAGED_EVENTS)).alias("engaged_sessions"),
    )
    return _kpi_rates(total.fillna(0), *by)


def kpi_comparison(by_period: DataFrame) -> DataFrame:
    """Change in percent of five KPIs; all NULL without a previous period."""
    wide = periods.compare_periods(by_period, list(COMPARED_KPIS))
    had_events = F.col("sessions_previous") > 0
    return wide.select(
        *[F.when(had_events, F.col(f"{n}_delta_pct")).alias(f"{n}_delta_pct") for n in COMPARED_KPIS]
    )


# Funnel


def funnel(frame: DataFrame) -> DataFrame:
    """Six unordered session steps; rate against the last non-zero earlier step."""
    steps = [s for s, _ in tx.FUNNEL_STEPS]
    one = frame.agg(
        F.count("*").alias("sessions"),
        *[F.coalesce(F.sum(f"has_{s}"), F.lit(0)).alias(s) for s in steps],
    )
    base = F.coalesce(F.nullif("sessions", F.lit(0)), F.lit(1))
    rows = []
    for position, (step, label) in enumerate(tx.FUNNEL_STEPS):
        rows.append(
            F.struct(
                F.lit(position + 1).alias("position"),
                F.lit(step).alias("step"),
                F.lit(label).alias("label"),
                F.col(step).alias("sessions"),
                sf.pct(F.col(step), base).alias("rate_pct"),
            )
        )
        base = F.coalesce(F.nullif(step, F.lit(0)), base)
    return one.select(F.inline(F.array(*rows)))


# Activity


def activity_trends(events: DataFrame, hourly: bool, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Events, sessions by first event and form submissions per UTC hour or day.

    One scan with two grouping sets: buckets of events, and the start of each session.
    """
    rows = events.select(
        sf.bucket_key(F.col("received_at"), hourly).alias("label"), "session_key", "received_at", "event_name"
    )
    parts = rows.groupingSets([["label"], ["session_key"]], "label", "session_key").agg(
        F.count("*").alias("events"),
        F.count_if(is_in(taxonomy.form_submit)).alias("form_submissions"),
        F.min("received_at").alias("started"),
        F.grouping("label").alias("is_session"),
    )
    session = F.col("is_session") == 1
    label = F.when(session, sf.bucket_key(F.col("started"), hourly)).otherwise(F.col("label"))
    return parts.groupBy(label.alias("label")).agg(
        F.coalesce(F.sum(F.when(~session, F.col("events"))), F.lit(0)).alias("events"),
        F.count_if(session).alias("sessions"),
        F.coalesce(F.sum(F.when(~session, F.col("form_submissions"))), F.lit(0)).alias("form_submissions"),
    ).orderBy("label")


def hourly_activity(events: DataFrame, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Events and form submissions per hour, the base of trends and heatmap."""
    return events.groupBy(F.date_trunc("hour", "received_at").alias("hour_start")).agg(
        F.count("*").alias("events"), F.count_if(is_in(taxonomy.form_submit)).alias("form_submissions")
    )


def trends_from(hours: DataFrame, frame: DataFrame, hourly: bool) -> DataFrame:
    """``activity_trends`` from hourly counts and a session frame."""
    per_event = hours.select(sf.bucket_key(F.col("hour_start"), hourly).alias("label"), "events", "form_submissions")
    per_session = frame.groupBy(sf.bucket_key(F.col("first_activity_at"), hourly).alias("label")).agg(
        F.count("*").alias("sessions")
    )
    return align_buckets(per_event, per_session, key="label", values=("events", "sessions", "form_submissions"))


def align_buckets(*series: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Outer alignment of bucketed counts, missing ones 0, in key order."""
    rows = series[0]
    for other in series[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return (
        rows.groupBy(key).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]).orderBy(key)
    )


def is_hourly(window_seconds: float) -> bool:
    return window_seconds < periods.DAY


def activity_heatmap(events: DataFrame) -> DataFrame:
    """All 168 weekday and hour cells (Monday 0, UTC) with counts and the maximum."""
    return heatmap_from(hourly_activity(events))


def heatmap_from(hours: DataFrame) -> DataFrame:
    t = F.col("hour_start")
    counts = hours.groupBy(F.weekday(t).alias("weekday"), F.hour(t).alias("hour")).agg(
        F.sum("events").alias("events")
    )
    cells = hours.sparkSession.range(168, numPartitions=1).select(
        F.expr("CAST(id DIV 24 AS INT)").alias("weekday"),
        F.expr("CAST(id % 24 AS INT)").alias("hour"),
        F.lit(0).cast("long").alias("events"),
    )
    grid = counts.unionByName(cells).groupBy("weekday", "hour").agg(F.sum("events").alias("events"))
    days = F.array(*[F.lit(d) for d in tx.WEEKDAYS])
    # one window over exactly 168 rows
    return grid.select(
        "weekday",
        F.get(days, F.col("weekday")).alias("day"),
        "hour",
        "events",
        F.max("events").over(W.Window.partitionBy(F.lit(0))).alias("max_count"),
    )


# Leaderboards


@dataclass(frozen=True)
class Board:
    """A ranked list: which events count, under which label, and how to name both."""

    names: Callable[[tx.Taxonomy], Sequence[str] | None]
    keys: Sequence[str]
    label: Callable[[Column, Column], Column]
    column: str
    count: str
    size: int


#: ``label`` gets the event name and the first non-blank of the listed properties.
BOARDS = {
    "top_pages": Board(lambda t: (t.pageview,), (), lambda name, prop: sf.present(F.col("page_path")), "path", "views", 8),
    "top_events": Board(lambda t: None, (), lambda name, prop: name, "name", "count", 10),
    "cta_leaderboard": Board(
        lambda t: t.cta_leaderboard, tx.CTA_KEYS, lambda name, prop: F.concat_ws(" · ", name, prop), "label", "clicks", 8
    ),
    "faq_leaderboard": Board(
        lambda t: t.faq, tx.FAQ_KEYS, lambda name, prop: F.coalesce(prop, name), "question", "opens", 8
    ),
    "engine_leaderboard": Board(
        lambda t: t.playground, tx.ENGINE_KEYS, lambda name, prop: F.coalesce(prop, name), "engine", "interactions", 8
    ),
    "blueprint_leaderboard": Board(
        lambda t: t.blueprint_interaction, tx.BLUEPRINT_KEYS, lambda name, prop: prop, "blueprint", "interactions", 8
    ),
}


def board_counts(events: DataFrame, *boards: str, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Counts per board, label and event name: all boards from one scan and one shuffle.

    For a single board its event names reach the file scan as a filter.
    """
    boards = boards or tuple(BOARDS)
    keys = [k for b in boards for k in BOARDS[b].keys]
    counted = [BOARDS[b].names(taxonomy) for b in boards]
    if all(n is not None for n in counted):
        events = events.where(is_in({name for n in counted for name in n}))
    rows = events.withColumn("_p", sf.property_struct(F.col("properties_json"), keys)) if keys else events
    entries = []
    for board in boards:
        spec, chosen = BOARDS[board], BOARDS[board].names(taxonomy)
        prop = sf.first_prop(F.col("_p"), spec.keys) if spec.keys else None
        entry = F.struct(F.lit(board).alias("board"), spec.label(F.col("event_name"), prop).alias("label"))
        entries.append(entry if chosen is None else F.when(is_in(chosen), entry))
    tall = rows.select("event_name", "received_at", F.explode(F.array(*entries)).alias("e"))
    return (
        tall.select("event_name", "received_at", "e.board", "e.label")
        .where("label IS NOT NULL")
        .groupBy("board", "label", "event_name")
        .agg(F.count("*").alias("n"), F.min("received_at").alias("first"))
    )


def board_top(counts: DataFrame, board: str, k: int | None = None) -> DataFrame:
    """The ``k`` largest labels of a board; ties go to the one seen first, then by label."""
    spec = BOARDS[board]
    labels = counts.where(F.col("board") == board).groupBy("label").agg(
        F.sum("n").alias("n"), F.min("first").alias("first")
    )
    top = labels.orderBy(F.desc("n"), "first", "label").limit(spec.size if k is None else k)
    return top.select(F.col("label").alias(spec.column), F.col("n").alias(spec.count))


def board_tops(counts: DataFrame, *boards: str) -> DataFrame:
    """The top labels of several boards in one ranking: board, rank, label, n.

    The rank filter keeps the largest board's size per board and task before the
    shuffle that brings a board together.
    """
    boards = boards or tuple(BOARDS)
    sizes = F.create_map(*[F.lit(x) for b in boards for x in (b, BOARDS[b].size)])
    labels = counts.where(F.col("board").isin(*boards)).groupBy("board", "label").agg(
        F.sum("n").alias("n"), F.min("first").alias("first")
    )
    rank = F.row_number().over(W.Window.partitionBy("board").orderBy(F.desc("n"), "first", "label"))
    ranked = labels.withColumn("rank", rank).where(F.col("rank") <= max(BOARDS[b].size for b in boards))
    return ranked.where(F.col("rank") <= F.element_at(sizes, F.col("board"))).select("board", "rank", "label", "n")


def leaderboard(events: DataFrame, board: str, k: int | None = None, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    return board_top(board_counts(events, board, taxonomy=taxonomy), board, k)


def top_pages(events: DataFrame, k: int = 8) -> DataFrame:
    return leaderboard(events, "top_pages", k)


def top_events(events: DataFrame, k: int = 10) -> DataFrame:
    return leaderboard(events, "top_events", k)


def cta_leaderboard(events: DataFrame, k: int = 8) -> DataFrame:
    return leaderboard(events, "cta_leaderboard", k)


def faq_leaderboard(events: DataFrame, k: int = 8) -> DataFrame:
    return leaderboard(events, "faq_leaderboard", k)


def engine_leaderboard(events: DataFrame, k: int = 8) -> DataFrame:
    return leaderboard(events, "engine_leaderboard", k)


def blueprint_leaderboard(events: DataFrame, k: int = 8) -> DataFrame:
    return leaderboard(events, "blueprint_leaderboard", k)


def blueprint_treemap(events: DataFrame, k: int = 12, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    return treemap_from(board_counts(events, "blueprint_leaderboard", taxonomy=taxonomy), k)


def treemap_from(counts: DataFrame, k: int = 12) -> DataFrame:
    """Interactions per blueprint and event, top ``k`` blueprints, long form.

    ``total`` covers all blueprints, also those cut. A blueprint gathers at most one
    entry per interaction event name, which is a fixed set.
    """
    pairs = counts.where("board = 'blueprint_leaderboard'").withColumnRenamed("label", "blueprint")
    entry = F.struct((-F.col("n")).alias("neg"), "first", "event_name", "n")
    boxes = pairs.groupBy("blueprint").agg(
        F.sum("n").alias("value"),
        F.min("first").alias("first"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
    )
    # the unused minimum keeps the total on the same shuffle as the boxes
    total = pairs.agg(F.struct(F.sum("n").alias("n"), F.min("first").alias("first")).alias("t"))
    top = boxes.orderBy(F.desc("value"), "first", "blueprint").limit(k)
    return (
        top.select("blueprint", "value", F.inline("entries"))
        .withColumn("total", total.scalar()["n"])
        .select(
            "blueprint",
            "value",
            "total",
            sf.share_pct(F.col("value"), F.col("total")).alias("share_pct"),
            F.col("event_name").alias("event"),
            sf.short_event_name(F.col("event_name")).alias("event_label"),
            F.col("n").alias("event_value"),
        )
    )


# Paths


def top_paths(
    events: DataFrame, hops: int = 3, k: int = 8, taxonomy: tx.Taxonomy = tx.DEFAULT
) -> DataFrame:
    """Sessions and conversions per navigation path, the first ``hops`` distinct pages.

    Events shrink to distinct (session, page) pairs first. Events that are no page
    view share the pair (session, no page), which sorts first and carries the
    conversion; the rank filter then keeps ``hops + 1`` pairs per session before the
    second shuffle, so no session is ever gathered whole.
    """
    fallback = F.get_json_object("properties_json", "$.path")
    page = F.when(
        F.col("event_name") == taxonomy.pageview,
        sf.nonblank(F.coalesce(sf.present(F.col("page_path")), fallback)),
    )
    pairs = (
        events.withColumn("page", page)
        .groupBy("session_key", "page")
        .agg(
            F.min(schema.event_order()).alias("first_seen"),
            F.max(F.when(is_in(taxonomy.form_submit), 1).otherwise(0)).alias("converted"),
        )
    )
    rank = F.row_number().over(
        W.Window.partitionBy("session_key").orderBy(F.col("page").isNotNull(), "first_seen", "page")
    )
    step = F.when(F.col("page").isNotNull(), F.struct("first_seen", "page"))
    per_session = (
        pairs.withColumn("_rn", rank)
        .where(F.col("_rn") <= hops + 1)
        .groupBy("session_key")
        .agg(
            F.slice(F.sort_array(F.collect_list(step)), 1, hops).alias("steps"),
            F.max("converted").alias("converted"),
            F.min("first_seen.received_at").alias("started"),
        )
        .where(F.size("steps") > 0)
    )
    path = F.array_join(F.transform("steps", lambda s: s["page"]), " → ")
    return (
        per_session.groupBy(path.alias("path"))
        .agg(
            F.count("*").alias("sessions"),
            F.sum("converted").alias("converted"),
            F.min("started").alias("_first"),
        )
        .orderBy(F.desc("sessions"), F.desc("converted"), "_first", "path")
        .limit(k)
        .select("path", "sessions", "converted", sf.pct(F.col("converted"), F.col("sessions")).alias("conversion_rate_pct"))
    )


# Time to convert


def convert_durations(frame: DataFrame) -> DataFrame:
    """Microseconds from the first page view (else first event) to the first submit."""
    started = F.coalesce("first_pageview_at", "first_activity_at")
    return frame.where("submitted_at IS NOT NULL").select(
        sessions.micros_between(started, F.col("submitted_at")).alias("micros")
    )


def time_to_convert(frame: DataFrame) -> DataFrame:
    """One row: converted sessions, exact median seconds, sessions per bucket."""
    durations = convert_durations(frame)
    median = quantiles.exact_median(durations, "micros")
    buckets = []
    for name, _, low, high in tx.CONVERT_BUCKETS:
        inside = F.col("micros") >= low * quantiles.MICROS
        if high is not None:
            inside &= F.col("micros") < high * quantiles.MICROS
        buckets.append(F.count_if(inside).alias(name))
    counts = durations.agg(F.count("*").alias("converted_sessions"), *buckets)
    return counts.withColumn("median_seconds", F.bround(median.scalar() / quantiles.MICROS, 1))


def convert_buckets(row: DataFrame) -> DataFrame:
    """The buckets of ``time_to_convert`` as rows."""
    entries = [
        F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.col(i).alias("sessions"))
        for i, label, _, _ in tx.CONVERT_BUCKETS
    ]
    return row.select(F.inline(F.array(*entries)))


# Visitors


def visitor_periods(events_by_period: DataFrame) -> DataFrame:
    """One row per anonymous visitor with flags for both periods."""
    known = events_by_period.where(sf.present(F.col("anonymous_id")).isNotNull())
    return known.groupBy("anonymous_id").agg(
        F.max(F.when(F.col("period") == periods.CURRENT, 1).otherwise(0)).alias("in_current"),
        F.max(F.when(F.col("period") == periods.PREVIOUS, 1).otherwise(0)).alias("in_previous"),
    )


def returning_visitors(events_by_period: DataFrame) -> DataFrame:
    """Visitors of both periods; one aggregation instead of two distincts and a join."""
    both = (F.col("in_current") == 1) & (F.col("in_previous") == 1)
    return visitor_periods(events_by_period).where(both).select("anonymous_id")


def new_visitors(events_by_period: DataFrame) -> DataFrame:
    """Visitors of the current period that the previous one has not seen."""
    fresh = (F.col("in_current") == 1) & (F.col("in_previous") == 0)
    return visitor_periods(events_by_period).where(fresh).select("anonymous_id")


def visitor_mix(events_by_period: DataFrame) -> DataFrame:
    """Returning, new and unknown visitors of the current period, one row.

    Visitors and the sessions of events without a visitor are counted in the same
    shuffle, told apart by ``known``.
    """
    visitor = sf.present(F.col("anonymous_id"))
    current = F.col("period") == periods.CURRENT
    keyed = events_by_period.where(visitor.isNotNull() | current).select(
        visitor.isNotNull().alias("known"),
        F.coalesce(visitor, F.col("session_key")).alias("key"),
        F.when(current, 1).otherwise(0).alias("cur"),
        F.when(current, 0).otherwise(1).alias("prev"),
    )
    flags = keyed.groupBy("known", "key").agg(F.max("cur").alias("cur"), F.max("prev").alias("prev"))
    counts = flags.agg(
        F.count_if(F.col("known") & (F.col("cur") == 1) & (F.col("prev") == 1)).alias("returning"),
        F.count_if(F.col("known") & (F.col("cur") == 1) & (F.col("prev") == 0)).alias("new_visitors"),
        F.count_if(~F.col("known")).alias("unknown"),
    )
    total = F.col("returning") + F.col("new_visitors") + F.col("unknown")
    base = F.greatest(F.col("total"), F.lit(1))
    return counts.withColumn("total", total).withColumns(
        {
            "returning_rate_pct": sf.pct(F.col("returning"), base),
            "new_visitor_rate_pct": sf.pct(F.col("new_visitors"), base),
        }
    )


def pageview_split(events: DataFrame, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    pageview = F.col("event_name") == taxonomy.pageview
    return events.agg(F.count_if(pageview).alias("pageviews"), F.count_if(~pageview).alias("custom_events"))
