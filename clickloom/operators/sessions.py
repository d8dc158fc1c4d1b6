"""Session frame: one row per session from one aggregation.

Every aggregate here has a partial form, so a session key holding a third of all
events reaches its reducer as one row per map task. Nothing collects a session's
events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import schema, taxonomy as tx
from clickloom.functions import scalars as sf

FILTER_MODES = ("all", "converted", "not_converted", "anonymous", "identified")


def is_in(names) -> Column:
    return F.col("event_name").isin(*names)


def browse_predicate(taxonomy: tx.Taxonomy = tx.DEFAULT) -> Column:
    """Browsing: a browse event, a link to the listing, or any event on its page."""
    href = F.get_json_object("properties_json", "$.href")
    link = (F.col("event_name") == taxonomy.browse_link_event) & F.startswith(href, F.lit(taxonomy.browse_path))
    on_page = F.col("page_path") == taxonomy.browse_path
    return is_in(taxonomy.marketplace_browse) | on_page | link


def with_event_classes(events: DataFrame, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Add one ``is_<class>`` column per event class."""
    return events.withColumns({f"is_{c}": is_in(getattr(taxonomy, c)) for c in taxonomy.CLASSES})


def _seen(condition: Column) -> Column:
    """1 when any row matches; a plain integer maximum, so it aggregates by hash."""
    return F.max(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def session_flags(events: DataFrame, *by: str, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """Per session: funnel flags, counts and first times. Fixed-width buffers only."""
    t = F.col("received_at")
    form = is_in(taxonomy.form_submit)
    pageview = F.col("event_name") == taxonomy.pageview
    return events.groupBy(*by, "session_key").agg(
        F.count("*").alias("event_count"),
        F.min(t).alias("first_activity_at"),
        F.max(t).alias("last_activity_at"),
        _seen(pageview).alias("has_pageview"),
        _seen(browse_predicate(taxonomy)).alias("has_marketplace_browse"),
        _seen(is_in(taxonomy.blueprint_detail)).alias("has_blueprint_detail"),
        _seen(is_in(taxonomy.doc_view)).alias("has_doc_read"),
        _seen(is_in(taxonomy.cta)).alias("has_cta_click"),
        _seen(form).alias("has_form_submit"),
        _seen(is_in(taxonomy.marketplace)).alias("has_marketplace"),
        F.min(F.when(form, t)).alias("submitted_at"),
        F.min(F.when(pageview, t)).alias("first_pageview_at"),
    )


def session_frame(events: DataFrame, *by: str, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """``session_flags`` plus who and what: visitor, display name, submit event.

    Emails are masked here, after the aggregation picked one per session.
    """
    t, order = F.col("received_at"), schema.event_order()
    form = is_in(taxonomy.form_submit)
    pageview = F.col("event_name") == taxonomy.pageview
    email = F.col("_email")
    user = sf.present(F.col("user_id"))
    shown = F.coalesce(user, email)
    path = sf.present(F.col("page_path"))
    visitor = sf.present(F.col("anonymous_id"))
    submit = F.struct(order.alias("at"), F.col("event_name").alias("name"), email.alias("email"), "user_id")
    display = F.struct(order.alias("at"), user.alias("user"), email.alias("email"))
    parsed = events.withColumn("_p", sf.property_struct(F.col("properties_json"), tx.EMAIL_KEYS))
    rows = parsed.withColumn("_email", sf.form_email(F.col("_p"), F.col("user_id")))
    frame = rows.groupBy(*by, "session_key").agg(
        F.count("*").alias("event_count"),
        F.min(t).alias("first_activity_at"),
        F.max(t).alias("last_activity_at"),
        _seen(pageview).alias("has_pageview"),
        _seen(browse_predicate(taxonomy)).alias("has_marketplace_browse"),
        _seen(is_in(taxonomy.blueprint_detail)).alias("has_blueprint_detail"),
        _seen(is_in(taxonomy.doc_view)).alias("has_doc_read"),
        _seen(is_in(taxonomy.cta)).alias("has_cta_click"),
        _seen(form).alias("has_form_submit"),
        _seen(is_in(taxonomy.marketplace)).alias("has_marketplace"),
        F.sum(F.when(form, 1).otherwise(0)).alias("form_submissions"),
        F.min(F.when(form, t)).alias("submitted_at"),
        F.min(F.when(pageview, t)).alias("first_pageview_at"),
        (F.min(path) != F.max(path)).alias("multi_page"),
        F.min(F.when(visitor.isNotNull(), F.struct(order.alias("at"), visitor.alias("id")))).alias("_visitor"),
        F.max(F.when(shown.isNotNull(), display)).alias("_display"),
        F.min(F.when(form, submit)).alias("_submit"),
    )
    seen_user, seen_email = F.col("_display.user"), F.col("_display.email")
    return frame.select(
        *[c for c in frame.columns if not c.startswith("_") and c != "multi_page"],
        F.coalesce("multi_page", F.lit(False)).alias("multi_page"),
        F.col("_visitor.id").alias("anonymous_id"),
        F.when(seen_user.isNull(), sf.mask_email(seen_email))
        .when(F.contains(seen_user, F.lit("@")), sf.mask_email(seen_user))
        .otherwise(seen_user)
        .alias("user_display"),
        F.col("_submit.name").alias("form_event"),
        sf.mask_email(F.col("_submit.email")).alias("email_masked"),
        F.col("_submit.user_id").alias("submit_user_id"),
    )


def session_pages(events: DataFrame) -> DataFrame:
    """Every distinct page of every session with its first view, one row each.

    The long form of a session's page list: it is never gathered in one place, so it
    holds for any number of pages per session.
    """
    paged = events.where(sf.present(F.col("page_path")).isNotNull())
    first = paged.groupBy("session_key", "page_path").agg(F.min(schema.event_order()).alias("first_seen"))
    return first.select("session_key", "page_path", F.col("first_seen.received_at").alias("first_seen_at"), "first_seen")


def inline_pages(pages: DataFrame) -> DataFrame:
    """Page count and ordered page list per session from ``session_pages``.

    The list has every distinct page, in the order of its first view. Callers that do
    not need it count the rows of ``session_pages`` instead.
    """
    listed = pages.groupBy("session_key").agg(
        F.count("*").alias("page_count"), F.sort_array(F.collect_list(F.struct("first_seen", "page_path"))).alias("_pages")
    )
    return listed.select("session_key", "page_count", F.col("_pages.page_path").alias("pages"))


def session_rows(events: DataFrame, frame: DataFrame | None = None, pages: bool = True) -> DataFrame:
    """One row per session with ids, display name, conversion and pages, unsorted.

    Without ``pages`` the rows have the page count alone, so no list is gathered.
    """
    frame = session_frame(events) if frame is None else frame
    seen = session_pages(events)
    listed = inline_pages(seen) if pages else seen.groupBy("session_key").agg(F.count("*").alias("page_count"))
    joined = frame.join(listed, "session_key", "left")
    return joined.select(
        F.col("session_key").alias("session_id"),
        sf.truncate_id(F.col("session_key")).alias("session_id_short"),
        "anonymous_id",
        sf.truncate_id(F.col("anonymous_id")).alias("anonymous_id_short"),
        "user_display",
        (F.col("has_form_submit") == 1).alias("converted"),
        "form_event",
        (F.col("has_marketplace") == 1).alias("marketplace_engaged"),
        *([F.coalesce("pages", F.array().cast("array<string>")).alias("pages")] if pages else []),
        F.coalesce("page_count", F.lit(0)).alias("page_count"),
        "event_count",
        "first_activity_at",
        "last_activity_at",
    )


def newest_sessions(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("last_activity_at"), "session_id").limit(n)


def newest_session_rows(events: DataFrame, n: int, frame: DataFrame | None = None) -> DataFrame:
    """The ``n`` newest session rows; pages are gathered for these sessions only."""
    frame = session_frame(events) if frame is None else frame
    newest = frame.orderBy(F.desc("last_activity_at"), "session_key").limit(n)
    theirs = events.join(newest.select("session_key"), "session_key", "left_semi")
    return newest_sessions(session_rows(theirs, newest), n)


def filter_sessions(rows: DataFrame, mode: str = "all") -> DataFrame:
    """Session rows of one filter mode."""
    if mode not in FILTER_MODES:
        raise ValueError(f"mode must be one of {FILTER_MODES}")
    return rows.where(_mode_predicate(mode))


def _mode_predicate(mode: str) -> Column:
    return {
        "all": F.lit(True),
        "converted": F.col("converted"),
        "not_converted": ~F.col("converted"),
        "anonymous": F.col("user_display").isNull(),
        "identified": F.col("user_display").isNotNull(),
    }[mode]


def filter_mode_counts(rows: DataFrame) -> DataFrame:
    """Sessions and events per filter mode, all modes in one pass."""
    modes = F.filter(
        F.array(*[F.when(_mode_predicate(m), F.lit(m)) for m in FILTER_MODES]), lambda m: m.isNotNull()
    )
    return (
        rows.withColumn("mode", F.explode(modes))
        .groupBy("mode")
        .agg(F.count("*").alias("sessions"), F.sum("event_count").alias("events"))
    )


def session_status(rows: DataFrame) -> DataFrame:
    """Add ``status``: Converted, Engaged or Browsing, in that priority."""
    status = F.when(F.col("converted"), "Converted").when(F.col("marketplace_engaged"), "Engaged")
    return rows.withColumn("status", status.otherwise("Browsing"))


def session_summary(frame: DataFrame) -> DataFrame:
    """Totals over the session frame, of which only two columns matter."""
    anonymous = F.count_if(F.col("user_display").isNull())
    return frame.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("has_form_submit") == 1).alias("converted"),
        F.count_if(F.col("has_form_submit") == 0).alias("not_converted"),
        anonymous.alias("anonymous_only"),
        (F.count("*") - anonymous).alias("identified"),
    )


def count_sessions(events: DataFrame, taxonomy: tx.Taxonomy = tx.DEFAULT) -> DataFrame:
    """The totals of ``session_summary`` from the events, by two flags per session."""
    parsed = events.withColumn("_p", sf.property_struct(F.col("properties_json"), tx.EMAIL_KEYS))
    named = F.coalesce(sf.present(F.col("user_id")), sf.form_email(F.col("_p"), F.col("user_id"))).isNotNull()
    flags = parsed.groupBy("session_key").agg(
        _seen(is_in(taxonomy.form_submit)).alias("has_form_submit"), _seen(named).alias("_named")
    )
    return session_summary(flags.withColumn("user_display", F.when(F.col("_named") == 1, F.col("session_key"))))


def recent_converters(events: DataFrame, n: int = 20, frame: DataFrame | None = None) -> DataFrame:
    """The ``n`` newest converted sessions, newest first.

    Pages are gathered for these sessions only: the events are filtered by the
    ``n`` session keys before any page is grouped.
    """
    ranked = (session_frame(events) if frame is None else frame).where("has_form_submit = 1")
    newest = ranked.orderBy(F.desc("submitted_at"), "session_key").limit(n)
    keys = newest.select("session_key")
    pages = inline_pages(session_pages(events.join(keys, "session_key", "left_semi")))
    started = F.coalesce("first_pageview_at", "first_activity_at")
    return (
        newest.join(pages, "session_key", "left")
        .select(
            F.col("session_key").alias("session_id"),
            F.col("form_event").alias("event_name"),
            "submitted_at",
            "email_masked",
            F.col("submit_user_id").alias("user_id"),
            F.coalesce("pages", F.array().cast("array<string>")).alias("pages"),
            "event_count",
            seconds_between(started, F.col("submitted_at")).alias("time_to_convert_seconds"),
        )
        .orderBy(F.desc("submitted_at"), "session_id")
    )


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from start to end, never negative."""
    return F.greatest(F.lit(0), F.unix_micros(end) - F.unix_micros(start))


def seconds_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(1000000.0)
