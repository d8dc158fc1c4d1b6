"""Registered queries: every operator over the whole test tables.

Windows are 30 days up to the end of the sample, which is the whole table; period
comparisons take 15 days against the 15 before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom import runtime
from clickloom.functions import scalars as sf
from clickloom.functions import sql as sql_functions
from clickloom.operators import (
    catalog, envelope, ingest_checks, insights, live, metrics, periods, sessionize, sessions,
)
from clickloom.plans import report
from clickloom.sources import documents, kafka, sample
from clickloom.sources import events as table_io
from clickloom.streaming import compaction, jobs, progress, state

AS_OF = sample.AS_OF
DAYS = 15
HALF, WHOLE = DAYS * periods.DAY, 2 * DAYS * periods.DAY
NOW_MS = 1706659200000
GAP_TIMEOUT = 6 * 3600
AGE_TIMEOUT = 24 * 3600
SUPER_PROPERTIES = {"label": "registered", "site": "web"}
METRIC = "clicks_events_total"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, so that both engines return the same type."""
    cast = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(cast) if cast else df


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(runtime.configure(spark), sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir):
    return sample.clickstream(spark, sf_dir)


def windowed(spark, sf_dir):
    return periods.events_in_window(events(spark, sf_dir), WHOLE, AS_OF)


def compared(spark, sf_dir):
    return periods.split_periods(events(spark, sf_dir), HALF, AS_OF)


def parsed(spark, sf_dir, bad_records="drop"):
    messages = sample.messages(spark, sf_dir)
    return envelope.parse_envelope(messages, bad_records, ingested_at=F.col("event_timestamp"))


# Envelope


@query
def canonical_events(spark, sf_dir):
    rows = envelope.with_component(events(spark, sf_dir))
    return rows.drop("kafka_timestamp", "ingested_at", "raw_payload")


@query
def parse_envelope(spark, sf_dir):
    return parsed(spark, sf_dir, "quarantine").drop("ingested_at")


@query
def parse_envelope_lenient(spark, sf_dir):
    rows = envelope.parse_envelope_lenient(sample.messages(spark, sf_dir), F.col("event_timestamp"))
    return rows.drop("kafka_timestamp")


@query
def parse_envelope_strict(spark, sf_dir):
    """Messages that pass the rules do not stop a strict parse."""
    checked = envelope.validate_envelope(sample.messages(spark, sf_dir))
    sound = checked.where(~F.array_contains("failed_rules", "not_an_object")).drop("failed_rules")
    return envelope.parse_envelope_strict(sound, F.col("event_timestamp")).drop("ingested_at")


@query
def quarantined_messages(spark, sf_dir):
    return envelope.quarantined(parsed(spark, sf_dir, "quarantine"))[1].drop("ingested_at")


@query
def validate_envelope(spark, sf_dir):
    rows = envelope.validate_envelope(sample.messages(spark, sf_dir))
    return rows.select("partition", "offset", F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def normalize_envelope(spark, sf_dir):
    rows = envelope.normalize_envelope(parsed(spark, sf_dir), "web", F.lit(NOW_MS))
    return rows.select("kafka_partition", "kafka_offset", "event_id", "event_timestamp", "source", "session_id")


@query
def dedupe_events(spark, sf_dir):
    rows = envelope.dedupe_events(envelope.to_canonical(parsed(spark, sf_dir)))
    return rows.select("event_id", "event_name", "kafka_partition", "kafka_offset", "received_at", "session_key")


@query
def load_metrics(spark, sf_dir):
    rows = envelope.to_canonical(parsed(spark, sf_dir))
    return envelope.load_metrics(rows, 2 * DAYS)


@query
def super_properties(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("properties", sf.parse_properties(F.col("properties_json")))
    built = envelope.build_events(rows, SUPER_PROPERTIES)
    return built.select("event_id", _pairs("properties").alias("properties"))


@query
def identify_events(spark, sf_dir):
    users = events(spark, sf_dir).withColumn("traits", sf.parse_properties(F.col("properties_json")))
    built = envelope.identify_events(users)
    return built.select("event_id", "event_name", _pairs("properties").alias("properties"))


def _pairs(column):
    ordered = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(ordered, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


@query
def publish_messages(spark, sf_dir):
    """The value written to the log, read back as fields."""
    shown = events(spark, sf_dir).select("event_id", "event_name", "user_id", "session_id", "page_path")
    value = F.col("value")
    return kafka.to_messages(shown).select(
        *[F.get_json_object(value, f"$.{c}").alias(c) for c in shown.columns],
        F.size(F.json_object_keys(value)).alias("fields"),
    )


# Sessions and insights


@query
def event_classes(spark, sf_dir):
    rows = sessions.with_event_classes(events(spark, sf_dir))
    return rows.select("event_id", *[c for c in rows.columns if c.startswith("is_")])


@query
def funnel(spark, sf_dir):
    return insights.funnel(sessions.session_flags(windowed(spark, sf_dir)))


@query
def kpis(spark, sf_dir):
    return insights.kpis(windowed(spark, sf_dir))


@query
def kpi_comparison(spark, sf_dir):
    return insights.kpi_comparison(insights.kpis(compared(spark, sf_dir), "period"))


@query
def kpi_comparison_half(spark, sf_dir):
    both = periods.split_periods(events(spark, sf_dir), WHOLE, AS_OF, "half_compat")
    return insights.kpi_comparison(insights.kpis(both, "period"))


@query
def compare_periods(spark, sf_dir):
    by_period = insights.kpis(compared(spark, sf_dir), "period")
    return periods.compare_periods(by_period, ["sessions", "actors", "form_submissions"])


@query
def activity_trends_daily(spark, sf_dir):
    return insights.activity_trends(windowed(spark, sf_dir), hourly=False)


@query
def activity_trends_hourly(spark, sf_dir):
    return insights.activity_trends(windowed(spark, sf_dir), hourly=True)


@query
def activity_heatmap(spark, sf_dir):
    return insights.activity_heatmap(windowed(spark, sf_dir))


@query
def top_pages(spark, sf_dir):
    return insights.top_pages(windowed(spark, sf_dir))


@query
def top_events(spark, sf_dir):
    return insights.top_events(windowed(spark, sf_dir))


@query
def cta_leaderboard(spark, sf_dir):
    return insights.cta_leaderboard(windowed(spark, sf_dir))


@query
def faq_leaderboard(spark, sf_dir):
    return insights.faq_leaderboard(windowed(spark, sf_dir))


@query
def engine_leaderboard(spark, sf_dir):
    return insights.engine_leaderboard(windowed(spark, sf_dir))


@query
def blueprint_leaderboard(spark, sf_dir):
    return insights.blueprint_leaderboard(windowed(spark, sf_dir))


@query
def blueprint_treemap(spark, sf_dir):
    return insights.blueprint_treemap(windowed(spark, sf_dir))


@query
def top_paths(spark, sf_dir):
    return insights.top_paths(windowed(spark, sf_dir))


@query
def time_to_convert(spark, sf_dir):
    return insights.time_to_convert(sessions.session_flags(windowed(spark, sf_dir)))


@query
def time_to_convert_buckets(spark, sf_dir):
    return insights.convert_buckets(insights.time_to_convert(sessions.session_flags(windowed(spark, sf_dir))))


@query
def visitor_mix(spark, sf_dir):
    return insights.visitor_mix(compared(spark, sf_dir))


@query
def returning_visitors(spark, sf_dir):
    return insights.returning_visitors(compared(spark, sf_dir))


@query
def new_visitors(spark, sf_dir):
    return insights.new_visitors(compared(spark, sf_dir))


@query
def session_rows(spark, sf_dir):
    rows = sessions.session_rows(windowed(spark, sf_dir))
    return rows.withColumn("pages", F.array_join("pages", " | "))


@query
def session_pages(spark, sf_dir):
    return sessions.session_pages(windowed(spark, sf_dir)).drop("first_seen")


@query
def newest_sessions(spark, sf_dir):
    return sessions.newest_session_rows(windowed(spark, sf_dir), 50).withColumn("pages", F.array_join("pages", " | "))


@query
def session_filter_modes(spark, sf_dir):
    return sessions.filter_mode_counts(sessions.session_rows(windowed(spark, sf_dir), pages=False))


@query
def session_status(spark, sf_dir):
    rows = sessions.session_status(sessions.session_rows(windowed(spark, sf_dir), pages=False))
    return rows.select("session_id", "status")


@query
def session_summary(spark, sf_dir):
    return sessions.count_sessions(windowed(spark, sf_dir))


@query
def recent_converters(spark, sf_dir):
    rows = sessions.recent_converters(windowed(spark, sf_dir))
    return rows.withColumn("pages", F.array_join("pages", " | "))


@query
def insights_report(spark, sf_dir):
    return report.flat_report(report.build(events(spark, sf_dir), AS_OF, DAYS))


def panel(spark, sf_dir, name, seconds=WHOLE, comparison="prior"):
    return report.build(events(spark, sf_dir), AS_OF, window_seconds=seconds, comparison=comparison)[name]


@query
def report_heatmap(spark, sf_dir):
    return panel(spark, sf_dir, "activity_heatmap")


@query
def report_treemap(spark, sf_dir):
    return panel(spark, sf_dir, "blueprint_treemap")


@query
def report_converters(spark, sf_dir):
    return panel(spark, sf_dir, "recent_converters").withColumn("pages", F.array_join("pages", " | "))


@query
def report_sessions(spark, sf_dir):
    return panel(spark, sf_dir, "all_sessions").withColumn("pages", F.array_join("pages", " | "))


@query
def report_halves(spark, sf_dir):
    """The second half of the window against its first half."""
    return panel(spark, sf_dir, "kpi_comparison", comparison="half")


@query
def report_hourly(spark, sf_dir):
    """Trends of a window of less than a day, by the hour."""
    return panel(spark, sf_dir, "activity_trends", 20 * 3600)


@query
def sessionize_gap(spark, sf_dir):
    rows = sessionize.sessionize(by_user(sample.read_events(spark, sf_dir)), "user_id", GAP_TIMEOUT, "gap")
    return sessionize.session_spans(rows, "user_id")


@query
def sessionize_fixed(spark, sf_dir):
    rows = sessionize.sessionize(by_user(sample.read_events(spark, sf_dir)), "user_id", AGE_TIMEOUT, "fixed")
    return sessionize.session_spans(rows, "user_id")


def by_user(rows):
    return rows.select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("received_at"))


# Live


@query
def live_stats(spark, sf_dir):
    return live.live_stats(events(spark, sf_dir), WHOLE, AS_OF)


@query
def live_stats_quiet(spark, sf_dir):
    """A window after the last event."""
    return live.live_stats(events(spark, sf_dir), 60, "2030-01-01 00:00:00")


@query
def event_page_wide(spark, sf_dir):
    return live.page_events(events(spark, sf_dir), limit=450).select("event_id", "event_name")


def deep_offset(rows):
    """Nine tenths of all rows."""
    return rows.count() * 9 // 10


@query
def event_page_deep(spark, sf_dir):
    """A page far from the top: only its range of arrival times is sorted."""
    rows = events(spark, sf_dir)
    return live.page_events(rows, limit=40, offset=deep_offset(rows)).select("event_id", "event_name", "received_at")


@query
def event_page_after(spark, sf_dir):
    """The same page from the row before it."""
    rows = events(spark, sf_dir)
    last = live.page_events(rows, limit=1, offset=deep_offset(rows) - 1).first()
    return live.page_after(rows, last, limit=40).select("event_id", "event_name", "received_at")


@query
def distinct_names(spark, sf_dir):
    return live.distinct_names(events(spark, sf_dir))


@query
def live_projection(spark, sf_dir):
    return live.live_projection(events(spark, sf_dir))


@query
def legacy_projection(spark, sf_dir):
    return live.legacy_projection(events(spark, sf_dir).withColumn("raw_payload", F.col("properties_json")))


@query
def event_page(spark, sf_dir):
    matched = live.filter_events(events(spark, sf_dir), name="$pageview")
    return live.live_projection(live.page_events(matched, limit=50, offset=100))


@query
def event_page_meta(spark, sf_dir):
    matched = live.filter_events(events(spark, sf_dir), name="$pageview")
    return live.page_meta(matched, live.page_events(matched, 50, 100), 50, 100)


@query
def filter_by_user(spark, sf_dir):
    rows = live.filter_events(events(spark, sf_dir), user_id="user12@example.com")
    return rows.select("event_id", "event_name", "user_id")


@query
def new_since(spark, sf_dir):
    """The newest page against the page shown 50 events earlier."""
    rows = events(spark, sf_dir)
    page, shown = live.page_events(rows, 100), live.page_events(rows, 50, 50)
    last_seen = shown.agg(F.max("received_at")).scalar()
    return live.new_since(page, last_seen, shown).select("event_id", "is_new")


@query
def live_snapshot(spark, sf_dir):
    """The page of a snapshot of one event name with its page numbers."""
    shot = live.live_snapshot(events(spark, sf_dir), AS_OF, name="faq_opened", limit=20, offset=10, seconds=WHOLE)
    meta = shot["meta"]
    return shot["events"].select(
        "event_id", "event_name", "component", "received_at",
        meta.select("returned").scalar().alias("returned"), meta.select("total_matched").scalar().alias("total_matched"),
        shot["stats"].where("scope = 'all'").select("events").scalar().alias("events_in_window"),
    )


@query
def pageview_split(spark, sf_dir):
    return insights.pageview_split(events(spark, sf_dir))


@query
def rates(spark, sf_dir):
    return live.window_rates(events(spark, sf_dir), "5 minutes", "1 minute")


@query
def rates_by_type(spark, sf_dir):
    return live.window_rates(events(spark, sf_dir), "1 hour", "15 minutes", "event_name")


# Metrics


@query
def event_counters(spark, sf_dir):
    return metrics.event_counters(events(spark, sf_dir))


@query
def publish_outcomes(spark, sf_dir):
    return metrics.publish_outcomes(sample.publish_attempts(spark, sf_dir))


@query
def latency_histogram(spark, sf_dir):
    rows = metrics.latency_histogram(sample.publish_attempts(spark, sf_dir))
    return rows.withColumn("le", F.col("le").cast("string")).withColumn("sum", F.round("sum", 4))


@query
def histogram_quantile(spark, sf_dir):
    histogram = metrics.latency_histogram(sample.publish_attempts(spark, sf_dir))
    return metrics.histogram_quantile(histogram, 0.95).withColumn("value", F.round("value", 5))


@query
def histogram_quantile_by_status(spark, sf_dir):
    attempts = sample.publish_attempts(spark, sf_dir)
    histogram = metrics.latency_histogram(attempts, "duration_s", metrics.tx.PUBLISH_LATENCY_BOUNDS, "status")
    return metrics.histogram_quantile(histogram, 0.5, "status").withColumn("value", F.round("value", 5))


@query
def latency_sketch(spark, sf_dir):
    """The 95th percentile from sketches per day, merged per status, inside its error bound."""
    attempts = sample.publish_attempts(spark, sf_dir).withColumn("day", F.to_date("received_at"))
    merged = metrics.sketch_quantile(metrics.value_sketches(attempts, "duration_s", "day", "status"), 0.95, "status")
    checked = metrics.quantile_check(attempts, "duration_s", merged, "status")
    return checked.join(merged.select("status", F.col("n").alias("sketched")), "status").select("status", "q", "n", "sketched", "within")


@query
def events_by_type(spark, sf_dir):
    return metrics.events_by_type(events(spark, sf_dir), HALF, AS_OF).withColumn("per_second", F.round("per_second", 8))


@query
def top_components(spark, sf_dir):
    return metrics.top_components(events(spark, sf_dir))


@query
def component_rate(spark, sf_dir):
    return metrics.component_rate(events(spark, sf_dir), WHOLE, AS_OF).withColumn("per_second", F.round("per_second", 8))


@query
def error_rate(spark, sf_dir):
    rows = metrics.error_rate(sample.publish_attempts(spark, sf_dir), WHOLE, AS_OF)
    return rows.withColumns({c: F.round(c, 8) for c in rows.columns})


@query
def throughput(spark, sf_dir):
    return metrics.throughput(events(spark, sf_dir), WHOLE, AS_OF).withColumn("per_second", F.round("per_second", 8))


def exposition_lines(spark, sf_dir):
    """Counter lines of a producer (all events) and a consumer (two log partitions)."""
    rows = envelope.with_component(events(spark, sf_dir))
    read = rows.where("kafka_partition < 2")
    name, component = F.col("event_name"), F.col("component")
    total = F.col("total").cast("string")
    producer = F.concat(F.lit(METRIC + '{event_name="'), name, F.lit('",component="'), component, F.lit('"} '), total)
    consumer = F.concat(F.lit(METRIC + '{component="'), component, F.lit('",event_name="'), name, F.lit('"} '), total)
    sources = [(metrics.event_counters(rows), producer, 0), (metrics.event_counters(read), consumer, 1)]
    lines = [c.select(line.alias("value"), F.lit(rank).alias("source_rank"), F.lit(0).alias("line_no")) for c, line, rank in sources]
    return lines[0].unionByName(lines[1])


@query
def metric_samples(spark, sf_dir):
    rows = documents.parse_samples(exposition_lines(spark, sf_dir), prefix="clicks_")
    return rows.select(
        "source_rank", "metric", "value", rows.labels["event_name"].alias("event_name"), rows.labels["component"].alias("component")
    )


@query
def latest_samples(spark, sf_dir):
    rows = documents.parse_samples(exposition_lines(spark, sf_dir), prefix="clicks_")
    return metrics.latest_samples(rows).drop("labels")


# Catalog


@query
def rule_classify(spark, sf_dir):
    rules = (("ring", "Fasteners"), ("bolt", "Fasteners"), ("gear", "Drive"), ("widget", "Parts"))
    icons = (("red", "RD"), ("blue", "BL"), ("ring", "RG"))
    items = catalog.classify_items(table(spark, sf_dir, "part"), "p_name", rules, icons)
    return items.select("p_partkey", "p_name", "category", "icon")


@query
def lookup_dimension(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = catalog.lookup_dimension(
        nation, region, F.col("n_regionkey"), "r_regionkey", {"r_name": F.lit("")}
    )
    # a supplier in debt has no key and keeps the defaults of a missing dimension
    key = F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey"))
    found = catalog.lookup_dimension(
        table(spark, sf_dir, "supplier"), named, key, "n_nationkey", {"n_name": F.col("s_name"), "r_name": F.lit("unknown")}
    )
    return found.select("s_suppkey", "n_name", "r_name")


@query
def lookup_item(spark, sf_dir):
    items = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    order = [F.desc("p_size"), F.col("p_partkey")]
    found = catalog.lookup_item(items, " small ring ", ["id", "p_name"], order)
    return found.select("p_partkey", "p_name", "p_size")


@query
def preferred_topk(spark, sf_dir):
    picked = catalog.preferred_topk(table(spark, sf_dir, "part"), F.col("p_size") <= 3, "p_name", "p_partkey", 20)
    return picked.select("p_partkey", "p_name", "popular")


@query
def first_by_title(spark, sf_dir):
    return catalog.first_by_title(table(spark, sf_dir, "part"), "p_name", "p_partkey", 3).select("p_partkey", "p_name")


@query
def prefix_key(spark, sf_dir):
    rules = (("Brand#1", "group-one"), ("Brand#2", "group-two"))
    return table(spark, sf_dir, "part").select("p_partkey", sf.prefix_key(F.col("p_brand"), rules).alias("key"))


# State of the table


@query
def event_table_scan(spark, sf_dir):
    """Create the partitioned table, append by column name, scan it back by date."""
    name = f"events_{uuid.uuid4().hex[:12]}"
    table_io.create_event_table(spark, name, location=runtime.run_dir(spark, "table"))
    table_io.append_rows(sample.clickstream_rows(sample.read_events(spark, sf_dir)), name)
    return table_io.scan_events(spark, name, 2 * DAYS, AS_OF)


@query
def load_history(spark, sf_dir):
    """Parsed messages with their replays through the table, deduplicated on reading."""
    name = f"events_{uuid.uuid4().hex[:12]}"
    table_io.create_event_table(spark, name, location=runtime.run_dir(spark, "table"))
    table_io.append_rows(parsed(spark, sf_dir), name)
    rows = table_io.load_events(spark, f"history:{name}", 2 * DAYS, AS_OF)
    return rows.select("event_id", "event_name", "kafka_partition", "kafka_offset", "received_at", "session_key")


@query
def load_live(spark, sf_dir):
    """A live snapshot with its replays, deduplicated on reading."""
    path = runtime.passing_dir(spark, "live")
    envelope.to_canonical(parsed(spark, sf_dir)).write.parquet(path)
    rows = table_io.load_events(spark, f"live:{path}", as_of=AS_OF, seconds=WHOLE)
    return rows.select("event_id", "event_name", "kafka_partition", "kafka_offset", "received_at", "session_key")


@query
def verify_table(spark, sf_dir):
    rows = ingest_checks.verify_table(events(spark, sf_dir), 10)
    return rows.select("event_id", "event_name", "ingested_at", "row_count")


@query
def ingest_status(spark, sf_dir):
    return ingest_checks.ingest_status(events(spark, sf_dir))


@query
def ingest_status_empty(spark, sf_dir):
    return ingest_checks.ingest_status(events(spark, sf_dir).where("event_name = 'no such event'"))


@query
def ingest_lag(spark, sf_dir):
    ends = sample.messages(spark, sf_dir).groupBy(F.col("partition").alias("kafka_partition")).agg(
        (F.max("offset") + 1).alias("end_offset")
    )
    return ingest_checks.ingest_lag(ends, ingest_checks.next_offsets(events(spark, sf_dir)))


@query
def footer_stats(spark, sf_dir):
    """Rows and ends of the ids from the file footers."""
    return ingest_checks.footer_stats(spark, f"{sf_dir}/events.parquet", ["event_id", "user_id"])


@query
def reconcile_ingest(spark, sf_dir):
    return ingest_checks.reconcile_ingest(events(spark, sf_dir), "2024-01-24 00:00:00")


@query
def offset_gaps(spark, sf_dir):
    return ingest_checks.offset_gaps(parsed(spark, sf_dir))


# Scalar rules over whole columns


@query
def mask_email(spark, sf_dir):
    rows = events(spark, sf_dir)
    email = sf.form_email(sf.property_struct(F.col("properties_json"), metrics.tx.EMAIL_KEYS), F.col("user_id"))
    return rows.select("event_id", sf.mask_email(email).alias("email_masked"), sf.mask_email(F.col("user_id")).alias("user_masked"))


@query
def event_component(spark, sf_dir):
    """Through the SQL functions, as a user of ``spark.sql`` calls them."""
    sql_functions.register(spark)
    rows = events(spark, sf_dir)
    return rows.select("event_id", F.expr("event_component(event_name, properties_json)").alias("component"))


@query
def event_component_column(spark, sf_dir):
    """The same rule as a column."""
    return envelope.with_component(events(spark, sf_dir)).select("event_id", "component")


@query
def sql_functions_on_text(spark, sf_dir):
    """The SQL functions on texts of any script, with white space of several kinds around them."""
    sql_functions.register(spark)
    rows = table(spark, sf_dir, "documents").withColumn("wide", F.concat(F.lit("\t\u00a0"), "text", F.lit("\u2003\n")))
    return rows.select(
        "doc_id", F.expr("sanitize_label(wide)").alias("label"), F.expr("mask_email(wide)").alias("masked"),
        F.expr("session_key(lang, source, cast(doc_id as string))").alias("key"),
        F.expr("pct(cast(n_chars as double), 1000D)").alias("share"),
    )


@query
def sanitize_label(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", sf.sanitize_label(F.col("text")).alias("label"))


@query
def truncate_id(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("event_id", sf.truncate_id(F.col("session_key"), 9).alias("short"))


@query
def utm(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("utm", sf.parse_utm(F.col("url")))
    return rows.select("page_id", *[F.col("utm")[k].alias(f"utm_{k}") for k in sf.UTM_KEYS])


@query
def parse_time(spark, sf_dir):
    """Arrival times written in five ways, read back."""
    rows = events(spark, sf_dir)
    t, form = F.col("received_at"), F.col("kafka_offset") % 5
    text = (
        F.when(form == 0, F.unix_millis(t).cast("string"))
        .when(form == 1, F.unix_seconds(t).cast("string"))
        .when(form == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(form == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.lit("not a time"))
    )
    return rows.select("event_id", sf.parse_time(text).alias("parsed_at"))


@query
def context_fields(spark, sf_dir):
    """Context of the wire message, with a context built from page URLs."""
    url = F.col("url")
    context = F.struct(
        F.lit("test").alias("browser"), F.lit("en").alias("locale"), url.alias("referrer"),
        F.try_parse_url(url, F.lit("PATH")).alias("pathname"), sf.parse_utm(url).alias("utm"),
    )
    rows = table(spark, sf_dir, "pages").withColumn("raw", F.to_json(F.struct(context.alias("context"))))
    fields = ("browser", "locale", "referrer", "pathname", "utm.source")
    return rows.select("page_id", *[sf.context_field(F.col("raw"), f).alias(f.replace(".", "_")) for f in fields])


# Streams, drained over what is there


def event_stream(spark, sf_dir, **options):
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    if runtime.is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


#: Files of a part of the sample, and where its parts end.
PART_FILES = 4
PART_ENDS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00", None)
FLUSH = "2034-01-01 00:00:00"


def parts_stream(spark, sf_dir):
    """The events in parts of rising time, one per micro-batch, and a row that moves the
    watermark past all of them."""
    rows, folder = spark.read.parquet(f"{sf_dir}/events.parquet"), runtime.passing_dir(spark, "parts")
    begin, kind = F.lit(None).cast("timestamp"), rows.schema["ts"].dataType
    for end in PART_ENDS:
        at, stop = F.col("ts").cast("timestamp"), F.lit(end).cast("timestamp")
        inside = F.coalesce(at >= begin, F.lit(True)) & F.coalesce(at < stop, F.lit(True))
        rows.where(inside).repartition(PART_FILES).write.mode("append").parquet(folder)
        begin = stop
    flush = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema} | {"ts": F.lit(FLUSH).cast("timestamp").cast(kind)}
    spark.range(1).select(*[c.alias(n) for n, c in flush.items()]).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", PART_FILES).parquet(folder)


def canonical(stream):
    return envelope.to_canonical(sample.clickstream_rows(stream).drop("event_type", "value", "k"))


def canonical_stream(spark, sf_dir):
    return canonical(event_stream(spark, sf_dir))


def drained(spark, stream, mode):
    folder = runtime.run_dir(spark, "stream")
    jobs.drain_to_files(stream, f"{folder}/out", f"{folder}/checkpoint", mode)
    return folder + "/out"


@query
def stream_ingest(spark, sf_dir):
    folder = runtime.run_dir(spark, "ingest")
    messages = sample.raw_messages(event_stream(spark, sf_dir))
    rows = envelope.parse_envelope(messages, "drop", ingested_at=F.col("event_timestamp"))
    jobs.run_available(rows, jobs.append_batch(f"{folder}/table"), f"{folder}/checkpoint")
    rows = spark.read.parquet(f"{folder}/table").drop("batch_id", "ingest_date")
    kept = envelope.dedupe_events(envelope.to_canonical(rows))
    return kept.select("event_id", "event_name", "kafka_partition", "kafka_offset", "received_at", "session_key")


@query
def stream_dedupe(spark, sf_dir):
    rows = envelope.parse_envelope(sample.raw_messages(event_stream(spark, sf_dir)), "drop", F.col("event_timestamp"))
    kept = jobs.stream_dedupe(envelope.to_canonical(rows))
    out = spark.read.parquet(drained(spark, kept.select("event_id", "kafka_partition", "kafka_offset"), "append"))
    lonely = F.col("event_id").isNull()
    return out.select("event_id", *[F.when(lonely, F.col(c)).alias(c) for c in ("kafka_partition", "kafka_offset")])


@query
def stream_counters(spark, sf_dir):
    counters = metrics.event_counters(canonical_stream(spark, sf_dir))
    return jobs.last_batch(spark, drained(spark, counters, "complete"))


@query
def stream_windows(spark, sf_dir):
    """Windows leave the state, and are written, when the watermark has passed them."""
    stream = canonical(parts_stream(spark, sf_dir)).withWatermark("received_at", "1 minute")
    return spark.read.parquet(drained(spark, live.window_rates(stream, "1 hour", "15 minutes", closed=True), "append"))


@query
def stream_client_clock(spark, sf_dir):
    stream = canonical(parts_stream(spark, sf_dir)).withColumn("event_time", F.col("received_at"))
    return spark.read.parquet(drained(spark, jobs.client_clock_rates(stream, "1 hour", "15 minutes", closed=True), "append"))


@query
def stream_snapshot(spark, sf_dir):
    """The newest page of the live buffer with the status of the stream that filled it."""
    folder = runtime.run_dir(spark, "snapshot")
    finished = jobs.run_available(canonical_stream(spark, sf_dir), jobs.keep_latest(folder), f"{folder}/checkpoint")
    buffer = jobs.live_buffer(spark, folder)
    status = jobs.pipeline_status(spark, finished, buffer)
    shot = live.live_snapshot(buffer.drop("total_received"), AS_OF, limit=20, seconds=WHOLE, status=status)
    return shot["events"].select(
        "event_id", "event_name", *[shot["status"].select(c).scalar().alias(c) for c in ("status", "total_received", "buffer_used")],
        shot["meta"].select("total_matched").scalar().alias("total_matched"),
    )


@query
def stream_latest_n(spark, sf_dir):
    folder = runtime.run_dir(spark, "live")
    jobs.run_available(canonical_stream(spark, sf_dir), jobs.keep_latest(folder), f"{folder}/checkpoint")
    buffer = jobs.live_buffer(spark, folder)
    return buffer.select("event_id", "event_name", "received_at", "total_received")


@query
def stream_sessions_gap(spark, sf_dir):
    rows = jobs.stream_sessions_gap(by_user(parts_stream(spark, sf_dir)), f"{GAP_TIMEOUT} seconds", key="user_id")
    return spark.read.parquet(drained(spark, rows, "append"))


@query
def stream_sessions_fixed(spark, sf_dir):
    """Drained in batches of any size."""
    folder = runtime.run_dir(spark, "sessions")
    writer = jobs.keep_sessions(folder, AGE_TIMEOUT, "user_id")
    jobs.run_available(by_user(parts_stream(spark, sf_dir)), writer, f"{folder}/checkpoint")
    return jobs.kept_sessions(spark, folder, "user_id")


@query
def stream_sessions_state(spark, sf_dir):
    """The stateful operator, whose batches are bounded by the source."""
    rows = jobs.stream_sessions_fixed(by_user(parts_stream(spark, sf_dir)), AGE_TIMEOUT, key="user_id")
    updates = spark.read.parquet(drained(spark, rows, "update"))
    return jobs.latest_sessions(updates, "user_id")


@query
def pipeline_status(spark, sf_dir):
    folder = runtime.run_dir(spark, "status")
    finished = jobs.run_available(canonical_stream(spark, sf_dir), jobs.keep_latest(folder), f"{folder}/checkpoint")
    status = jobs.pipeline_status(spark, finished, jobs.live_buffer(spark, folder))
    return status.select("stream_active", "status", "last_error", "total_received", "buffer_size", "buffer_used")


# Recorded progress, late rows, compaction


def ranges_stream(spark, sf_dir, *ranges):
    """The events as one micro-batch for each list of ranges of their time."""
    rows, folder = spark.read.parquet(f"{sf_dir}/events.parquet"), runtime.passing_dir(spark, "ranges")
    for spans in ranges:
        inside = F.lit(False)
        for begin, end in spans:
            inside = inside | ((F.col("ts") >= F.lit(begin).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        rows.where(inside).repartition(PART_FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", PART_FILES).parquet(folder)


#: Three batches in the order of time, and three whose last brings the oldest events.
ORDERED = ([("2000-01-01", "2024-01-11")], [("2024-01-11", "2024-01-21")], [("2024-01-21", "2030-01-01")])
MIXED = ([("2024-01-11", "2024-01-18")], [("2024-01-18", "2024-01-21")], [("2000-01-01", "2024-01-11"), ("2024-01-21", "2030-01-01")])
LATE_DELAY = 2 * periods.DAY


@query
def stream_lag(spark, sf_dir):
    """Rows left after two of three batches, from the recorded progress of a stream of files."""
    folder = runtime.run_dir(spark, "lag")
    rows = canonical(ranges_stream(spark, sf_dir, *ORDERED))
    with progress.recording(spark, f"{folder}/progress"):
        jobs.run_available(rows, jobs.append_batch(f"{folder}/table"), f"{folder}/checkpoint", max_batches=2)
    ends = events(spark, sf_dir).agg(F.lit(0).alias("kafka_partition"), F.count("*").alias("end_offset"))
    lag = progress.stream_lag(progress.recorded(spark, f"{folder}/progress"), ends)
    return lag.select("kafka_partition", "end_offset", "next_offset", "lag")


def log_report(positions, topic, batch):
    """Positions per partition as a progress report of a log source has them."""
    offsets = [
        F.map_from_entries(F.collect_list(F.struct(F.col("kafka_partition").cast("string"), F.col(c)))).alias(c)
        for c in ("next_offset", "end_offset")
    ]
    source = F.struct(
        F.lit("log").alias("description"), F.create_map(F.lit(topic), F.col("next_offset")).alias("endOffset"),
        F.create_map(F.lit(topic), F.col("end_offset")).alias("latestOffset"), F.lit(1).alias("numInputRows"),
    )
    report = F.struct(F.lit("q").alias("id"), F.lit(batch).alias("batchId"), F.array(source).alias("sources"))
    return positions.agg(*offsets).select(F.to_json(report).alias("json"))


@query
def stream_lag_by_partition(spark, sf_dir):
    """Lag of a log by partition, parsed from reports of two batches."""
    rows = events(spark, sf_dir)
    ends = sample.messages(spark, sf_dir).groupBy(F.col("partition").alias("kafka_partition")).agg((F.max("offset") + 1).alias("end_offset"))
    halves = [log_report(ends.join(ingest_checks.next_offsets(part), "kafka_partition"), "clicks", batch)
              for batch, part in enumerate([rows.where("kafka_offset < 100"), rows])]
    reports = halves[0].unionByName(halves[1]).select(F.from_json("json", progress.REPORT).alias("r")).select("r.*")
    return progress.stream_lag(reports).select("topic", "kafka_partition", "end_offset", "next_offset", "lag")


@query
def stream_late_rows(spark, sf_dir):
    """Every event is kept or counted as late: by the writer that keeps late ones apart, and by a stateful operator."""
    folder = runtime.run_dir(spark, "late")
    stream = canonical(ranges_stream(spark, sf_dir, *MIXED)).select("event_id", "received_at")
    writer = jobs.split_late(folder, LATE_DELAY, "received_at")
    jobs.run_available(stream, writer, f"{folder}/checkpoint")
    split = jobs.split_rows(spark, folder)
    deduped = stream.withWatermark("received_at", f"{LATE_DELAY} seconds").dropDuplicatesWithinWatermark(["event_id"])
    with progress.recording(spark, f"{folder}/progress"):
        out = spark.read.parquet(drained(spark, deduped, "append"))
    dropped = progress.late_rows(progress.recorded(spark, f"{folder}/progress")).where("name LIKE 'dedupe%'")
    counts = split.groupBy("batch_id").agg(F.count_if(~F.col("is_late")).alias("kept"), F.count_if("is_late").alias("late"))
    totals = [d.scalar() for d in (out.agg(F.count("*")), dropped.agg(F.sum("late_rows")))]
    return counts.select(F.col("batch_id").cast("long").alias("batch_id"), "kept", "late", *[c.alias(n) for n, c in zip(("operator_kept", "operator_late"), totals)])


@query
def stream_status_totals(spark, sf_dir):
    """Totals of one query over a stop and a restart."""
    folder = runtime.run_dir(spark, "totals")
    with progress.recording(spark, f"{folder}/progress"):
        for batches in (2, None):
            # the second run goes on from the checkpoint of the first
            rows = canonical(spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("maxFilesPerTrigger", PART_FILES).parquet(
                status_files(spark, sf_dir, folder)))
            jobs.run_available(rows, jobs.append_batch(f"{folder}/table"), f"{folder}/checkpoint", max_batches=batches)
    at = f"{folder}/progress"
    totals = progress.status_totals(progress.recorded(spark, at), progress.recorded_events(spark, at))
    return totals.select("runs", "batches", "total_received", "late_rows", "status")


def status_files(spark, sf_dir, folder):
    """The events in parts, written when first asked for."""
    path = f"{folder}/in"
    if not runtime.children(spark, path):
        rows = spark.read.parquet(f"{sf_dir}/events.parquet")
        for spans in ORDERED:
            begin, end = (F.lit(t).cast("timestamp_ntz") for t in spans[0])
            rows.where((F.col("ts") >= begin) & (F.col("ts") < end)).repartition(PART_FILES).write.mode("append").parquet(path)
    return path


@query
def stream_sessions_timed(spark, sf_dir):
    """By the state processor with timers, fed by packed slices."""
    before = spark.conf.get(state.PROVIDER)
    state.use_rocksdb(spark)
    try:
        rows = state.stream_sessions_timed(by_user(parts_stream(spark, sf_dir)), AGE_TIMEOUT, key="user_id")
        updates = spark.read.parquet(drained(spark, rows, "update"))
    finally:
        spark.conf.set(state.PROVIDER, before)
    return jobs.latest_sessions(updates, "user_id")


KEPT_COLUMNS = ("event_id", "event_name", "kafka_partition", "kafka_offset", "received_at")


@query
def stream_compacted(spark, sf_dir):
    """Days compacted between two batches, and one batch run again afterwards."""
    folder = runtime.run_dir(spark, "compact")
    rows = canonical(ranges_stream(spark, sf_dir, *MIXED))
    writer, last = jobs.append_batch(f"{folder}/table"), []

    def twice(batch, batch_id):
        writer(batch, batch_id)
        compaction.compact_days(spark, f"{folder}/table", "2030-01-01", batch_id, least=1)
        writer(batch, batch_id)
        last.append(batch_id)

    jobs.run_available(rows, twice, f"{folder}/checkpoint")
    return compaction.read_batches(spark, f"{folder}/table").select(*KEPT_COLUMNS)


@query
def stream_replayed_table(spark, sf_dir):
    """Every batch is written twice to a table that is partitioned by batch, and read without removing repeats."""
    name, folder = f"events_{uuid.uuid4().hex[:12]}", runtime.run_dir(spark, "replayed")
    table_io.create_event_table(spark, name, location=f"{folder}/table", batches=True)
    writer = jobs.append_table(name)

    def twice(batch, batch_id):
        writer(batch, batch_id)
        writer(batch, batch_id)

    rows = sample.clickstream_rows(ranges_stream(spark, sf_dir, *ORDERED)).drop("event_type", "value", "k")
    jobs.run_available(rows, twice, f"{folder}/checkpoint")
    return table_io.scan_events(spark, name, 2 * DAYS, AS_OF)


def until_read(query):
    """Wait until a continuous query has taken all that is there, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@query
def stream_continuous(spark, sf_dir):
    """The continuous job, stopped when it has read all files."""
    folder = runtime.run_dir(spark, "continuous")
    rows = canonical(ranges_stream(spark, sf_dir, *ORDERED))
    until_read(jobs.run_stream(rows, jobs.append_batch(f"{folder}/table"), f"{folder}/checkpoint", "0 seconds"))
    return spark.read.parquet(f"{folder}/table").select(*KEPT_COLUMNS)


@query
def stream_to_table(spark, sf_dir):
    """The exactly-once table sink, stopped when it has read all files."""
    name, folder = f"events_{uuid.uuid4().hex[:12]}", runtime.run_dir(spark, "sink")
    rows = canonical(ranges_stream(spark, sf_dir, *ORDERED))
    until_read(jobs.stream_to_table(rows, name, f"{folder}/checkpoint", "0 seconds"))
    return spark.table(name).select(*KEPT_COLUMNS)


@query
def catalog_document(spark, sf_dir):
    """A catalog document written from the parts, read back entry by entry with its counts."""
    path = runtime.passing_dir(spark, "catalog")
    engines = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("engineId"), F.col("p_name").alias("name"), F.col("p_brand").alias("displayName"))
    blueprints = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("blueprintId"), F.col("s_name").alias("name"))
    entries = [rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns)))).scalar().alias(n) for n, rows in (("engines", engines), ("blueprints", blueprints))]
    spark.range(1).select(F.lit("2024-01-31T00:00:00Z").alias("synced_at"), *entries).coalesce(1).write.json(path)
    loaded = documents.load_catalog(spark, path)
    counts = documents.catalog_meta(loaded)
    found = documents.catalog_items(loaded, "engines").select(F.lit("engine").alias("kind"), F.col("engineId").alias("id"), "name").unionByName(
        documents.catalog_items(loaded, "blueprints").select(F.lit("blueprint").alias("kind"), F.col("blueprintId").alias("id"), "name"))
    return found.select("*", *[counts.select(c).scalar().alias(c) for c in ("engine_count", "blueprint_count", "experience_count")])
