"""The ``events`` test table re-read as a clickstream and as raw messages.

Deterministic column rules, so every report runs over the whole table it is given and
can be checked against SQL over the same table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import envelope

#: End of the sample's clock; the current week is the seven days before it.
AS_OF = "2024-01-31 00:00:00"

# Event names of the sample per event type, each up to a bound of ``k``.
NAMES = {
    "view": (
        (60, "$pageview"), (70, "marketplace_doc_viewed"), (80, "faq_opened"), (90, "playground_tab_changed"),
        (100, "marketplace_preview_clicked"),
    ),
    "click": (
        (15, "hero_cta_clicked"), (30, "nav_link_clicked"), (50, "marketplace_details_clicked"),
        (65, "blueprint_card_clicked"), (80, "button_clicked"), (100, "engine_deploy_clicked"),
    ),
    "signup": ((70, "$pageview"), (100, "user_identified")),
    "purchase": ((25, "awc_lead_form_submitted"), (35, "demo_form_submitted"), (100, "$pageview")),
    "error": ((50, "$pageview"), (100, "unknown")),
}
# Properties of the sample by event name; ``u`` is filled in per row.
PROPERTIES = {
    "marketplace_details_clicked": lambda k: {"blueprint": f"bp-{k % 7}"},
    "blueprint_card_clicked": lambda k: {"blueprint": f"bp-{k % 7}"},
    "marketplace_doc_viewed": lambda k: {"blueprint": f"bp-{k % 7}"},
    "marketplace_preview_clicked": lambda k: {"blueprint": f"bp-{k % 7}"},
    "button_clicked": lambda k: {"button": f"b{k % 4}"},
    "hero_cta_clicked": lambda k: {"target": "lead_form", "label": f"l{k % 3}"},
    "nav_link_clicked": lambda k: {"label": f"n{k % 3}", "href": "/features" if k % 3 == 0 else "/"},
    "faq_opened": lambda k: {"question": f"q{k % 5}"},
    "engine_deploy_clicked": lambda k: {"engine": f"e{k % 4}"},
    "playground_tab_changed": lambda k: {"tab": f"t{k % 3}"},
    "awc_lead_form_submitted": lambda k: {"email": "u<u>@example.com"},
    "demo_form_submitted": lambda k: {"email": "u<u>@example.com"},
    "$pageview": lambda k: {"path": f"/p{k % 9}"},
}
RULE = "map<string,array<struct<name:string,properties:string,page:string>>>"


def _page(k: int) -> str | None:
    if k % 8 == 7:
        return None
    return ("/", "/features", "/playground")[k % 5] if k % 5 < 3 else f"/marketplace/{k % 6}"


def _rule(event_type: str, k: int) -> dict:
    name = next(n for bound, n in NAMES[event_type] if k < bound)
    properties = PROPERTIES.get(name, lambda _: {})(k)
    return {"name": name, "properties": json.dumps(properties, separators=(",", ":")), "page": _page(k)}


def _rules() -> Column:
    """Rules per event type and ``k`` as one constant, which stays small wherever
    Spark copies it, unlike nested CASE expressions."""
    table = {t: [_rule(t, k) for k in range(100)] for t in NAMES}
    return F.from_json(F.lit(json.dumps(table)), RULE)


def clickstream_rows(events: DataFrame) -> DataFrame:
    """Rows of the event table from the ``events`` test table."""
    base = events.select(
        F.col("event_id").alias("eid"),
        F.col("ts").cast("timestamp").alias("t"),
        F.col("user_id").alias("u"),
        "event_type",
        "value",
        # the text is {"k": <number>}
        F.btrim("props", F.lit('{"k: }')).cast("int").alias("k"),
    )
    k, u = F.col("k"), F.col("u").cast("string")
    rule = F.get(F.element_at(_rules(), F.col("event_type")), k)
    day = F.dayofmonth("t")
    third = F.floor((day - 1) / 3).cast("string")
    signed = F.col("event_type").isin("signup", "purchase") & (k % 2 == 0)
    domain = F.when(k % 4 == 0, "@example.com").otherwise("")
    rotating = F.when(F.col("u") % 5 == 0, F.concat(F.lit("-"), day.cast("string"))).otherwise("")
    return base.select(
        F.col("eid").cast("string").alias("event_id"),
        F.lit("p1").alias("project_id"),
        rule["name"].alias("event_name"),
        F.replace(rule["properties"], F.lit("<u>"), u).alias("properties_json"),
        F.unix_millis("t").alias("event_timestamp"),
        F.lit("fixture").alias("source"),
        F.when(signed, F.concat(F.lit("user"), u, domain)).alias("user_id"),
        F.when(k % 20 != 19, F.concat(F.lit("anon-"), u, rotating)).alias("anonymous_id"),
        F.when(k % 10 != 9, F.concat(F.lit("sess-"), u, F.lit("-"), third)).alias("session_id"),
        rule["page"].alias("page_path"),
        (F.col("eid") % 3).cast("int").alias("kafka_partition"),
        F.expr("eid div 3").alias("kafka_offset"),
        F.col("t").alias("kafka_timestamp"),
        F.col("t").alias("ingested_at"),
        F.lit(None).cast("string").alias("raw_payload"),
        "event_type",
        "value",
        "k",
    )


def read_events(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """The test table; ``since`` reaches the files as a pushed filter."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events if since is None else events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))


def clickstream(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """Canonical events of the sample."""
    rows = clickstream_rows(read_events(spark, sf_dir, since)).drop("event_type", "value", "k")
    return envelope.to_canonical(rows)


def raw_messages(events: DataFrame) -> DataFrame:
    """Wire messages of the sample, with defects and replayed duplicates."""
    rows = clickstream_rows(events)
    quoted = lambda c: F.expr(f"coalesce('\"' || {c} || '\"', 'null')")
    eid = F.col("event_id").cast("long")
    name = (
        F.when(F.col("k") == 22, F.expr("repeat('n', 201)")).otherwise(F.col("event_name"))
    )
    rows = rows.withColumns(
        {
            "m_id": F.when(eid % 97 == 0, F.lit("null"))
            .when(F.col("k") == 23, F.expr("'\"' || repeat('i', 129) || '\"'"))
            .when(F.col("k") == 24, F.lit('""'))
            .otherwise(quoted("event_id")),
            "m_name": F.concat(
                F.when(F.col("k") == 21, F.lit('"event_name":"')).otherwise(F.lit('"name":"')), name, F.lit('"')
            ),
            "m_props": F.when(F.col("k") == 16, F.lit('"text"')).otherwise(F.col("properties_json")),
            "m_ts": F.when(F.col("k") == 17, F.expr("'\"' || event_timestamp || '\"'"))
            .when(F.col("k") == 18, F.expr("event_timestamp || '.5'"))
            .otherwise(F.col("event_timestamp").cast("string")),
            "m_user": F.when(F.col("k") == 26, F.lit("12345")).otherwise(quoted("user_id")),
            "m_anon": F.when(F.col("k") == 24, F.lit('""')).otherwise(quoted("anonymous_id")),
            "m_sess": F.when(F.col("k") == 24, F.lit('""')).otherwise(quoted("session_id")),
            "m_path": quoted("page_path"),
        }
    )
    whole = F.concat(
        F.lit('{"event_id":'), "m_id", F.lit(',"project_id":"p1",'), "m_name", F.lit(',"properties":'), "m_props",
        F.lit(',"timestamp":'), "m_ts", F.lit(',"source":"fixture","user_id":'), "m_user",
        F.lit(',"anonymous_id":'), "m_anon", F.lit(',"session_id":'), "m_sess", F.lit(',"page_path":'), "m_path",
        F.lit("}"),
    )
    message = (
        F.when(F.col("k") == 13, F.lit("{bad")).when(F.col("k") == 14, F.lit("[1,2]")).when(F.col("k") == 15, F.lit(""))
        .when(F.col("k") == 27, F.concat(whole, F.lit('{"name":"second"}')))
        .when(F.col("k") == 28, F.concat(whole, F.lit(" junk")))
        .when(F.col("k") == 29, F.lit("{'name':'quoted'}"))
        .when(F.col("k") == 30, F.concat(whole, F.lit('],[{"name":"second"}')))
        .otherwise(whole)
    )
    sent = rows.select(
        message.alias("message"),
        F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"),
        F.col("kafka_timestamp").alias("event_timestamp"),
        eid.alias("eid"),
    )
    # every 50th message is sent again five minutes later at a new offset; as the output
    # of a generator, the message is built once and no later filter builds it again
    repeated = sent.select(
        "eid",
        F.stack(
            F.lit(2),
            F.lit(False), "message", "partition", "offset", "event_timestamp",
            F.lit(True), "message", "partition", F.col("offset") + 1_000_000_000,
            F.col("event_timestamp") + F.expr("INTERVAL 5 MINUTES"),
        ).alias("again", "message", "partition", "offset", "event_timestamp"),
    )
    wanted = repeated.where(~F.col("again") | (F.col("eid") % 50 == 0))
    return wanted.select("message", "partition", "offset", "event_timestamp")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_messages(read_events(spark, sf_dir))


def publish_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish attempts with status and duration, from the event values."""
    return read_events(spark, sf_dir).select(
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        (F.col("value") / 10).alias("duration_s"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )
