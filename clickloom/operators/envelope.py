"""From wire messages to canonical events: parse, validate, normalise, dedupe."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from clickloom import schema, taxonomy as tx
from clickloom.functions import scalars as sf

BAD_RECORDS = ("keep", "drop", "quarantine", "fail")
ID_LIMIT = 128
NAME_LIMIT = 200


def _is_object(c: Column) -> Column:
    return F.startswith(F.ltrim(c), F.lit("{"))


def _envelopes(message: Column) -> Column:
    """The message's envelope fields as the one element of an array; NULL when the message is not
    one JSON object and nothing else.

    The parser ignores what follows a complete value, so the message is read inside an
    array, where it must be the only element, and inside an object: what could end the
    one early is an error in the other.
    """
    inside = F.from_json(F.concat(F.lit("["), message, F.lit("]")), T.ArrayType(schema.ENVELOPE_TEXT), {"allowSingleQuotes": "false"})
    alone = F.filter(F.array(inside), lambda found: F.size(found) == 1)
    closed = F.json_object_keys(F.concat(F.lit('{"m":'), message, F.lit("}"))).isNotNull()
    return F.when(_is_object(message) & closed, F.get(alone, F.lit(0)))


def _envelope(message: Column) -> Column:
    """Envelope fields as text, or NULL."""
    return F.get(_envelopes(message), F.lit(0))


def _log_columns() -> list[Column]:
    return [
        F.col("partition").cast("int").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("event_timestamp").alias("kafka_timestamp"),
    ]


def _object_text(c: Column) -> Column:
    return F.when(_is_object(c), c)


def parse_envelope(
    messages: DataFrame, bad_records: str = "quarantine", ingested_at: Column | None = None
) -> DataFrame:
    """Typed events from raw messages, one row per message.

    The name falls back to ``event_name`` and then ``unknown``; empty ids are NULL;
    properties stay JSON text with their types. A message that is no JSON object is
    ``bad``: kept with NULL event columns, dropped, marked in ``is_bad`` for
    ``quarantined``, or an error.
    """
    if bad_records not in BAD_RECORDS:
        raise ValueError(f"bad_records must be one of {BAD_RECORDS}")
    stamped = F.current_timestamp() if ingested_at is None else ingested_at
    message = F.col("message")
    # as the output of a generator a good message is parsed once, no later filter parses it again
    envelope = F.explode(_envelopes(message)) if bad_records == "drop" else _envelope(message)
    rows = messages.select(
        envelope.alias("e"), message.alias("raw_payload"), *_log_columns(), stamped.alias("ingested_at")
    )
    e = F.col("e")
    rows = rows.select("*", e.isNull().alias("is_bad"))
    bad = F.col("is_bad")
    name = F.coalesce(sf.present(e["name"]), sf.present(e["event_name"]), F.lit(tx.UNKNOWN))
    if bad_records == "fail":
        text = F.concat(F.lit("message is no JSON object: partition "), F.col("kafka_partition"),
                        F.lit(" offset "), F.col("kafka_offset"))
        name = F.when(bad, F.raise_error(text).cast("string")).otherwise(name)
    elif bad_records != "drop":
        name = F.when(~bad, name)

    def field(c: str) -> Column:
        return sf.present(e[c]) if bad_records == "drop" else F.when(~bad, sf.present(e[c]))

    columns = {
        **{c: field(c) for c in ("event_id", "project_id", "source", "user_id", "anonymous_id", "session_id", "page_path")},
        "event_name": name,
        "properties_json": _object_text(field("properties")),
        "event_timestamp": sf.int_or_null(field("timestamp")),
    }
    out = rows.select(*[columns.get(c, F.col(c)).alias(c) for c in schema.EVENT_COLUMNS], "is_bad")
    return out if bad_records == "quarantine" else out.drop("is_bad")


def quarantined(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a ``quarantine`` parse into good events and bad messages."""
    good = parsed.where(~F.col("is_bad")).drop("is_bad")
    bad = parsed.where("is_bad").select(
        "kafka_partition", "kafka_offset", "kafka_timestamp", "ingested_at", "raw_payload"
    )
    return good, bad


def parse_envelope_strict(messages: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Every message must be a JSON object, or the job fails."""
    return parse_envelope(messages, "fail", ingested_at)


def parse_envelope_lenient(messages: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Live parse that never fails: unreadable messages become ``unknown`` events.

    Ids keep their text, empty ones included; properties that are no object become
    ``{}``; a context that is no object is NULL.
    """
    stamped = F.current_timestamp() if received_at is None else received_at
    message = F.col("message")
    rows = messages.select(
        _envelope(message).alias("e"), message.alias("raw"), *_log_columns(), stamped.alias("received_at")
    )
    e = F.col("e")
    live = rows.select(
        "raw",
        F.coalesce(sf.present(e["name"]), F.lit(tx.UNKNOWN)).alias("event_name"),
        sf.int_or_null(e["timestamp"]).alias("event_timestamp"),
        *[e[c].alias(c) for c in ("user_id", "page_path", "event_id", "project_id",
                                  "anonymous_id", "session_id", "source")],
        F.coalesce(_object_text(e["properties"]), F.lit("{}")).alias("properties_json"),
        _object_text(e["context"]).alias("context_json"),
        "kafka_partition",
        "kafka_offset",
        "kafka_timestamp",
        "received_at",
    )
    return with_component(live)


def normalize_envelope(
    events: DataFrame, default_source: str = "web", now_ms: Column | None = None
) -> DataFrame:
    """Defaults of the capture endpoint: time now when missing or 0, a source, no empty ids."""
    now_ms = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    return events.withColumns(
        {
            "event_timestamp": F.coalesce(F.nullif(F.col("event_timestamp"), F.lit(0)), now_ms),
            "source": F.coalesce(sf.present(F.col("source")), F.lit(default_source)),
            **{c: sf.present(F.col(c)) for c in ("event_id", "project_id", "anonymous_id", "session_id")},
        }
    )


def validate_envelope(messages: DataFrame) -> DataFrame:
    """Add ``failed_rules``, the names of the capture rules a message breaks."""
    e = F.col("e")

    def rule(name: str, broken: Column) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))

    rules = [
        rule("not_an_object", e.isNull()),
        rule("name_missing", e.isNotNull() & (F.length(F.coalesce(e["name"], F.lit(""))) == 0)),
        rule("name_too_long", F.length(e["name"]) > NAME_LIMIT),
        *[
            rule(f"{c}_too_long", F.length(e[c]) > ID_LIMIT)
            for c in ("event_id", "project_id", "anonymous_id", "session_id")
        ],
        *[
            rule(f"{c}_not_an_object", e[c].isNotNull() & ~_is_object(e[c]))
            for c in ("properties", "context")
        ],
        rule("timestamp_not_an_integer", ~F.rlike(e["timestamp"], F.lit(r"^[+-]?\d+(\.0+)?$"))),
    ]
    message = F.col("message")
    return (
        messages.withColumn("e", _envelope(message))
        .withColumn("failed_rules", F.filter(F.array(*rules), lambda r: r.isNotNull()))
        .drop("e")
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size("failed_rules") == 0
    return validated.where(ok).drop("failed_rules"), validated.where(~ok)


def with_component(events: DataFrame) -> DataFrame:
    """Add ``component``; properties are parsed once and one label is cleaned."""
    name = F.col("event_name")
    return (
        events.withColumn("_p", sf.property_struct(F.col("properties_json"), sf.COMPONENT_PROPS))
        .withColumn("_c", sf.component_source(name, F.col("_p")))
        .withColumn("component", sf.component_label(F.col("_c")))
        .drop("_p", "_c")
    )


def to_canonical(events: DataFrame, time_col: str = "ingested_at") -> DataFrame:
    """Rows of the event table as the reports read them, with derived keys.

    A page view without a path takes ``properties.path``. ``component`` is left to
    ``with_component``: most reports never look at it.
    """
    page = F.when(
        F.col("page_path").isNull() & (F.col("event_name") == tx.PAGEVIEW),
        sf.present(F.get_json_object("properties_json", "$.path")),
    ).otherwise(F.col("page_path"))
    properties = F.when(_is_object(F.col("properties_json")), F.col("properties_json"))
    named = events.withColumns(
        {
            "event_name": F.coalesce(sf.present(F.col("event_name")), F.lit(tx.UNKNOWN)),
            "properties_json": F.coalesce(properties, F.lit("{}")),
            "received_at": F.col(time_col).cast("timestamp"),
        }
    ).withColumn("page_path", page)
    return with_keys(named)


def with_keys(events: DataFrame) -> DataFrame:
    fallback = sf.event_fallback(*[F.col(c) for c in ("event_id", "kafka_partition", "kafka_offset", "received_at")])
    keyed = events.withColumn(
        "session_key", sf.session_key(F.col("session_id"), F.col("anonymous_id"), fallback)
    )
    return keyed.withColumn(
        "actor_key", sf.actor_key(F.col("user_id"), F.col("anonymous_id"), F.col("session_key"))
    )


def dedupe_events(events: DataFrame) -> DataFrame:
    """Earliest event per non-empty id; events without an id are all kept.

    The ``= 1`` filter on the row number lets Spark keep one row per id and map task
    before the shuffle, so an id repeated millions of times costs one row per task.
    Events without an id get a group of their own instead of sharing one.
    """
    lonely = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    rows = events.withColumn("_id", F.coalesce(sf.present(F.col("event_id")), lonely))
    order = [F.col(c).asc_nulls_last() for c in schema.ORDER_COLUMNS[:3]]
    rank = F.row_number().over(W.Window.partitionBy("_id").orderBy(*order))
    return rows.withColumn("_rn", rank).where("_rn = 1").drop("_rn", "_id")


def load_metrics(events: DataFrame, window_days: int) -> DataFrame:
    """Rows read, rows left after ``dedupe_events``, and the window, without deduping."""
    per_id = events.groupBy(sf.present(F.col("event_id")).alias("id")).agg(F.count("*").alias("n"))
    distinct = F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(1))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum(distinct), F.lit(0)).alias("events_after_dedupe"),
    ).withColumn("window_days", F.lit(window_days))


def build_events(
    events: DataFrame, super_properties: Mapping[str, str], properties: str = "properties"
) -> DataFrame:
    """Registered properties under each event's own: on a clash the event wins.

    ``properties`` is a text map column.
    """
    registered = F.create_map(*[F.lit(x) for kv in super_properties.items() for x in kv])
    own = F.coalesce(F.col(properties), F.create_map().cast("map<string,string>"))
    if not super_properties:
        return events.withColumn(properties, own)
    missing = F.map_filter(registered, lambda k, _: ~F.map_contains_key(own, k))
    return events.withColumn(properties, F.map_concat(missing, own))


def identify_events(users: DataFrame, user_col: str = "user_id", traits: str = "traits") -> DataFrame:
    """``user_identified`` events: the user id under the traits, which win on a clash."""
    own = F.coalesce(F.col(traits), F.create_map().cast("map<string,string>"))
    base = F.create_map(F.lit("userId"), F.col(user_col).cast("string"))
    missing = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))
    known = users.where(sf.present(F.col(user_col).cast("string")).isNotNull())
    return known.withColumn("event_name", F.lit(tx.IDENTIFY[0])).withColumn(
        "properties", F.map_concat(missing, own)
    )
