"""Column to Column helpers, all built-in expressions.

"Missing" means NULL or the empty string throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom import taxonomy as tx

# Fixed value: the characters Unicode calls white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: What becomes an underscore in a label.
LABEL_BREAKS = r"[^\p{L}\p{N}_.:/-]+"
UTM_KEYS = ("source", "medium", "campaign", "term", "content")


def present(c: Column) -> Column:
    """Empty string to NULL."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def nonblank(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return present(strip(c))


def pct(n: Column, d: Column) -> Column:
    """Percentage with one decimal, ties to even, 0.0 for an empty base."""
    return F.when(d <= 0, F.lit(0.0)).otherwise(F.bround(n / d * 100, 1))


def share_pct(value: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(value / total * 100, 1)).otherwise(F.lit(0.0))


def delta_pct(current: Column, previous: Column) -> Column:
    """Change in percent; NULL when both are zero, 100.0 when only the base is."""
    return (
        F.when((previous <= 0) & (current <= 0), F.lit(None).cast("double"))
        .when(previous <= 0, F.lit(100.0))
        .otherwise(F.bround((current - previous) / previous * 100, 1))
    )


def mask_email(c: Column) -> Column:
    """Keep the first character and the domain; other texts keep two characters."""
    text = strip(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.contains(c, F.lit("@")), F.regexp_replace(text, "^([^@]?)[^@]*@", "$1***@"))
        .when(F.length(text) > 2, F.concat(F.left(text, F.lit(2)), F.lit("***")))
        .otherwise(F.lit("***"))
    )


def truncate_id(c: Column, limit: int = 14) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(present(c))


def session_key(session_id: Column, anonymous_id: Column, fallback: Column) -> Column:
    """Session id, else the visitor, else the event on its own."""
    return F.coalesce(
        present(session_id),
        F.concat(F.lit("anon:"), present(anonymous_id)),
        F.concat(F.lit("evt:"), fallback),
    )


def event_fallback(event_id: Column, partition: Column, offset: Column, received_at: Column) -> Column:
    """What sets an event without ids apart: its id, its log position, its arrival."""
    position = F.concat(partition.cast("string"), F.lit("/"), offset.cast("string"))
    return F.coalesce(present(event_id), position, F.unix_micros(received_at).cast("string"))


def actor_key(user_id: Column, anonymous_id: Column, session: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("user:"), present(user_id)),
        F.concat(F.lit("anon:"), present(anonymous_id)),
        session,
    )


def property_struct(properties_json: Column, keys: Iterable[str]) -> Column:
    """The named properties as text, parsed once; all NULL for text that is no object.

    Text that mentions none of the keys is not parsed at all. A backslash may hide a
    key behind an escape, so such text is always parsed.
    """
    names = list(dict.fromkeys(keys))
    fields = T.StructType([T.StructField(k, T.StringType()) for k in names])
    mentioned = F.contains(properties_json, F.lit("\\"))
    for k in names:
        mentioned |= F.contains(properties_json, F.lit(k))
    return F.when(mentioned, F.from_json(properties_json, fields))


def first_prop(props: Column, keys: Sequence[str]) -> Column:
    """First non-blank property of a ``property_struct``."""
    return F.coalesce(*[nonblank(props[k]) for k in keys])


def form_email(props: Column, user_id: Column) -> Column:
    return F.coalesce(
        first_prop(props, tx.EMAIL_KEYS), F.when(F.contains(user_id, F.lit("@")), user_id)
    )


def short_event_name(c: Column) -> Column:
    return F.regexp_replace(strip(c), "^(" + "|".join(tx.SHORT_NAME_PREFIXES) + ")", "")


def sanitize_label(c: Column, limit: int = 64) -> Column:
    """Runs of characters outside letters, digits and ``_ . : / -`` become one underscore."""
    cleaned = F.left(F.regexp_replace(strip(c), LABEL_BREAKS, "_"), F.lit(limit))
    # an empty label becomes "unknown"; said as a pattern, so that the label is built once
    return F.regexp_replace(F.btrim(cleaned, F.lit("_")), "^$", tx.UNKNOWN)


def component_source(event_name: Column, props: Column) -> Column:
    """Which property names the component, and its text; NULL without one.

    ``props`` needs the component keys and ``path``.
    """
    def found(key: str) -> Column:
        return F.length(strip(props[key])) > 0

    def source(key: str) -> Column:
        return F.struct(F.lit(key).alias("key"), props[key].alias("text"))

    first, *others = tx.COMPONENT_KEYS
    choice = F.when(found(first), source(first))
    for key in others:
        choice = choice.when(found(key), source(key))
    return choice.when((event_name == tx.PAGEVIEW) & found("path"), source("path"))


def component_label(source: Column) -> Column:
    return F.coalesce(F.concat(source["key"], F.lit(":"), sanitize_label(source["text"])), F.lit("-"))


def event_component(event_name: Column, props: Column) -> Column:
    """Low-cardinality ``key:value`` of the first property that names a component."""
    return component_label(component_source(event_name, props))


COMPONENT_PROPS = (*tx.COMPONENT_KEYS, "path")


def bucket_key(ts: Column, hourly: bool) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00" if hourly else "yyyy-MM-dd")


def parse_time(c: Column) -> Column:
    """Arrival time from epoch seconds, epoch milliseconds or one of five text forms.

    Anything else is NULL: the caller decides what an unreadable time means.
    """
    text = present(F.trim(c.cast("string")))
    number = text.try_cast("double")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parsed = [
        F.try_to_timestamp(text, F.lit(f.replace("ss", "ss" + frac)))
        for f in forms
        for frac in (".[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "")
        if not (frac and f.endswith("'Z'"))
    ]
    return (
        F.when(number > 1e12, F.timestamp_micros((number * 1000).try_cast("long")))
        .when(number > 1e9, F.timestamp_micros((number * 1000000).try_cast("long")))
        .otherwise(F.coalesce(*parsed))
    )


def parse_properties(c: Column) -> Column:
    """Properties as a text map, empty when the text is no JSON object."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(c, T.MapType(T.StringType(), T.StringType())), empty)


def parse_utm(url: Column) -> Column:
    """Campaign parameters of a URL without their prefix; NULL when there are none."""
    pairs = [
        F.struct(
            F.lit(k).alias("key"),
            present(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(f"utm_{k}")))).alias("value"),
        )
        for k in UTM_KEYS
    ]
    found = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
    return F.when(F.size(found) > 0, F.map_from_entries(found))


def int_or_null(c: Column) -> Column:
    """Whole number of a JSON value given as text: fractions are cut, junk is NULL."""
    fraction = F.when(F.rlike(c, F.lit(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), c.try_cast("double"))
    return F.coalesce(c.try_cast("bigint"), fraction.try_cast("bigint"))


def rule_classify(name: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """Value of the first rule whose needle occurs in the lowercase name."""
    lowered = F.lower(name)
    matched = F.coalesce(*[F.when(F.contains(lowered, F.lit(n)), F.lit(v)) for n, v in rules])
    return F.coalesce(matched, default)


def prefix_key(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Key of the first rule whose prefix starts the name, else NULL."""
    return F.coalesce(
        *[F.when(F.startswith(name, F.lit(p)), F.lit(v)) for p, v in rules], F.lit(None).cast("string")
    )


def context_field(raw_payload: Column, path: str) -> Column:
    """Field of the envelope's context, e.g. ``browser`` or ``utm.source``."""
    return F.get_json_object(raw_payload, f"$.context.{path}")


def event_clock_key(*columns: Column) -> Column:
    """Identity of an event on a live page that has no ids."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
