"""The scalar rules as temporary SQL functions, for users of ``spark.sql``.

Plain SQL bodies: Spark inlines them, so they cost what the expression costs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from clickloom import taxonomy as tx
from clickloom.functions import scalars as sf

#: White space as an SQL string, the same characters the column rules trim.
BLANKS = "'" + "".join(f"\\u{ord(c):04x}" for c in sf.WHITESPACE) + "'"


#: The pattern of the column rule, with its backslashes doubled for an SQL string.
PATTERN = sf.LABEL_BREAKS.replace("\\", "\\\\")


def _component_body() -> str:
    label = "sanitize_label(get_json_object(props, '$.{k}'))"
    filled = "nullif(btrim(get_json_object(props, '$.{k}'), " + BLANKS + "), '') IS NOT NULL"
    arms = [f"WHEN {filled.format(k=k)} THEN '{k}:' || {label.format(k=k)}" for k in tx.COMPONENT_KEYS]
    arms.append(f"WHEN name = '{tx.PAGEVIEW}' AND {filled.format(k='path')} THEN 'path:' || {label.format(k='path')}")
    return "CASE " + " ".join(arms) + " ELSE '-' END"


def definitions() -> dict[str, str]:
    """Function signature to SQL body."""
    return {
        "pct(n DOUBLE, d DOUBLE) RETURNS DOUBLE": "CASE WHEN d <= 0 THEN 0D ELSE bround(n / d * 100, 1) END",
        "mask_email(email STRING) RETURNS STRING": f"""
            CASE WHEN email IS NULL THEN NULL
                 WHEN contains(email, '@') THEN regexp_replace(btrim(email, {BLANKS}), '^([^@]?)[^@]*@', '$1***@')
                 WHEN length(btrim(email, {BLANKS})) > 2 THEN left(btrim(email, {BLANKS}), 2) || '***'
                 ELSE '***' END""",
        "session_key(session_id STRING, anonymous_id STRING, event_ref STRING) RETURNS STRING":
            "coalesce(nullif(session_id, ''), 'anon:' || nullif(anonymous_id, ''), 'evt:' || event_ref)",
        "sanitize_label(label STRING) RETURNS STRING": rf"""
            regexp_replace(btrim(left(regexp_replace(btrim(label, {BLANKS}), '{PATTERN}', '_'), 64), '_'), '^$', '{tx.UNKNOWN}')""",
        "event_component(name STRING, props STRING) RETURNS STRING": _component_body(),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session and return their names."""
    names = []
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.partition("(")[0])
    return names
