"""SQL for the registered queries, written independently of the Spark code.

Nothing is shared with it but the event vocabulary.
"""

from __future__ import annotations

from clickloom import taxonomy as tx
from clickloom.functions.scalars import WHITESPACE

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
WHOLE_FROM = "TIMESTAMP '2024-01-01 00:00:00'"
MIDDLE = "TIMESTAMP '2024-01-16 00:00:00'"
HALF, WHOLE = 15 * 86400, 30 * 86400
SPACES = "'" + WHITESPACE.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


FORM, MARKET, BROWSE = names(tx.FORM_SUBMIT), names(tx.MARKETPLACE), names(tx.MARKETPLACE_BROWSE)
BLUEPRINT, DOC, CTA = names(tx.BLUEPRINT_INTERACTION), names(tx.DOC_VIEW), names(tx.CTA)


def prop(key: str) -> str:
    return f"nullif(trim(json_extract_string(properties_json, '$.{key}'), {SPACES}), '')"


def first_prop(keys) -> str:
    return "coalesce(" + ", ".join(prop(k) for k in keys) + ")"


def sanitize(x: str) -> str:
    cleaned = f"left(regexp_replace(trim({x}, {SPACES}), '[^\\p{{L}}\\p{{N}}_.:/-]+', '_', 'g'), 64)"
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(nullif(trim({cleaned}, '_'), ''), 'unknown') END"


def component() -> str:
    arms = [f"WHEN {prop(k)} IS NOT NULL THEN '{k}:' || {sanitize(prop(k))}" for k in tx.COMPONENT_KEYS]
    arms.append(f"WHEN event_name = '$pageview' AND {prop('path')} IS NOT NULL THEN 'path:' || {sanitize(prop('path'))}")
    return "CASE " + " ".join(arms) + " ELSE '-' END"


def mask(x: str) -> str:
    t = f"trim({x}, {SPACES})"
    return f"""CASE WHEN {x} IS NULL THEN NULL
      WHEN strpos({t}, '@') = 0 THEN CASE WHEN length({t}) > 2 THEN left({t}, 2) || '***' ELSE '***' END
      WHEN strpos({t}, '@') = 1 THEN '***@' || substr({t}, 2)
      ELSE left({t}, 1) || '***@' || substr({t}, strpos({t}, '@') + 1) END"""


def pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} <= 0 THEN 0.0 ELSE round_even(CAST({n} AS DOUBLE) / {d} * 100, 1) END"


def delta(c: str, p: str) -> str:
    return f"""CASE WHEN {p} <= 0 AND {c} <= 0 THEN NULL WHEN {p} <= 0 THEN 100.0
      ELSE round_even(CAST({c} - {p} AS DOUBLE) / {p} * 100, 1) END"""


EMAIL = f"coalesce({', '.join(prop(k) for k in tx.EMAIL_KEYS)}, CASE WHEN contains(user_id, '@') THEN user_id END)"

# The sample's column rules; ``k`` is the integer in ``props``.
EVENT_NAME = """CASE event_type
  WHEN 'view' THEN CASE WHEN k < 60 THEN '$pageview' WHEN k < 70 THEN 'marketplace_doc_viewed'
    WHEN k < 80 THEN 'faq_opened' WHEN k < 90 THEN 'playground_tab_changed' ELSE 'marketplace_preview_clicked' END
  WHEN 'click' THEN CASE WHEN k < 15 THEN 'hero_cta_clicked' WHEN k < 30 THEN 'nav_link_clicked'
    WHEN k < 50 THEN 'marketplace_details_clicked' WHEN k < 65 THEN 'blueprint_card_clicked'
    WHEN k < 80 THEN 'button_clicked' ELSE 'engine_deploy_clicked' END
  WHEN 'signup' THEN CASE WHEN k < 70 THEN '$pageview' ELSE 'user_identified' END
  WHEN 'purchase' THEN CASE WHEN k < 25 THEN 'awc_lead_form_submitted' WHEN k < 35 THEN 'demo_form_submitted'
    ELSE '$pageview' END
  ELSE CASE WHEN k < 50 THEN '$pageview' ELSE 'unknown' END END"""
SESSION_ID = "CASE WHEN k % 10 = 9 THEN NULL ELSE 'sess-' || u || '-' || CAST(floor((d - 1) / 3.0) AS INT) END"
ANONYMOUS_ID = "CASE WHEN k % 20 = 19 THEN NULL WHEN u % 5 = 0 THEN 'anon-' || u || '-' || d ELSE 'anon-' || u END"
USER_ID = """CASE WHEN event_type IN ('signup', 'purchase') AND k % 2 = 0
  THEN 'user' || u || CASE WHEN k % 4 = 0 THEN '@example.com' ELSE '' END END"""
PAGE_PATH = """CASE WHEN k % 8 = 7 THEN NULL WHEN k % 5 = 0 THEN '/' WHEN k % 5 = 1 THEN '/features'
  WHEN k % 5 = 2 THEN '/playground' ELSE '/marketplace/' || (k % 6) END"""
PROPERTIES = """CASE
  WHEN event_name IN ('marketplace_details_clicked', 'blueprint_card_clicked', 'marketplace_doc_viewed',
    'marketplace_preview_clicked') THEN '{"blueprint":"bp-' || (k % 7) || '"}'
  WHEN event_name = 'button_clicked' THEN '{"button":"b' || (k % 4) || '"}'
  WHEN event_name = 'hero_cta_clicked' THEN '{"target":"lead_form","label":"l' || (k % 3) || '"}'
  WHEN event_name = 'nav_link_clicked' THEN '{"label":"n' || (k % 3) || '","href":"' ||
    CASE WHEN k % 3 = 0 THEN '/features' ELSE '/' END || '"}'
  WHEN event_name = 'faq_opened' THEN '{"question":"q' || (k % 5) || '"}'
  WHEN event_name = 'engine_deploy_clicked' THEN '{"engine":"e' || (k % 4) || '"}'
  WHEN event_name = 'playground_tab_changed' THEN '{"tab":"t' || (k % 3) || '"}'
  WHEN event_name IN ('awc_lead_form_submitted', 'demo_form_submitted')
    THEN '{"email":"u' || u || '@example.com"}'
  WHEN event_name = '$pageview' THEN '{"path":"/p' || (k % 9) || '"}'
  ELSE '{}' END"""

#: Rows of the event table.
ROWS = f"""base AS (
  SELECT event_id AS eid, ts AS t, user_id AS u, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, day(ts) AS d FROM events),
named AS (SELECT *, {EVENT_NAME} AS event_name FROM base),
clicks AS (
  SELECT CAST(eid AS VARCHAR) AS event_id, 'p1' AS project_id, event_name, {PROPERTIES} AS properties_json,
    epoch_us(t) // 1000 AS event_timestamp, 'fixture' AS source, {USER_ID} AS user_id,
    {ANONYMOUS_ID} AS anonymous_id, {SESSION_ID} AS session_id, {PAGE_PATH} AS page_path,
    CAST(eid % 3 AS INTEGER) AS kafka_partition, eid // 3 AS kafka_offset, t AS received_at, eid, k, value, event_type
  FROM named)"""


def keyed(source: str, out: str) -> str:
    """Canonical events with their keys from rows of the event table."""
    return f"""{out}_paths AS (
  SELECT * REPLACE (CASE WHEN page_path IS NULL AND event_name = '$pageview'
    THEN nullif(json_extract_string(properties_json, '$.path'), '') ELSE page_path END AS page_path) FROM {source}),
{out}_sessions AS (
  SELECT *, coalesce(nullif(session_id, ''), 'anon:' || nullif(anonymous_id, ''),
    'evt:' || coalesce(nullif(event_id, ''), kafka_partition || '/' || kafka_offset)) AS session_key FROM {out}_paths),
{out} AS (
  SELECT *, coalesce('user:' || nullif(user_id, ''), 'anon:' || nullif(anonymous_id, ''), session_key) AS actor_key
  FROM {out}_sessions)"""


EV = f"{ROWS},\n{keyed('clicks', 'ev')}"
COMPONENTS = f"{EV},\nevc AS (SELECT *, {component()} AS component FROM ev)"
WINDOWED = f"{EV},\nw AS (SELECT * FROM ev WHERE received_at >= {WHOLE_FROM})"
COMPARED = f"""{EV},
p AS (SELECT *, CASE WHEN received_at >= {MIDDLE} THEN 'current' ELSE 'previous' END AS period
  FROM ev WHERE received_at >= {WHOLE_FROM})"""


def quoted(c: str) -> str:
    return f"coalesce('\"' || {c} || '\"', 'null')"


#: Wire messages with their defects.
MESSAGES = f"""{ROWS},
whole AS (
  SELECT *, '{{"event_id":' || CASE WHEN eid % 97 = 0 THEN 'null' WHEN k = 23 THEN '"' || repeat('i', 129) || '"'
      WHEN k = 24 THEN '""' ELSE {quoted('event_id')} END
    || ',"project_id":"p1",' || CASE WHEN k = 21 THEN '"event_name":"' ELSE '"name":"' END
    || CASE WHEN k = 22 THEN repeat('n', 201) ELSE event_name END || '"'
    || ',"properties":' || CASE WHEN k = 16 THEN '"text"' ELSE properties_json END
    || ',"timestamp":' || CASE WHEN k = 17 THEN '"' || event_timestamp || '"' WHEN k = 18 THEN event_timestamp || '.5'
      ELSE CAST(event_timestamp AS VARCHAR) END
    || ',"source":"fixture","user_id":' || CASE WHEN k = 26 THEN '12345' ELSE {quoted('user_id')} END
    || ',"anonymous_id":' || CASE WHEN k = 24 THEN '""' ELSE {quoted('anonymous_id')} END
    || ',"session_id":' || CASE WHEN k = 24 THEN '""' ELSE {quoted('session_id')} END
    || ',"page_path":' || {quoted('page_path')} || '}}' AS whole FROM clicks),
sent AS (
  SELECT CASE k WHEN 13 THEN '{{bad' WHEN 14 THEN '[1,2]' WHEN 15 THEN ''
    WHEN 27 THEN whole || '{{"name":"second"}}' WHEN 28 THEN whole || ' junk' WHEN 29 THEN '{{''name'':''quoted''}}'
    WHEN 30 THEN whole || '],[{{"name":"second"}}' ELSE whole END AS message,
    kafka_partition AS "partition", kafka_offset AS "offset", received_at AS event_timestamp, eid FROM whole),
msg AS (
  SELECT message, "partition", "offset", event_timestamp FROM sent
  UNION ALL
  SELECT message, "partition", "offset" + 1000000000, event_timestamp + INTERVAL 5 MINUTE FROM sent WHERE eid % 50 = 0),
obj AS (
  SELECT *, CASE WHEN json_valid(message) THEN CASE WHEN json_type(message) = 'OBJECT' THEN message END END AS j FROM msg)"""


def wire(field: str) -> str:
    return f"json_extract_string(j, '$.{field}')"


WIRE_OBJECT = "CASE WHEN json_type(j, '$.{f}') = 'OBJECT' THEN CAST(json_extract(j, '$.{f}') AS VARCHAR) END"
WIRE_TIME = f"CAST(trunc(try_cast({wire('timestamp')} AS DOUBLE)) AS BIGINT)"

PARSED = f"""{MESSAGES},
parsed AS (
  SELECT j IS NULL AS is_bad, {', '.join(f"nullif({wire(c)}, '') AS {c}" for c in (
      'event_id', 'project_id', 'source', 'user_id', 'anonymous_id', 'session_id', 'page_path'))},
    CASE WHEN j IS NOT NULL
      THEN coalesce(nullif({wire('name')}, ''), nullif({wire('event_name')}, ''), 'unknown') END AS event_name,
    {WIRE_OBJECT.format(f='properties')} AS properties_json, {WIRE_TIME} AS event_timestamp,
    "partition" AS kafka_partition, "offset" AS kafka_offset, event_timestamp AS kafka_timestamp,
    event_timestamp AS received_at, message AS raw_payload
  FROM obj),
good AS (SELECT * FROM parsed WHERE NOT is_bad),
{keyed('good', 'g')},
firsts AS (
  SELECT * FROM g WHERE event_id IS NULL
  UNION ALL
  SELECT * FROM g WHERE event_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, kafka_partition, kafka_offset) = 1)"""

#: Session frame of the whole window.
BROWSED = f"""(event_name IN {BROWSE} OR page_path = '/features'
    OR (event_name = 'nav_link_clicked' AND starts_with(json_extract_string(properties_json, '$.href'), '/features')))"""


def session_sql(source: str, by: str = "") -> str:
    keys = f"{by}session_key"
    order = "received_at, kafka_partition, kafka_offset, event_id"
    return f"""s AS (
  SELECT {keys}, count(*) AS event_count, min(received_at) AS first_at, max(received_at) AS last_at,
    bool_or(event_name = '$pageview') AS pageview, bool_or(coalesce({BROWSED}, false)) AS marketplace_browse,
    bool_or(event_name = 'marketplace_details_clicked') AS blueprint_detail, bool_or(event_name IN {DOC}) AS doc_read,
    bool_or(event_name IN {CTA}) AS cta_click, bool_or(event_name IN {FORM}) AS form_submit,
    bool_or(event_name IN {MARKET}) AS market, count(*) FILTER (WHERE event_name IN {FORM}) AS forms,
    count(DISTINCT nullif(page_path, '')) AS page_count,
    min(received_at) FILTER (WHERE event_name IN {FORM}) AS submitted_at,
    coalesce(min(received_at) FILTER (WHERE event_name = '$pageview'), min(received_at)) AS started_at,
    first(anonymous_id ORDER BY {order}) FILTER (WHERE nullif(anonymous_id, '') IS NOT NULL) AS anonymous_id,
    first(event_name ORDER BY {order}) FILTER (WHERE event_name IN {FORM}) AS form_event,
    first({mask(EMAIL)} ORDER BY {order}) FILTER (WHERE event_name IN {FORM}) AS email_masked,
    first(struct_pack(u := user_id) ORDER BY {order}) FILTER (WHERE event_name IN {FORM}) AS submit_user,
    last(CASE WHEN nullif(user_id, '') IS NULL THEN {mask(EMAIL)} WHEN contains(user_id, '@') THEN {mask('user_id')}
      ELSE user_id END ORDER BY {order}) FILTER (WHERE coalesce(nullif(user_id, ''), {EMAIL}) IS NOT NULL) AS user_display
  FROM {source} GROUP BY {keys}),
page_first AS (
  SELECT session_key, page_path, min(received_at) AS first_seen_at FROM {source}
  WHERE nullif(page_path, '') IS NOT NULL GROUP BY session_key, page_path),
page_lists AS (
  SELECT session_key, CASE WHEN count(*) <= 500 THEN string_agg(page_path, ' | ' ORDER BY first_seen_at, page_path) END AS pages
  FROM page_first GROUP BY session_key)"""


SESSIONS = f"{WINDOWED},\n{session_sql('w')}"
ROWS_OUT = f"""{SESSIONS},
r AS (
  SELECT s.session_key AS session_id,
    CASE WHEN length(s.session_key) > 14 THEN left(s.session_key, 14) || '…' ELSE s.session_key END AS session_id_short,
    anonymous_id, CASE WHEN length(anonymous_id) > 14 THEN left(anonymous_id, 14) || '…' ELSE anonymous_id END AS anonymous_id_short,
    user_display, form_submit AS converted, form_event, market AS marketplace_engaged,
    CASE WHEN page_count = 0 THEN '' ELSE pages END AS pages, page_count, event_count,
    first_at AS first_activity_at, last_at AS last_activity_at
  FROM s LEFT JOIN page_lists USING (session_key))"""


def kpi_sql(source: str, by: str = "") -> str:
    """KPIs per value of ``by`` (empty or a column with a trailing comma)."""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    on = f"USING ({by.rstrip(', ')})" if by else "ON true"
    return f"""{session_sql(source, by)},
actor AS (SELECT {by}actor_key, bool_or(nullif(user_id, '') IS NOT NULL OR event_name = 'user_identified') AS known
  FROM {source} GROUP BY {by}actor_key),
session_totals AS (
  SELECT {by}count(*) AS sessions, sum(forms) AS form_submissions, count(*) FILTER (WHERE pageview) AS viewed,
    count(*) FILTER (WHERE form_submit) AS converted, count(*) FILTER (WHERE market) AS market,
    count(*) FILTER (WHERE page_count >= 2) AS multi, count(*) FILTER (WHERE event_count >= 3) AS engaged FROM s {group}),
actor_totals AS (SELECT {by}count(*) AS actors, count(*) FILTER (WHERE known) AS identified_users FROM actor {group}),
k AS (
  SELECT {by}CAST(sessions AS BIGINT) AS sessions, actors, identified_users, CAST(form_submissions AS BIGINT) AS form_submissions,
    {pct('converted', 'greatest(viewed, 1)')} AS conversion_rate_pct,
    {pct('market', 'greatest(viewed, 1)')} AS marketplace_engagement_rate_pct,
    {pct('multi', 'greatest(sessions, 1)')} AS multi_page_session_rate_pct,
    {pct('engaged', 'greatest(sessions, 1)')} AS engaged_session_rate_pct
  FROM session_totals JOIN actor_totals {on})"""


COMPARED_KPIS = (
    "sessions", "form_submissions", "conversion_rate_pct", "identified_users", "marketplace_engagement_rate_pct",
)


def comparison_sql(with_clause: str) -> str:
    deltas = ", ".join(f"{delta('c.' + n, 'b.' + n)} AS {n}_delta_pct" for n in COMPARED_KPIS)
    return f"""{with_clause} SELECT {deltas} FROM (SELECT * FROM k WHERE period = 'current') c
      LEFT JOIN (SELECT * FROM k WHERE period = 'previous') b ON true"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def board(key: str, count: str, where: str, out: str, k: int) -> str:
    return with_(
        WINDOWED,
        f"""SELECT "{out}", "{count}" FROM (SELECT {key} AS "{out}", count(*) AS "{count}", min(received_at) AS f
          FROM w WHERE {where} GROUP BY 1) ORDER BY "{count}" DESC, f, "{out}" LIMIT {k}""",
    )


def trends(fmt: str) -> str:
    return with_(
        WINDOWED,
        f"""SELECT label, CAST(sum(e) AS BIGINT) AS events, CAST(sum(s) AS BIGINT) AS sessions,
          CAST(sum(f) AS BIGINT) AS form_submissions FROM (
          SELECT strftime(received_at, '{fmt}') AS label, 1 AS e, 0 AS s,
            CASE WHEN event_name IN {FORM} THEN 1 ELSE 0 END AS f FROM w
          UNION ALL SELECT strftime(min(received_at), '{fmt}'), 0, 1, 0 FROM w GROUP BY session_key) GROUP BY label""",
    )


def funnel_rows() -> str:
    steps = [s for s, _ in tx.FUNNEL_STEPS]
    selects = []
    for i, (step, label) in enumerate(tx.FUNNEL_STEPS):
        earlier = ", ".join(f"nullif({s}, 0)" for s in reversed(steps[:i]))
        base = f"coalesce({earlier}{', ' if earlier else ''}nullif(n, 0), 1)"
        selects.append(
            f"SELECT {i + 1} AS position, '{step}' AS step, '{label}' AS label, {step} AS sessions, {pct(step, base)} AS rate_pct FROM t"
        )
    counts = ", ".join(f"count(*) FILTER (WHERE {s}) AS {s}" for s in steps)
    return f"t AS (SELECT count(*) AS n, {counts} FROM s)", " UNION ALL ".join(selects)


FUNNEL_T, FUNNEL_SELECT = funnel_rows()

PATHS = f"""views AS (
  SELECT session_key, trim(coalesce(nullif(page_path, ''), json_extract_string(properties_json, '$.path')), {SPACES}) AS page,
    received_at FROM w WHERE event_name = '$pageview'),
distinct_views AS (SELECT session_key, page, min(received_at) AS f FROM views WHERE page <> '' GROUP BY 1, 2),
firsts AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY f, page) AS rn FROM distinct_views),
paths AS (SELECT session_key, string_agg(page, ' → ' ORDER BY rn) AS path FROM firsts WHERE rn <= 3 GROUP BY 1),
conv AS (SELECT session_key, bool_or(event_name IN {FORM}) AS c, min(received_at) AS f FROM w GROUP BY 1),
path_counts AS (SELECT path, count(*) AS sessions, count(*) FILTER (WHERE c) AS converted, min(f) AS f
  FROM paths JOIN conv USING (session_key) GROUP BY path)"""

CONVERT = f"""conversions AS (
  SELECT greatest(0, epoch_us(submitted_at) - epoch_us(started_at)) / 1000000.0 AS d FROM s WHERE submitted_at IS NOT NULL)"""
BUCKETS = ", ".join(
    f"count(*) FILTER (WHERE d >= {low}" + (f" AND d < {high}" if high is not None else "") + f') AS "{name}"'
    for name, _, low, high in tx.CONVERT_BUCKETS
)

VISITORS = f"""cur AS (SELECT DISTINCT anonymous_id FROM p WHERE period = 'current' AND nullif(anonymous_id, '') IS NOT NULL),
prev AS (SELECT DISTINCT anonymous_id FROM p WHERE period = 'previous' AND nullif(anonymous_id, '') IS NOT NULL),
mix AS (SELECT (SELECT count(*) FROM cur WHERE anonymous_id IN (SELECT anonymous_id FROM prev)) AS "returning",
  (SELECT count(*) FROM cur WHERE anonymous_id NOT IN (SELECT anonymous_id FROM prev)) AS new_visitors,
  (SELECT count(DISTINCT session_key) FROM p WHERE period = 'current' AND nullif(anonymous_id, '') IS NULL) AS unknown),
mixed AS (SELECT *, "returning" + new_visitors + unknown AS total FROM mix)"""

BPS = f"bp AS (SELECT *, {first_prop(tx.BLUEPRINT_KEYS)} AS blueprint FROM w WHERE event_name IN {BLUEPRINT})"

USER_EVENTS = "e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, epoch_us(ts) AS us FROM events)"
GAP_SQL = f"""WITH {USER_EVENTS},
l AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS idle FROM e),
n AS (SELECT *, sum(CASE WHEN idle IS NULL OR idle > 21600000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM l)
SELECT user_id, CAST(no AS BIGINT) AS session_no, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events
FROM n GROUP BY user_id, no"""
AGE_SQL = f"""WITH RECURSIVE {USER_EVENTS},
starts AS (
  SELECT user_id, 1 AS no, min(us) AS at FROM e GROUP BY user_id
  UNION ALL
  SELECT starts.user_id, starts.no + 1, min(e.us) FROM starts
  JOIN e ON e.user_id = starts.user_id AND e.us >= starts.at + 86400000000 GROUP BY starts.user_id, starts.no)
SELECT e.user_id, CAST(s.no AS BIGINT) AS session_no, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events
FROM e JOIN starts s ON s.user_id = e.user_id AND e.us >= s.at AND e.us < s.at + 86400000000
GROUP BY e.user_id, s.no"""


def rate_sql(source: str, window_min: int, slide_min: int, by: str = "") -> str:
    """Sliding windows: every event falls into window / slide of them."""
    slide, length = slide_min * 60_000_000, window_min * 60
    return f"""SELECT make_timestamp(a * {slide}) AS window_start, make_timestamp(a * {slide}) + INTERVAL {window_min} MINUTE AS window_end,
      {by}count(*) AS events, count(*) / {length}.0 AS per_second, count(*) / {length}.0 * 60 AS per_minute
    FROM (SELECT *, unnest(generate_series(epoch_us(received_at) // {slide} - {window_min // slide_min - 1},
      epoch_us(received_at) // {slide})) AS a FROM {source}) GROUP BY a{', ' + by.rstrip(', ') if by else ''}"""


BOUNDS = tx.PUBLISH_LATENCY_BOUNDS
ATTEMPTS = """att AS (SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, value / 10 AS duration_s, ts FROM events)"""


def histogram(by: str = "") -> str:
    arms = [f"SELECT {by}CAST({b} AS DOUBLE) AS le, count(*) FILTER (WHERE duration_s <= {b}) AS cumulative, count(*) AS count, sum(duration_s) AS sum FROM att" + (f" GROUP BY {by.rstrip(', ')}" if by else "") for b in BOUNDS]
    arms.append(f"SELECT {by}CAST('Infinity' AS DOUBLE), count(*), count(*), sum(duration_s) FROM att" + (f" GROUP BY {by.rstrip(', ')}" if by else ""))
    return "h AS (" + " UNION ALL ".join(arms) + ")"


def quantile_sql(q: float, by: str = "") -> str:
    part = f"PARTITION BY {by.rstrip(', ')} " if by else ""
    return f"""WITH {ATTEMPTS}, {histogram(by)},
b AS (SELECT *, count * {q} AS rank, coalesce(lag(le) OVER ({part}ORDER BY le), 0) AS low,
  coalesce(lag(cumulative) OVER ({part}ORDER BY le), 0) AS below FROM h)
SELECT {by}CAST({q} AS DOUBLE) AS q, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (cumulative - below) END, 5) AS value
FROM b WHERE cumulative >= rank QUALIFY row_number() OVER ({part}ORDER BY le) = 1"""


COUNTERS = f"""{COMPONENTS},
made AS (SELECT event_name, component, count(*) AS n FROM evc GROUP BY 1, 2),
taken AS (SELECT event_name, component, count(*) AS n FROM evc WHERE kafka_partition < 2 GROUP BY 1, 2)"""

KEPT = "event_id, event_name, kafka_partition, kafka_offset, received_at, session_key"
RECENT_ORDER = "received_at DESC, kafka_partition DESC, kafka_offset DESC, event_id DESC"
LIVE = f"""event_name, event_timestamp, user_id, page_path, component, properties_json, received_at AS kafka_timestamp, received_at,
  event_id, project_id, anonymous_id, session_id, source"""


def utm_sql(key: str) -> str:
    return f"nullif(url_decode(regexp_extract(split_part(url, '#', 1), '[?&]utm_{key}=([^&]*)', 1)), '')"


def report_sql() -> str:
    """The flat report, 15 days against the 15 before."""
    current = f"""{COMPARED}, w AS (SELECT * FROM p WHERE period = 'current'),
{kpi_sql('p', 'period, ')},
sc AS (SELECT * FROM s WHERE period = 'current'), t AS ({FUNNEL_T.split(' AS (', 1)[1][:-1].replace('FROM s', 'FROM sc')}),
f AS ({FUNNEL_SELECT}),
{PATHS}, {CONVERT.replace('FROM s ', 'FROM sc ')}, {VISITORS}"""

    def top(panel, key, where, k, metric):
        return f"""SELECT '{panel}' AS panel, label, '{metric}' AS metric, CAST(n AS DOUBLE) AS value FROM (
          SELECT {key} AS label, count(*) AS n, min(received_at) AS o FROM w WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT {k})"""

    def single(panel, columns, source):
        return [f"SELECT '{panel}', '', '{c}', CAST({e} AS DOUBLE) FROM {source}" for c, e in columns.items()]

    label = "strftime({}, '%Y-%m-%d')"
    parts = [
        "SELECT 'funnel' AS panel, step AS label, 'sessions' AS metric, CAST(sessions AS DOUBLE) AS value FROM f",
        "SELECT 'funnel', step, 'rate_pct', rate_pct FROM f",
        *[
            f"""SELECT 'activity_trends', label, '{m}', CAST(sum({c}) AS DOUBLE) FROM (
              SELECT {label.format('received_at')} AS label, 1 AS e, 0 AS s, CASE WHEN event_name IN {FORM} THEN 1 ELSE 0 END AS f FROM w
              UNION ALL SELECT {label.format('first_at')}, 0, 1, 0 FROM sc) GROUP BY label"""
            for m, c in (("events", "e"), ("sessions", "s"), ("form_submissions", "f"))
        ],
        top("cta_leaderboard", f"event_name || coalesce(' · ' || {first_prop(tx.CTA_KEYS)}, '')", f"event_name IN {names(tx.CTA_LEADERBOARD)}", 8, "clicks"),
        top("faq_leaderboard", f"coalesce({prop('question')}, event_name)", f"event_name IN {names(tx.FAQ)}", 8, "opens"),
        top("engine_leaderboard", f"coalesce({first_prop(tx.ENGINE_KEYS)}, event_name)", f"event_name IN {names(tx.PLAYGROUND)}", 8, "interactions"),
        top("blueprint_leaderboard", first_prop(tx.BLUEPRINT_KEYS), f"event_name IN {BLUEPRINT} AND {first_prop(tx.BLUEPRINT_KEYS)} IS NOT NULL", 8, "interactions"),
        top("top_pages", "page_path", "event_name = '$pageview' AND nullif(page_path, '') IS NOT NULL", 8, "views"),
        top("top_events", "event_name", "true", 10, "count"),
        *[
            f"""SELECT 'top_paths', path, '{m}', CAST({e} AS DOUBLE) FROM (
              SELECT * FROM path_counts ORDER BY sessions DESC, converted DESC, f, path LIMIT 8)"""
            for m, e in (("sessions", "sessions"), ("converted", "converted"), ("conversion_rate_pct", pct("converted", "sessions")))
        ],
        *single("kpis", {c: c for c in (
            "sessions", "actors", "identified_users", "form_submissions", "conversion_rate_pct",
            "marketplace_engagement_rate_pct", "multi_page_session_rate_pct", "engaged_session_rate_pct")},
            "(SELECT * FROM k WHERE period = 'current')"),
        *single("kpi_comparison", {f"{n}_delta_pct": delta("c." + n, "b." + n) for n in COMPARED_KPIS},
                "(SELECT * FROM k WHERE period = 'current') c LEFT JOIN (SELECT * FROM k WHERE period = 'previous') b ON true"),
        *single("time_to_convert", {
            "converted_sessions": "count(*)", "median_seconds": "round_even(quantile_cont(d, 0.5), 1)",
            **{n: f"count(*) FILTER (WHERE d >= {low}" + (f" AND d < {high}" if high is not None else "") + ")"
               for n, _, low, high in tx.CONVERT_BUCKETS}}, "conversions"),
        *single("visitor_mix", {
            "returning": '"returning"', "new_visitors": "new_visitors", "unknown": "unknown", "total": "total",
            "returning_rate_pct": pct('"returning"', "greatest(total, 1)"),
            "new_visitor_rate_pct": pct("new_visitors", "greatest(total, 1)")}, "mixed"),
        *single("session_summary", {
            "total": "count(*)", "converted": "count(*) FILTER (WHERE form_submit)",
            "not_converted": "count(*) FILTER (WHERE NOT form_submit)",
            "anonymous_only": "count(*) FILTER (WHERE user_display IS NULL)",
            "identified": "count(*) FILTER (WHERE user_display IS NOT NULL)"}, "sc"),
    ]
    wrapped = [f"SELECT * FROM ({x}) x{i}" for i, x in enumerate(parts)]
    return with_(current, "\nUNION ALL\n".join(wrapped))


def sql() -> dict[str, str]:
    out = {
        "canonical_events": with_(COMPONENTS, """SELECT event_id, project_id, event_name, properties_json, event_timestamp, source,
          user_id, anonymous_id, session_id, page_path, kafka_partition, kafka_offset, received_at, session_key, actor_key, component FROM evc"""),
        "parse_envelope": with_(PARSED, """SELECT event_id, project_id, event_name, properties_json, event_timestamp, source, user_id,
          anonymous_id, session_id, page_path, kafka_partition, kafka_offset, kafka_timestamp, raw_payload, is_bad FROM parsed"""),
        "parse_envelope_lenient": with_(f"""{MESSAGES},
          live AS (SELECT message AS raw, coalesce(nullif({wire('name')}, ''), 'unknown') AS event_name, {WIRE_TIME} AS event_timestamp,
            {', '.join(f"{wire(c)} AS {c}" for c in ('user_id', 'page_path', 'event_id', 'project_id', 'anonymous_id', 'session_id', 'source'))},
            coalesce({WIRE_OBJECT.format(f='properties')}, '{{}}') AS properties_json, {WIRE_OBJECT.format(f='context')} AS context_json,
            "partition" AS kafka_partition, "offset" AS kafka_offset, event_timestamp AS received_at FROM obj)""",
            f"SELECT *, {component()} AS component FROM live"),
        "quarantined_messages": with_(PARSED, "SELECT kafka_partition, kafka_offset, kafka_timestamp, raw_payload FROM parsed WHERE is_bad"),
        "validate_envelope": with_(MESSAGES, f"""SELECT "partition", "offset", array_to_string(list_filter([
            CASE WHEN j IS NULL THEN 'not_an_object' END,
            CASE WHEN j IS NOT NULL AND coalesce({wire('name')}, '') = '' THEN 'name_missing' END,
            CASE WHEN length({wire('name')}) > 200 THEN 'name_too_long' END,
            {', '.join(f"CASE WHEN length({wire(c)}) > 128 THEN '{c}_too_long' END" for c in ('event_id', 'project_id', 'anonymous_id', 'session_id'))},
            {', '.join(f"CASE WHEN {wire(c)} IS NOT NULL AND json_type(j, '$.{c}') <> 'OBJECT' THEN '{c}_not_an_object' END" for c in ('properties', 'context'))},
            CASE WHEN NOT regexp_full_match({wire('timestamp')}, '[+-]?\\d+(\\.0+)?') THEN 'timestamp_not_an_integer' END
          ], lambda x: x IS NOT NULL), ',') AS failed_rules FROM obj"""),
        "normalize_envelope": with_(PARSED, """SELECT kafka_partition, kafka_offset, event_id,
          coalesce(nullif(event_timestamp, 0), 1706659200000) AS event_timestamp, coalesce(source, 'web') AS source, session_id FROM good"""),
        "dedupe_events": with_(PARSED, f"SELECT {KEPT} FROM firsts"),
        "load_metrics": with_(PARSED, """SELECT (SELECT count(*) FROM good) AS rows_read, (SELECT count(*) FROM firsts) AS events_after_dedupe,
          CAST(30 AS INTEGER) AS window_days"""),
        "super_properties": with_(EV, """SELECT event_id, array_to_string(list_sort(list_transform(json_keys(j),
            lambda x: x || '=' || json_extract_string(j, '$.' || x))), ',') AS properties
          FROM (SELECT event_id, json_merge_patch('{"label":"registered","site":"web"}', properties_json) AS j FROM ev)"""),
        "identify_events": with_(EV, """SELECT event_id, 'user_identified' AS event_name, array_to_string(list_sort(list_transform(json_keys(j),
            lambda x: x || '=' || json_extract_string(j, '$.' || x))), ',') AS properties
          FROM (SELECT event_id, json_merge_patch(json_object('userId', user_id), properties_json) AS j FROM ev WHERE nullif(user_id, '') IS NOT NULL)"""),
        "publish_messages": with_(EV, """SELECT event_id, event_name, user_id, session_id, page_path,
          CAST(2 + CASE WHEN user_id IS NULL THEN 0 ELSE 1 END + CASE WHEN session_id IS NULL THEN 0 ELSE 1 END
            + CASE WHEN page_path IS NULL THEN 0 ELSE 1 END AS INTEGER) AS fields FROM ev"""),
        "event_classes": with_(EV, "SELECT event_id, " + ", ".join(
            f"event_name IN {names(v)} AS is_{c}" for c, v in (
                ("form_submit", tx.FORM_SUBMIT), ("marketplace", tx.MARKETPLACE), ("marketplace_browse", tx.MARKETPLACE_BROWSE),
                ("blueprint_interaction", tx.BLUEPRINT_INTERACTION), ("doc_view", tx.DOC_VIEW), ("cta", tx.CTA),
                ("cta_leaderboard", tx.CTA_LEADERBOARD), ("faq", tx.FAQ), ("playground", tx.PLAYGROUND), ("identify", tx.IDENTIFY))) + " FROM ev"),
        "funnel": with_(f"{SESSIONS}, {FUNNEL_T}", FUNNEL_SELECT),
        "kpis": with_(f"{WINDOWED}, {kpi_sql('w')}", "SELECT * FROM k"),
        "kpi_comparison": "WITH " + comparison_sql(f"{COMPARED}, {kpi_sql('p', 'period, ')}"),
        "kpi_comparison_half": "WITH " + comparison_sql(f"""{EV}, p AS (SELECT *, 'current' AS period FROM ev WHERE received_at >= {WHOLE_FROM}
          UNION ALL SELECT *, 'previous' FROM ev WHERE received_at >= {WHOLE_FROM} AND received_at < {MIDDLE}), {kpi_sql('p', 'period, ')}"""),
        "compare_periods": with_(f"{COMPARED}, {kpi_sql('p', 'period, ')}", "SELECT " + ", ".join(
            f"c.{n} AS {n}, b.{n} AS {n}_previous, {delta('c.' + n, 'b.' + n)} AS {n}_delta_pct"
            for n in ("sessions", "actors", "form_submissions")) + """ FROM (SELECT * FROM k WHERE period = 'current') c
            LEFT JOIN (SELECT * FROM k WHERE period = 'previous') b ON true"""),
        "activity_trends_daily": trends("%Y-%m-%d"),
        "activity_trends_hourly": trends("%Y-%m-%d %H:00"),
        "activity_heatmap": with_(f"""{WINDOWED}, c AS (SELECT isodow(received_at) - 1 AS d, hour(received_at) AS h, count(*) AS n FROM w GROUP BY 1, 2),
          g AS (SELECT d, h FROM range(7) a(d), range(24) b(h))""", f"""SELECT CAST(g.d AS INTEGER) AS weekday,
          [{', '.join(f"'{x}'" for x in tx.WEEKDAYS)}][g.d + 1] AS day, CAST(g.h AS INTEGER) AS hour, coalesce(n, 0) AS events,
          (SELECT max(n) FROM c) AS max_count FROM g LEFT JOIN c ON c.d = g.d AND c.h = g.h"""),
        "top_pages": board("page_path", "views", "event_name = '$pageview' AND nullif(page_path, '') IS NOT NULL", "path", 8),
        "top_events": board("event_name", "count", "true", "name", 10),
        "cta_leaderboard": board(f"event_name || coalesce(' · ' || {first_prop(tx.CTA_KEYS)}, '')", "clicks", f"event_name IN {names(tx.CTA_LEADERBOARD)}", "label", 8),
        "faq_leaderboard": board(f"coalesce({prop('question')}, event_name)", "opens", f"event_name IN {names(tx.FAQ)}", "question", 8),
        "engine_leaderboard": board(f"coalesce({first_prop(tx.ENGINE_KEYS)}, event_name)", "interactions", f"event_name IN {names(tx.PLAYGROUND)}", "engine", 8),
        "blueprint_leaderboard": board(first_prop(tx.BLUEPRINT_KEYS), "interactions", f"event_name IN {BLUEPRINT} AND {first_prop(tx.BLUEPRINT_KEYS)} IS NOT NULL", "blueprint", 8),
        "blueprint_treemap": with_(f"""{WINDOWED}, {BPS}, box AS (SELECT blueprint, count(*) AS boxed, min(received_at) AS f
          FROM bp WHERE blueprint IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 12)""",
          """SELECT blueprint, boxed AS value, (SELECT count(*) FROM bp WHERE blueprint IS NOT NULL) AS total,
          round(boxed / (SELECT count(*) FROM bp WHERE blueprint IS NOT NULL) * 100, 1) AS share_pct, event_name AS event,
          regexp_replace(event_name, '^(marketplace_|blueprint_)', '') AS event_label, count(*) AS event_value
          FROM bp JOIN box USING (blueprint) GROUP BY blueprint, boxed, event_name"""),
        "top_paths": with_(f"{WINDOWED}, {PATHS}", f"""SELECT path, sessions, converted, {pct('converted', 'sessions')} AS conversion_rate_pct
          FROM path_counts ORDER BY sessions DESC, converted DESC, f, path LIMIT 8"""),
        "time_to_convert": with_(f"{SESSIONS}, {CONVERT}", f"SELECT count(*) AS converted_sessions, {BUCKETS}, round_even(quantile_cont(d, 0.5), 1) AS median_seconds FROM conversions"),
        "time_to_convert_buckets": with_(f"{SESSIONS}, {CONVERT}, b AS (SELECT {BUCKETS} FROM conversions)", " UNION ALL ".join(
            f"SELECT '{n}' AS id, '{label}' AS label, \"{n}\" AS sessions FROM b" for n, label, _, _ in tx.CONVERT_BUCKETS)),
        "visitor_mix": with_(f"{COMPARED}, {VISITORS}", f"""SELECT "returning", new_visitors, unknown, total,
          {pct('"returning"', 'greatest(total, 1)')} AS returning_rate_pct, {pct('new_visitors', 'greatest(total, 1)')} AS new_visitor_rate_pct FROM mixed"""),
        "returning_visitors": with_(f"{COMPARED}, {VISITORS}", "SELECT anonymous_id FROM cur INTERSECT SELECT anonymous_id FROM prev"),
        "new_visitors": with_(f"{COMPARED}, {VISITORS}", "SELECT anonymous_id FROM cur EXCEPT SELECT anonymous_id FROM prev"),
        "session_rows": with_(ROWS_OUT, "SELECT * FROM r"),
        "session_pages": with_(SESSIONS, "SELECT session_key, page_path, first_seen_at FROM page_first"),
        "newest_sessions": with_(ROWS_OUT, "SELECT * FROM r ORDER BY last_activity_at DESC, session_id LIMIT 50"),
        "session_filter_modes": with_(ROWS_OUT, " UNION ALL ".join(
            f"SELECT '{m}' AS mode, count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events FROM r WHERE {c}" for m, c in (
                ("all", "true"), ("converted", "converted"), ("not_converted", "NOT converted"),
                ("anonymous", "user_display IS NULL"), ("identified", "user_display IS NOT NULL")))),
        "session_status": with_(ROWS_OUT, """SELECT session_id, CASE WHEN converted THEN 'Converted' WHEN marketplace_engaged THEN 'Engaged'
          ELSE 'Browsing' END AS status FROM r"""),
        "session_summary": with_(ROWS_OUT, """SELECT count(*) AS total, count(*) FILTER (WHERE converted) AS converted,
          count(*) FILTER (WHERE NOT converted) AS not_converted, count(*) FILTER (WHERE user_display IS NULL) AS anonymous_only,
          count(*) FILTER (WHERE user_display IS NOT NULL) AS identified FROM r"""),
        "recent_converters": with_(SESSIONS, """SELECT session_key AS session_id, form_event AS event_name, submitted_at, email_masked,
          submit_user.u AS user_id, CASE WHEN page_count = 0 THEN '' ELSE pages END AS pages, event_count,
          greatest(0, epoch_us(submitted_at) - epoch_us(started_at)) / 1000000.0 AS time_to_convert_seconds
          FROM s LEFT JOIN page_lists USING (session_key) WHERE form_submit ORDER BY submitted_at DESC, session_key LIMIT 20"""),
        "insights_report": report_sql(),
        "sessionize_gap": GAP_SQL,
        "sessionize_fixed": AGE_SQL,
        "live_stats": with_(WINDOWED, f"""SELECT 'name' AS scope, event_name AS name, count(*) AS events,
          round_even(count(*) / {WHOLE}.0 * 60, 2) AS rate_per_minute, CAST({WHOLE} AS INTEGER) AS window_seconds FROM w GROUP BY event_name
          UNION ALL SELECT 'all', NULL, count(*), round_even(count(*) / {WHOLE}.0 * 60, 2), {WHOLE} FROM w"""),
        "live_stats_quiet": with_(EV, """SELECT 'all' AS scope, CAST(NULL AS VARCHAR) AS name, count(*) AS events, CAST(0 AS DOUBLE) AS rate_per_minute,
          CAST(60 AS INTEGER) AS window_seconds FROM ev WHERE received_at >= TIMESTAMP '2029-12-31 23:59:00'"""),
        "event_page_wide": with_(EV, f"SELECT event_id, event_name FROM ev ORDER BY {RECENT_ORDER} LIMIT 450"),
        "distinct_names": with_(EV, "SELECT DISTINCT event_name AS name FROM ev WHERE event_name <> ''"),
        "live_projection": with_(COMPONENTS, f"SELECT {LIVE} FROM evc"),
        "legacy_projection": with_(EV, "SELECT properties_json AS message, event_name AS name, received_at AS kafka_timestamp, received_at FROM ev"),
        "event_page": with_(COMPONENTS, f"SELECT {LIVE} FROM (SELECT * FROM evc WHERE event_name = '$pageview' ORDER BY {RECENT_ORDER} LIMIT 50 OFFSET 100)"),
        "event_page_meta": with_(EV, """SELECT CAST(50 AS INTEGER) AS "limit", CAST(100 AS INTEGER) AS "offset",
          greatest(0, least(50, count(*) - 100)) AS returned, count(*) AS total_matched FROM ev WHERE event_name = '$pageview'"""),
        "filter_by_user": with_(EV, "SELECT event_id, event_name, user_id FROM ev WHERE user_id = 'user12@example.com'"),
        "new_since": with_(EV, f"""SELECT event_id, row_number() OVER (ORDER BY {RECENT_ORDER}) <= 50 AS is_new
          FROM ev ORDER BY {RECENT_ORDER} LIMIT 100"""),
        "live_snapshot": with_(COMPONENTS, f"""SELECT event_id, event_name, component, received_at, least(20, greatest(0, n - 10)) AS returned,
          n AS total_matched, (SELECT count(*) FROM ev WHERE received_at >= {WHOLE_FROM}) AS events_in_window
          FROM (SELECT *, count(*) OVER () AS n FROM evc WHERE event_name = 'faq_opened' ORDER BY {RECENT_ORDER} LIMIT 20 OFFSET 10)"""),
        "pageview_split": with_(EV, """SELECT count(*) FILTER (WHERE event_name = '$pageview') AS pageviews,
          count(*) FILTER (WHERE event_name <> '$pageview') AS custom_events FROM ev"""),
        "rates": with_(EV, rate_sql("ev", 5, 1)),
        "rates_by_type": with_(EV, rate_sql("ev", 60, 15, "event_name, ")),
        "event_counters": with_(COUNTERS, "SELECT event_name, component, n AS total FROM made"),
        "publish_outcomes": with_(ATTEMPTS, "SELECT status, count(*) AS total FROM att GROUP BY status"),
        "latency_histogram": with_(f"{ATTEMPTS}, {histogram()}", """SELECT CASE WHEN isinf(le) THEN 'Infinity' ELSE CAST(le AS VARCHAR) END AS le,
          cumulative, count, round(sum, 4) AS sum FROM h"""),
        "histogram_quantile": quantile_sql(0.95),
        "histogram_quantile_by_status": quantile_sql(0.5, "status, "),
        "events_by_type": with_(EV, f"""SELECT event_name, count(*) AS total,
          round(count(*) FILTER (WHERE received_at >= {MIDDLE}) / {HALF}.0, 8) AS per_second FROM ev GROUP BY event_name"""),
        "top_components": with_(COMPONENTS, """SELECT event_name, component, count(*) AS total FROM evc WHERE component <> '-'
          GROUP BY 1, 2 ORDER BY 3 DESC, min(received_at), 1, 2 LIMIT 12"""),
        "component_rate": with_(COMPONENTS, f"""SELECT component, round(count(*) / {WHOLE}.0, 8) AS per_second FROM evc
          WHERE component <> '-' AND received_at >= {WHOLE_FROM} GROUP BY component"""),
        "error_rate": with_(ATTEMPTS, f"""SELECT round(count(*) / {WHOLE}.0, 8) AS attempts_per_second,
          round(count(*) FILTER (WHERE status = 'error') / {WHOLE}.0, 8) AS errors_per_second,
          round(count(*) FILTER (WHERE status = 'error') / count(*), 8) AS error_ratio FROM att WHERE ts >= {WHOLE_FROM}"""),
        "throughput": with_(WINDOWED, f"SELECT round(count(*) / {WHOLE}.0, 8) AS per_second FROM w"),
        "metric_samples": with_(COUNTERS, """SELECT CAST(0 AS INTEGER) AS source_rank, 'clicks_events_total' AS metric, CAST(n AS DOUBLE) AS value, event_name, component FROM made
          UNION ALL SELECT 1, 'clicks_events_total', CAST(n AS DOUBLE), event_name, component FROM taken"""),
        "latest_samples": with_(COUNTERS, """SELECT 'clicks_events_total' AS metric,
          'component=' || made.component || ',event_name=' || made.event_name AS label_text,
          CAST(coalesce(taken.n, made.n) AS DOUBLE) AS value, CAST(CASE WHEN taken.n IS NULL THEN 0 ELSE 1 END AS INTEGER) AS source_rank
          FROM made LEFT JOIN taken USING (event_name, component)"""),
        "rule_classify": """SELECT p_partkey, p_name,
          CASE WHEN lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%' THEN 'Fasteners' WHEN lower(p_name) LIKE '%gear%' THEN 'Drive'
            WHEN lower(p_name) LIKE '%widget%' THEN 'Parts' ELSE 'Platform' END AS category,
          CASE WHEN lower(p_name) LIKE '%red%' THEN 'RD' WHEN lower(p_name) LIKE '%blue%' THEN 'BL' WHEN lower(p_name) LIKE '%ring%' THEN 'RG'
            ELSE upper(left(p_name, 2)) END AS icon FROM part""",
        "lookup_dimension": """SELECT s_suppkey, coalesce(n_name, s_name) AS n_name, coalesce(r_name, 'unknown') AS r_name FROM supplier
          LEFT JOIN nation ON n_nationkey = s_nationkey AND s_acctbal >= 0 LEFT JOIN region ON r_regionkey = n_regionkey""",
        "lookup_item": "SELECT p_partkey, p_name, p_size FROM part WHERE p_name = 'small ring' ORDER BY p_size DESC, p_partkey LIMIT 1",
        "preferred_topk": "SELECT p_partkey, p_name, p_size <= 3 AS popular FROM part ORDER BY p_size <= 3 DESC, lower(p_name), p_partkey LIMIT 20",
        "first_by_title": "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 3",
        "prefix_key": """SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'group-one' WHEN p_brand LIKE 'Brand#2%' THEN 'group-two' END AS key FROM part""",
        "event_table_scan": with_(WINDOWED, """SELECT event_id, project_id, event_name, properties_json, event_timestamp, source, user_id,
          anonymous_id, session_id, raw_path AS page_path, kafka_partition, kafka_offset, received_at AS ingested_at
          FROM w JOIN (SELECT event_id, page_path AS raw_path FROM clicks) USING (event_id)"""),
        "load_history": with_(PARSED, f"SELECT {KEPT} FROM firsts"),
        "verify_table": with_(EV, f"""SELECT event_id, event_name, received_at AS ingested_at, (SELECT count(*) FROM ev) AS row_count
          FROM ev ORDER BY {RECENT_ORDER} LIMIT 10"""),
        "ingest_status": with_(EV, """SELECT 'partition' AS scope, kafka_partition, count(*) AS row_count, max(received_at) AS last_ingested_at,
          max(kafka_offset) + 1 AS next_offset FROM ev GROUP BY kafka_partition
          UNION ALL SELECT 'table', NULL, count(*), max(received_at), NULL FROM ev"""),
        "ingest_status_empty": with_(EV, """SELECT 'table' AS scope, CAST(NULL AS INTEGER) AS kafka_partition, count(*) AS row_count,
          max(received_at) AS last_ingested_at, CAST(NULL AS BIGINT) AS next_offset FROM ev WHERE event_name = 'no such event'"""),
        "ingest_lag": with_(MESSAGES, """SELECT kafka_partition, end_offset, next_offset, greatest(0, end_offset - next_offset) AS lag
          FROM (SELECT "partition" AS kafka_partition, max("offset") + 1 AS end_offset FROM msg GROUP BY 1)
          JOIN (SELECT kafka_partition, max(kafka_offset) + 1 AS next_offset FROM clicks GROUP BY 1) USING (kafka_partition)"""),
        "reconcile_ingest": with_(EV, """SELECT count(*) FILTER (WHERE received_at < TIMESTAMP '2024-01-24') AS rows_before, count(*) AS rows_after,
          count(*) FILTER (WHERE received_at >= TIMESTAMP '2024-01-24') AS delta,
          count(*) FILTER (WHERE received_at >= TIMESTAMP '2024-01-24') > 0 AS ok FROM ev"""),
        "offset_gaps": with_(PARSED, """SELECT kafka_partition, min(kafka_offset) AS first_offset, max(kafka_offset) AS last_offset,
          count(DISTINCT kafka_offset) AS offsets, count(*) - count(DISTINCT kafka_offset) AS repeated,
          max(kafka_offset) - min(kafka_offset) + 1 - count(DISTINCT kafka_offset) AS missing FROM good GROUP BY kafka_partition"""),
        "mask_email": with_(EV, f"SELECT event_id, {mask(EMAIL)} AS email_masked, {mask('user_id')} AS user_masked FROM ev"),
        "event_component": with_(COMPONENTS, "SELECT event_id, component FROM evc"),
        "sanitize_label": f"SELECT doc_id, {sanitize('text')} AS label FROM documents",
        "truncate_id": with_(EV, "SELECT event_id, CASE WHEN length(session_key) > 9 THEN left(session_key, 9) || '…' ELSE session_key END AS short FROM ev"),
        "utm": "SELECT page_id, " + ", ".join(f"{utm_sql(k)} AS utm_{k}" for k in ("source", "medium", "campaign", "term", "content")) + " FROM pages",
        "parse_time": with_(EV, """SELECT event_id, CASE kafka_offset % 5 WHEN 0 THEN make_timestamp(epoch_us(received_at) // 1000 * 1000)
          WHEN 2 THEN received_at WHEN 4 THEN NULL ELSE date_trunc('second', received_at) END AS parsed_at FROM ev"""),
        "context_fields": f"""SELECT page_id, 'test' AS browser, 'en' AS locale, url AS referrer,
          regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS pathname, {utm_sql('source')} AS utm_source FROM pages""",
        "parse_envelope_strict": with_(PARSED, """SELECT event_id, project_id, event_name, properties_json, event_timestamp, source, user_id,
          anonymous_id, session_id, page_path, kafka_partition, kafka_offset, kafka_timestamp, raw_payload FROM parsed WHERE NOT is_bad"""),
        "load_live": with_(PARSED, f"SELECT {KEPT} FROM firsts WHERE received_at >= {WHOLE_FROM}"),
        "sql_functions_on_text": f"""WITH d AS (SELECT *, chr(9) || chr(160) || text || chr(8195) || chr(10) AS wide FROM documents)
          SELECT doc_id, {sanitize('wide')} AS label, {mask('wide')} AS masked,
            coalesce(nullif(lang, ''), 'anon:' || nullif(source, ''), 'evt:' || CAST(doc_id AS VARCHAR)) AS key,
            {pct('n_chars', '1000')} AS share FROM d""",
        "report_halves": "WITH " + comparison_sql(f"""{EV}, p AS (SELECT *, CASE WHEN received_at >= {MIDDLE} THEN 'current' ELSE 'previous' END
          AS period FROM ev WHERE received_at >= {WHOLE_FROM}), {kpi_sql('p', 'period, ')}"""),
        "report_hourly": trends("%Y-%m-%d %H:00").replace(WHOLE_FROM, "TIMESTAMP '2024-01-30 04:00:00'"),
        "stream_windows": with_(EV, rate_sql("ev", 60, 15)),
        "stream_snapshot": with_(EV, f"""SELECT event_id, event_name, 'stopped' AS status, (SELECT count(*) FROM ev) AS total_received,
          (SELECT least(200, count(*)) FROM ev) AS buffer_used, (SELECT least(200, count(*)) FROM ev) AS total_matched
          FROM ev ORDER BY {RECENT_ORDER} LIMIT 20"""),
        "stream_latest_n": with_(EV, f"""SELECT event_id, event_name, received_at, (SELECT count(*) FROM ev) AS total_received
          FROM ev ORDER BY {RECENT_ORDER} LIMIT 200"""),
        "stream_dedupe": with_(PARSED, """SELECT DISTINCT event_id, CASE WHEN event_id IS NULL THEN kafka_partition END AS kafka_partition,
          CASE WHEN event_id IS NULL THEN kafka_offset END AS kafka_offset FROM g"""),
        "stream_sessions_gap": GAP_SQL.replace("CAST(no AS BIGINT) AS session_no, ", ""),
        "pipeline_status": """SELECT false AS stream_active, 'stopped' AS status, CAST(NULL AS VARCHAR) AS last_error, count(*) AS total_received,
          CAST(200 AS INTEGER) AS buffer_size, least(200, count(*)) AS buffer_used FROM events""",
    }
    out["stream_ingest"] = out["dedupe_events"]
    deep = f"""SELECT event_id, event_name, received_at FROM ev ORDER BY {RECENT_ORDER} LIMIT 40 OFFSET (SELECT count(*) * 9 // 10 FROM ev)"""
    out["event_page_deep"] = out["event_page_after"] = with_(EV, deep)
    out["latency_sketch"] = with_(ATTEMPTS, """SELECT status, CAST(0.95 AS DOUBLE) AS q, count(*) AS n, count(*) AS sketched, true AS within
      FROM att GROUP BY status""")
    out["footer_stats"] = """SELECT count(*) AS row_count, min(event_id) AS min_event_id, max(event_id) AS max_event_id,
      min(user_id) AS min_user_id, max(user_id) AS max_user_id FROM events"""
    out["stream_lag"] = """SELECT CAST(0 AS INTEGER) AS kafka_partition, count(*) AS end_offset, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-21') AS next_offset,
      count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-21') AS lag FROM events"""
    out["stream_lag_by_partition"] = out["ingest_lag"].replace("SELECT kafka_partition, end_offset", "SELECT 'clicks' AS topic, kafka_partition, end_offset")
    out["stream_late_rows"] = """WITH b AS (
      SELECT epoch_us(ts) AS us, CASE WHEN ts >= TIMESTAMP '2024-01-21' OR ts < TIMESTAMP '2024-01-11' THEN 2 WHEN ts >= TIMESTAMP '2024-01-18' THEN 1 ELSE 0 END AS batch
      FROM events), w AS (
      SELECT b.*, (SELECT max(us) FROM b o WHERE o.batch < b.batch) // 1000 * 1000 - 172800000000 AS mark FROM b), l AS (
      SELECT batch, coalesce(us <= mark, false) AS late FROM w)
      SELECT CAST(batch AS BIGINT) AS batch_id, count(*) FILTER (WHERE NOT late) AS kept, count(*) FILTER (WHERE late) AS late,
        (SELECT count(*) FROM l WHERE NOT late) AS operator_kept, (SELECT count(*) FROM l WHERE late) AS operator_late FROM l GROUP BY batch"""
    out["stream_status_totals"] = """SELECT CAST(2 AS BIGINT) AS runs, CAST(3 AS BIGINT) AS batches, count(*) AS total_received,
      CAST(0 AS BIGINT) AS late_rows, 'stopped' AS status FROM events"""
    rows = with_(EV, "SELECT event_id, event_name, kafka_partition, kafka_offset, received_at FROM ev")
    out["stream_compacted"] = out["stream_continuous"] = out["stream_to_table"] = rows
    out["stream_replayed_table"] = out["event_table_scan"]
    out["catalog_document"] = """SELECT kind, id, name, (SELECT count(*) FROM part)::INTEGER AS engine_count, (SELECT count(*) FROM supplier)::INTEGER AS blueprint_count,
      CAST(0 AS INTEGER) AS experience_count FROM (
      SELECT 'engine' AS kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part
      UNION ALL SELECT 'blueprint', CAST(s_suppkey AS VARCHAR), s_name FROM supplier)"""
    out["stream_counters"] = out["event_counters"]
    out["stream_client_clock"] = out["stream_windows"]
    out["event_component_column"] = out["event_component"]
    for panel, same in (
        ("report_heatmap", "activity_heatmap"), ("report_treemap", "blueprint_treemap"),
        ("report_converters", "recent_converters"), ("report_sessions", "session_rows"),
    ):
        out[panel] = out[same]
    out["stream_sessions_fixed"] = out["stream_sessions_state"] = out["stream_sessions_timed"] = AGE_SQL
    return out
