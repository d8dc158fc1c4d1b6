import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from clickloom.operators import envelope

GOOD = {"event_id": "1", "name": "x", "properties": {"a": 1, "b": "t", "c": {"d": [1]}}, "timestamp": 5, "session_id": "s"}
MESSAGES = {
    "good": json.dumps(GOOD),
    "malformed": "{bad",
    "array": "[1,2]",
    "empty": "",
    "two": '{"name":"a"}{"name":"b"}',
    "two_listed": '{"name":"a"},{"name":"b"}',
    "trailing": '{"name":"a"} junk',
    "single_quoted": "{'name':'q'}",
    "closes_array": '{"name":"a"}],[{"name":"b"}',
    "closes_object": '{"name":"a"}},{"m":{"name":"b"}',
    "more_keys": '{"name":"a"},"m":{"name":"b"}',
    "text_props": json.dumps({**GOOD, "properties": "text"}),
    "text_time": json.dumps({**GOOD, "timestamp": "5"}),
    "fraction_time": json.dumps({**GOOD, "timestamp": 1.5}),
    "junk_time": json.dumps({**GOOD, "timestamp": "soon"}),
    "other_name": json.dumps({"event_name": "y"}),
    "no_name": json.dumps({"event_id": "2"}),
    "empty_ids": json.dumps({"name": "x", "event_id": "", "session_id": "", "user_id": ""}),
    "number_user": json.dumps({"name": "x", "user_id": 12345}),
    "context": json.dumps({"name": "x", "context": {"browser": "b", "utm": {"source": "s"}}}),
}


BAD = {"malformed", "array", "empty", "two", "two_listed", "trailing", "single_quoted", "closes_array", "closes_object", "more_keys"}


@pytest.fixture
def messages(spark):
    rows = [(m, 0, i, None) for i, m in enumerate(MESSAGES.values())]
    return spark.createDataFrame(rows, "message string, partition int, offset long, event_timestamp timestamp")


def by_case(df):
    names = list(MESSAGES)
    return {names[r["kafka_offset"]]: r.asDict() for r in df.collect()}


def test_quarantine_keeps_every_message_and_marks_the_bad(messages):
    rows = by_case(envelope.parse_envelope(messages))
    assert {n for n, r in rows.items() if r["is_bad"]} == BAD
    assert len(rows) == len(MESSAGES)
    assert rows["malformed"]["event_name"] is None and rows["malformed"]["raw_payload"] == "{bad"
    good, bad = envelope.quarantined(envelope.parse_envelope(messages))
    assert (good.count(), bad.count()) == (len(MESSAGES) - len(BAD), len(BAD))


def test_fields_of_the_parse(messages):
    rows = by_case(envelope.parse_envelope(messages, "drop"))
    assert len(rows) == len(MESSAGES) - len(BAD)
    assert json.loads(rows["good"]["properties_json"]) == GOOD["properties"]
    assert rows["text_props"]["properties_json"] is None
    times = {n: rows[n]["event_timestamp"] for n in ("good", "text_time", "fraction_time", "junk_time")}
    assert times == {"good": 5, "text_time": 5, "fraction_time": 1, "junk_time": None}
    assert (rows["other_name"]["event_name"], rows["no_name"]["event_name"]) == ("y", "unknown")
    assert [rows["empty_ids"][c] for c in ("event_id", "session_id", "user_id")] == [None] * 3
    assert rows["number_user"]["user_id"] == "12345"


def test_keep_and_fail(messages):
    kept = by_case(envelope.parse_envelope(messages, "keep"))
    assert len(kept) == len(MESSAGES) and kept["array"]["event_name"] is None
    with pytest.raises(PySparkException, match="no JSON object"):
        envelope.parse_envelope_strict(messages).collect()
    clean = messages.where(~F.col("offset").isin([i for i, n in enumerate(MESSAGES) if n in BAD]))
    assert len(envelope.parse_envelope_strict(clean).collect()) == len(MESSAGES) - len(BAD)
    for name in BAD:
        with pytest.raises(PySparkException, match="no JSON object"):
            envelope.parse_envelope_strict(messages.where(F.col("offset") == list(MESSAGES).index(name))).collect()
    with pytest.raises(ValueError):
        envelope.parse_envelope(messages, "other")


def test_lenient_never_fails(messages):
    rows = by_case(envelope.parse_envelope_lenient(messages))
    assert len(rows) == len(MESSAGES)
    assert all(rows[n]["event_name"] == "unknown" for n in (*BAD, "other_name"))
    assert rows["empty_ids"]["session_id"] == "" and rows["text_props"]["properties_json"] == "{}"
    assert json.loads(rows["context"]["context_json"])["utm"] == {"source": "s"}


def test_validation_rules(spark):
    cases = {
        "": json.dumps(GOOD),
        "not_an_object": "[1]",
        "name_missing": '{"event_name":"x"}',
        "name_too_long": json.dumps({"name": "n" * 201}),
        "event_id_too_long": json.dumps({"name": "n", "event_id": "i" * 129}),
        "properties_not_an_object": '{"name":"n","properties":"x"}',
        "context_not_an_object": '{"name":"n","context":[1]}',
        "timestamp_not_an_integer": '{"name":"n","timestamp":1.5}',
        "name_missing,session_id_too_long": json.dumps({"name": "", "session_id": "i" * 129}),
    }
    df = spark.createDataFrame([(m, 0, i) for i, m in enumerate(cases.values())], "message string, partition int, offset long")
    checked = envelope.validate_envelope(df)
    assert [",".join(r["failed_rules"]) for r in checked.orderBy("offset").collect()] == list(cases)
    valid, rejected = envelope.split_valid(checked)
    assert (valid.count(), rejected.count()) == (1, len(cases) - 1)
    limits = df.limit(0).union(spark.createDataFrame([(json.dumps({"name": "n" * 200, "event_id": "i" * 128}), 0, 0)], df.schema))
    assert envelope.split_valid(envelope.validate_envelope(limits))[0].count() == 1


def test_normalize(spark):
    df = spark.createDataFrame(
        [(None, "", "", "p", "a", "s"), (0, None, "e", "", "", ""), (7, "src", "e", "p", "a", "s")],
        "event_timestamp long, source string, event_id string, project_id string, anonymous_id string, session_id string",
    )
    rows = envelope.normalize_envelope(df, "web", F.lit(99)).collect()
    assert [(r[0], r[1], r[2]) for r in rows] == [(99, "web", None), (99, "web", "e"), (7, "src", "e")]


def test_canonical_page_of_a_pageview(make_events):
    rows = make_events(
        {"page": None, "props": '{"path":"/p"}'}, {"page": "/x", "props": '{"path":"/p"}'},
        {"page": "", "props": '{"path":"/p"}'}, {"name": "other", "page": None, "props": '{"path":"/p"}'},
        {"name": "", "props": "[1]"},
    ).orderBy("kafka_offset").collect()
    assert [r["page_path"] for r in rows[:4]] == ["/p", "/x", "", None]
    assert (rows[4]["event_name"], rows[4]["properties_json"]) == ("unknown", "{}")


def test_dedupe_keeps_the_earliest_and_all_without_id(make_events):
    events = make_events(
        {"id": "a", "t": 9}, {"id": "a", "t": 3}, {"id": "a", "t": 3, "partition": 1},
        {"id": None, "t": 1}, {"id": None, "t": 1}, {"id": "", "t": 1}, {"id": "b", "t": 5},
    )
    kept = envelope.dedupe_events(events)
    assert sorted(r["kafka_offset"] for r in kept.collect()) == [1, 3, 4, 5, 6]
    metrics = envelope.load_metrics(events, 7).first()
    assert (metrics["rows_read"], metrics["events_after_dedupe"]) == (7, 5)


def test_hot_id_shrinks_before_the_shuffle(make_events):
    plan = envelope.dedupe_events(make_events({}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_super_properties_and_identify(spark):
    df = spark.createDataFrame([({"a": "own"},), (None,)], "properties map<string,string>")
    rows = envelope.build_events(df, {"a": "registered", "b": "2"}).collect()
    assert [r[0] for r in rows] == [{"a": "own", "b": "2"}, {"a": "registered", "b": "2"}]
    users = spark.createDataFrame([("u", {"userId": "trait"}), ("v", None), ("", None)], "user_id string, traits map<string,string>")
    got = envelope.identify_events(users).select("event_name", "properties").collect()
    assert [tuple(r) for r in got] == [("user_identified", {"userId": "trait"}), ("user_identified", {"userId": "v"})]
