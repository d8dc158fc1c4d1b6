import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import sessionize, sessions


def user_events(spark, rows):
    df = spark.createDataFrame(rows, "user_id string, s double")
    return df.select("user_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("received_at"))


def spans(df, **options):
    out = sessionize.session_spans(sessionize.sessionize(df, "user_id", **options), "user_id")
    rows = out.withColumns({c: F.unix_micros(c) / 1e6 for c in ("started_at", "ended_at")}).collect()
    return sorted((r["user_id"], r["session_no"], r["started_at"], r["ended_at"], r["events"]) for r in rows)


def by_hand(rows, timeout, mode):
    out = []
    for user in sorted({u for u, _ in rows}):
        current = None
        number = 0
        for t in sorted(t for u, t in rows if u == user):
            anchor = None if current is None else (current[3] if mode == "gap" else current[2])
            over = anchor is None or (t - anchor > timeout if mode == "gap" else t - anchor >= timeout)
            if over:
                number += 1
                current = [user, number, t, t, 0]
                out.append(current)
            current[3], current[4] = t, current[4] + 1
    return sorted(map(tuple, out))


def test_idle_and_age_differ(spark):
    rows = [("u", 60.0 * m) for m in (0, 20, 40, 60)]
    df = user_events(spark, rows)
    assert spans(df, mode="gap") == [("u", 1, 0.0, 3600.0, 4)]
    assert spans(df, mode="fixed") == [("u", 1, 0.0, 1200.0, 2), ("u", 2, 2400.0, 3600.0, 2)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("mode,options", [
    ("gap", {}), ("gap", {"slice_seconds": 7}), ("fixed", {}), ("fixed", {"parts": 1}), ("fixed", {"parts": 7}),
])
def test_against_a_plain_loop(spark, seed, mode, options):
    dice = random.Random(seed)
    rows = []
    for user in "abcd":
        t = dice.uniform(0, 50)
        for _ in range(dice.randrange(1, 60)):
            rows.append((user, float(round(t))))
            t += dice.choice([0, 0, 1, 3, 9, 10, 11, 40])
    assert spans(user_events(spark, rows), timeout_seconds=10, mode=mode, **options) == by_hand(rows, 10, mode)


def test_a_key_with_a_third_of_the_rows_in_one_slice(spark):
    dice = random.Random(5)
    rows = [("hot", round(dice.uniform(100, 109), 3)) for _ in range(600)] + [("hot", 95.0), ("hot", 119.5)]
    rows += [(f"u{i % 40}", float(dice.randrange(300))) for i in range(1200)]
    for mode in ("gap", "fixed"):
        assert spans(user_events(spark, rows), timeout_seconds=10, mode=mode) == by_hand(rows, 10, mode)


def test_times_before_1970(spark):
    rows = [("u", float(t)) for t in range(-95, 60, 6)]
    for mode, options in (("gap", {"slice_seconds": 7}), ("fixed", {}), ("fixed", {"parts": 3})):
        assert spans(user_events(spark, rows), timeout_seconds=10, mode=mode, **options) == by_hand(rows, 10, mode)


def test_events_without_a_key_are_kept(spark):
    df = user_events(spark, [("u", 0.0), (None, 1.0), (None, 90000.0), ("u", 5.0)])
    for mode in ("gap", "fixed"):
        out = sessionize.sessionize(df, "user_id", mode=mode).orderBy("user_id", "received_at").collect()
        assert [(r["user_id"], r["session_no"], r["session_started_at"] is None) for r in out] == [
            (None, None, True), (None, None, True), ("u", 1, False), ("u", 1, False),
        ]


def test_no_fixed_session_reaches_the_timeout(spark):
    rows = [(f"u{i % 5}", float(i * 7 % 5000)) for i in range(2000)]
    found = spans(user_events(spark, rows), timeout_seconds=100, mode="fixed")
    assert all(end - start < 100 for _, _, start, end, _ in found)
    assert sum(n for *_, n in found) == len(rows)


SESSION = [
    {"t": 10, "name": "x", "anon": "", "page": "/b"},
    {"t": 20, "anon": "anonymous-visitor-1", "page": "/a"},
    {"t": 30, "anon": "other", "page": "/b", "user": "u1"},
    {"t": 50, "name": "demo_form_submitted", "props": '{"email":"jo@x.y"}', "user": "who@x.y"},
    {"t": 60, "name": "awc_lead_form_submitted", "props": '{"email":"z@x.y"}'},
    {"t": 70, "name": "x", "page": ""},
]


def test_session_row(make_events):
    row = sessions.session_rows(make_events(*SESSION)).first()
    assert row["session_id"] == "s1" and row["event_count"] == 6
    assert (row["anonymous_id"], row["anonymous_id_short"]) == ("anonymous-visitor-1", "anonymous-visi…")
    assert (row["converted"], row["form_event"]) == (True, "demo_form_submitted")
    # the last event that names anybody is the second form, which has an email only
    assert row["user_display"] == "z***@x.y"
    assert (row["pages"], row["page_count"]) == (["/b", "/a"], 2)
    assert not row["marketplace_engaged"]


def test_display_prefers_the_user_id_and_masks_emails(make_events):
    last = lambda *rows: sessions.session_frame(make_events(*rows)).first()["user_display"]
    assert last({"user": "plain"}, {"props": '{"x":1}'}) == "plain"
    assert last({"user": "a@b.c"}) == "a***@b.c"
    assert last({"props": '{"userId":"abc"}'}) == "ab***"
    assert last({"user": "", "props": "{}"}) is None


def test_page_lists_of_any_length(make_events):
    events = make_events(*[{"page": f"/{i}"} for i in range(600)], {"session": "s2", "page": "/0"}, {"session": "s3"})
    rows = {r["session_id"]: (r["pages"], r["page_count"]) for r in sessions.session_rows(events).collect()}
    assert rows == {"s1": ([f"/{i}" for i in range(600)], 600), "s2": (["/0"], 1), "s3": ([], 0)}
    short = sessions.session_rows(events, pages=False)
    assert "pages" not in short.columns and {r["page_count"] for r in short.collect()} == {600, 1, 0}
    whole = sessions.session_pages(events).where("session_key = 's1'").orderBy("first_seen")
    assert [r["page_path"] for r in whole.collect()] == [f"/{i}" for i in range(600)]


def test_pages_at_the_same_instant_follow_the_log(make_events):
    events = make_events({"t": 1, "page": "/z", "offset": 1}, {"t": 1, "page": "/a", "offset": 2})
    assert sessions.session_rows(events).first()["pages"] == ["/z", "/a"]


def test_converters_take_the_submit_event(make_events):
    row = sessions.recent_converters(make_events(*SESSION)).first()
    assert (row["event_name"], row["email_masked"], row["user_id"]) == ("demo_form_submitted", "j***@x.y", "who@x.y")
    assert (row["pages"], row["event_count"], row["time_to_convert_seconds"]) == (["/b", "/a"], 6, 30.0)


def test_converters_are_the_newest(make_events):
    rows = [{"session": f"s{i:02}", "name": "demo_form_submitted", "t": i} for i in range(30)]
    got = [r["session_id"] for r in sessions.recent_converters(make_events(*rows), 20).collect()]
    assert got == [f"s{i:02}" for i in range(29, 9, -1)]


def test_filters_and_status(make_events):
    events = make_events(
        {"session": "a", "name": "demo_form_submitted"}, {"session": "b", "name": "marketplace_doc_back", "user": "u"}, {"session": "c"}
    )
    rows = sessions.session_rows(events)
    keep = lambda mode: sorted(r["session_id"] for r in sessions.filter_sessions(rows, mode).collect())
    assert keep("all") == ["a", "b", "c"] and keep("converted") == ["a"] and keep("not_converted") == ["b", "c"]
    assert keep("identified") == ["b"] and keep("anonymous") == ["a", "c"]
    status = {r["session_id"]: r["status"] for r in sessions.session_status(rows).collect()}
    assert status == {"a": "Converted", "b": "Engaged", "c": "Browsing"}
    counts = {r["mode"]: r["sessions"] for r in sessions.filter_mode_counts(rows).collect()}
    assert counts == {m: len(keep(m)) for m in sessions.FILTER_MODES}
    summary = sessions.session_summary(sessions.session_frame(events)).first()
    assert tuple(summary) == (3, 1, 2, 2, 1)
    assert sessions.count_sessions(events).first() == summary
    newest = sessions.newest_session_rows(events, 2)
    assert newest.collect() == sessions.newest_sessions(rows, 2).collect()
    with pytest.raises(ValueError):
        sessions.filter_sessions(rows, "none")


def test_browsing_by_link_and_by_page(make_events):
    flags = lambda row: sessions.session_flags(make_events(row)).first()["has_marketplace_browse"]
    assert flags({"name": "nav_link_clicked", "props": '{"href":"/features/x"}'}) == 1
    assert flags({"name": "nav_link_clicked", "props": '{"href":"/"}'}) == 0
    assert flags({"name": "x", "props": '{"href":"/features"}'}) == 0
    assert flags({"name": "x", "page": "/features"}) == 1
    assert flags({"name": "x", "page": "/features/y"}) == 0
