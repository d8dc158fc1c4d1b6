import random
import statistics

import pytest
from pyspark.sql import functions as F

from clickloom import taxonomy as tx
from clickloom.operators import ingest_checks, insights, live, periods, quantiles, sessions
from clickloom.plans import report
from conftest import AS_OF, DAY

FORM, DETAIL, CTA = "demo_form_submitted", "marketplace_details_clicked", "hero_cta_clicked"


def steps(events):
    return [(r["sessions"], r["rate_pct"]) for r in insights.funnel(sessions.session_flags(events)).orderBy("position").collect()]


def test_funnel_skips_zero_steps_for_the_base(make_events):
    events = make_events(
        {"session": "a"}, {"session": "b"}, {"session": "c", "name": "x"}, {"session": "a", "name": CTA},
        {"session": "b", "name": FORM}, {"session": "c", "name": FORM}, {"session": "d", "name": FORM},
    )
    assert steps(events) == [(2, 50.0), (0, 0.0), (0, 0.0), (0, 0.0), (1, 50.0), (3, 300.0)]


def test_funnel_without_sessions(make_events):
    assert steps(make_events({}).where("false")) == [(0, 0.0)] * 6


def kpi_row(events):
    return insights.kpis(events).first().asDict()


def test_kpis(make_events):
    row = kpi_row(make_events(
        {"session": "a", "page": "/x", "anon": "v"}, {"session": "a", "page": "/y", "anon": "v"}, {"session": "a", "name": FORM, "user": "u"},
        {"session": "b", "page": "/x", "anon": "v"}, {"session": "b", "page": "", "anon": "v"}, {"session": "c", "name": FORM},
        {"session": "c", "name": "user_identified"},
    ))
    assert row == {
        "sessions": 3, "actors": 3, "identified_users": 2, "form_submissions": 2, "conversion_rate_pct": 100.0,
        "marketplace_engagement_rate_pct": 0.0, "multi_page_session_rate_pct": 33.3, "engaged_session_rate_pct": 33.3,
    }


def test_kpis_of_nothing(make_events):
    assert set(kpi_row(make_events({}).where("false")).values()) == {0}


def test_kpis_agree_with_the_session_frame(make_events):
    dice = random.Random(4)
    events = make_events(*[
        {"session": f"s{dice.randrange(9)}", "user": dice.choice([None, "u", "w"]), "anon": dice.choice([None, "a", ""]),
         "name": dice.choice(["$pageview", FORM, DETAIL, "user_identified"]), "page": dice.choice([None, "", "/a", "/b"])}
        for _ in range(120)
    ])
    other = insights.kpis_from(sessions.session_frame(events), insights.actor_flags(events))
    assert kpi_row(events) == other.first().asDict()


def compared(make_events, *rows, comparison="prior"):
    return periods.split_periods(make_events(*rows), DAY / 2, AS_OF, comparison)


def test_comparison_is_null_without_previous_events(make_events):
    later = {"t": DAY - 5}
    row = insights.kpi_comparison(insights.kpis(compared(make_events, later), "period")).first()
    assert set(row) == {None}
    row = insights.kpi_comparison(insights.kpis(compared(make_events, later, {"t": 5, "name": FORM}), "period")).first()
    assert row["sessions_delta_pct"] == 0.0 and row["form_submissions_delta_pct"] == -100.0
    assert row["identified_users_delta_pct"] is None


def test_period_bounds(make_events):
    half = DAY // 2
    rows = [{"t": half}, {"t": half - 1}, {"t": 0}, {"t": -1}, {"t": DAY + 9}]
    got = [(r["kafka_offset"], r["period"]) for r in compared(make_events, *rows).orderBy("kafka_offset").collect()]
    assert got == [(0, "current"), (1, "previous"), (2, "previous"), (4, "current")]


@pytest.mark.parametrize("mode,want", [
    ("half", [(1, "previous"), (2, "current")]),
    ("half_compat", [(1, "current"), (1, "previous"), (2, "current")]),
])
def test_half_window_modes(make_events, mode, want):
    rows = [{"t": 0}, {"t": DAY // 2}, {"t": DAY - 9}]
    got = compared(make_events, *rows, comparison=mode)
    assert sorted((r["kafka_offset"], r["period"]) for r in got.collect()) == want


def test_visitors(make_events):
    early, late = 5, DAY - 5
    both = compared(
        make_events, {"t": early, "anon": "a"}, {"t": early, "anon": "gone"}, {"t": late, "anon": "a"}, {"t": late, "anon": "new"},
        {"t": late, "session": "s7"}, {"t": late, "session": "s7", "anon": ""}, {"t": early, "session": "s8"},
    )
    row = insights.visitor_mix(both).first()
    assert tuple(row) == (1, 1, 1, 3, 33.3, 33.3)
    assert [r[0] for r in insights.returning_visitors(both).collect()] == ["a"]
    assert [r[0] for r in insights.new_visitors(both).collect()] == ["new"]


def test_time_to_convert_buckets_and_floor(make_events):
    rows = []
    for i, wait in enumerate([59, 60, 299, 300, 1799, 1800]):
        rows += [{"session": f"s{i}", "t": 0}, {"session": f"s{i}", "t": wait, "name": FORM}]
    rows += [{"session": "back", "t": 50}, {"session": "back", "t": 10, "name": FORM}]
    rows += [{"session": "no_view", "t": 5, "name": "x"}, {"session": "no_view", "t": 25, "name": FORM}]
    row = insights.time_to_convert(sessions.session_flags(make_events(*rows))).first()
    assert [row[b[0]] for b in tx.CONVERT_BUCKETS] == [3, 2, 2, 1]
    assert (row["converted_sessions"], row["median_seconds"]) == (8, 179.5)


def test_time_to_convert_without_conversions(make_events):
    row = insights.time_to_convert(sessions.session_flags(make_events({}))).first()
    assert (row["converted_sessions"], row["median_seconds"]) == (0, None)


@pytest.mark.parametrize("size", [1, 2, 3, 50, 51])
def test_exact_median(spark, size):
    dice = random.Random(size)
    values = [dice.choice([dice.randrange(10**13), dice.randrange(5), 3_000_000]) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert quantiles.exact_median(df, "v").first()[0] == statistics.median(values)


def test_ties_go_to_the_first_seen_then_by_key(make_events):
    names = ["late", "early", "most", "most", "b", "a"]
    events = make_events(*[{"name": n, "t": t} for n, t in zip(names, [9, 1, 2, 3, 5, 5])])
    assert [tuple(r) for r in insights.top_events(events).collect()] == [
        ("most", 2), ("early", 1), ("a", 1), ("b", 1), ("late", 1),
    ]
    assert insights.top_k(events, "event_name", 2, "n").collect() == insights.top_events(events, 2).collect()


def test_board_labels(make_events):
    events = make_events(
        {"name": "button_clicked", "props": '{"label":" ","button":"go"}'}, {"name": "hero_cta_clicked"},
        {"name": "faq_opened", "props": '{"question":"q"}'}, {"name": "faq_expanded"},
        {"name": "engine_deploy_clicked", "props": '{"engine_title":"E","tab":"T"}'}, {"name": "playground_tab_changed"},
        {"name": DETAIL, "props": '{"service":"S"}'}, {"name": DETAIL}, {"page": ""}, {"page": "/p"},
    )
    counts = insights.board_counts(events)
    want = {
        "cta_leaderboard": [("button_clicked · go", 1), ("hero_cta_clicked", 1)],
        "faq_leaderboard": [("q", 1), ("faq_expanded", 1)],
        "engine_leaderboard": [("E", 1), ("playground_tab_changed", 1)],
        "blueprint_leaderboard": [("S", 1)],
        "top_pages": [("/p", 1)],
    }
    for board, rows in want.items():
        assert [tuple(r) for r in insights.board_top(counts, board).collect()] == rows
        assert [tuple(r) for r in insights.leaderboard(events, board).collect()] == rows
        tops = insights.board_tops(counts).where(F.col("board") == board).orderBy("rank")
        assert [(r["label"], r["n"]) for r in tops.collect()] == rows


def test_treemap_total_covers_cut_blueprints(make_events):
    events = make_events(*[{"name": DETAIL, "props": f'{{"blueprint":"b{i % 5}"}}'} for i in range(11)])
    rows = insights.blueprint_treemap(events, k=2).collect()
    assert [(r["blueprint"], r["value"], r["total"], r["share_pct"]) for r in rows] == [("b0", 3, 11, 27.3), ("b1", 2, 11, 18.2)]


def test_paths_are_distinct_trimmed_and_short(make_events):
    events = make_events(
        {"t": 1, "page": " /a "}, {"t": 2, "page": "/a"}, {"t": 3, "page": "/b"}, {"t": 4, "name": "x", "page": "/no"},
        {"t": 5, "page": None, "props": '{"path":"/c"}'}, {"t": 6, "page": "/d"}, {"t": 0, "name": FORM},
        {"session": "s2", "t": 9, "page": " "}, {"session": "s3", "name": FORM},
    )
    assert [tuple(r) for r in insights.top_paths(events).collect()] == [("/a → /b → /c", 1, 1, 100.0)]
    assert insights.top_paths(events, hops=1).first()["path"] == "/a"


def test_path_order(make_events):
    rows = []
    for i, (page, converted) in enumerate([("/late", 0), ("/conv", 1), ("/first", 0)]):
        rows.append({"session": f"s{i}", "page": page, "t": 10 - i})
        rows += [{"session": f"s{i}", "name": FORM, "t": 20}] * converted
    assert [r["path"] for r in insights.top_paths(make_events(*rows)).collect()] == ["/conv", "/first", "/late"]


def test_heatmap_is_whole(make_events):
    events = make_events(*[{"t": 3600 * i} for i in range(30)])
    rows = insights.activity_heatmap(events).collect()
    assert len(rows) == 168 and sum(r["events"] for r in rows) == 30
    assert {r["max_count"] for r in rows} == {1}
    # 2024-01-10 is a Wednesday
    assert {(r["weekday"], r["day"]) for r in rows if r["events"]} == {(2, "Wed"), (3, "Thu")}


def test_trends_count_sessions_once(make_events):
    events = make_events({"t": 0}, {"t": 4000}, {"t": 4000, "name": FORM, "session": "s2"})
    want = [("2024-01-10 00:00", 1, 1, 0), ("2024-01-10 01:00", 2, 1, 1)]
    rows = insights.activity_trends(events, hourly=True).select("label", "events", "sessions", "form_submissions")
    assert [tuple(r) for r in rows.collect()] == want
    frame = sessions.session_flags(events)
    other = insights.trends_from(insights.hourly_activity(events), frame, hourly=True)
    assert [tuple(r) for r in other.select(rows.columns).collect()] == want


def test_live_stats(make_events):
    events = make_events({"t": DAY - 1}, {"t": DAY - 60}, {"t": DAY - 61, "name": "old"}, {"t": DAY, "name": "x"})
    rows = {(r["scope"], r["name"]): (r["events"], r["rate_per_minute"]) for r in live.live_stats(events, 60, AS_OF).collect()}
    assert rows == {("all", None): (3, 3.0), ("name", "$pageview"): (2, 2.0), ("name", "x"): (1, 1.0)}
    quiet = live.live_stats(events, 60, "2024-02-01 00:00:00").collect()
    assert [(r["scope"], r["events"], r["rate_per_minute"]) for r in quiet] == [("all", 0, 0.0)]
    with pytest.raises(ValueError):
        live.live_stats(events, 0, AS_OF)


def test_ties_are_in_the_order_first_seen(make_events):
    events = make_events({"t": 5, "name": "a"}, {"t": 1, "name": "b"}, {"t": 9, "name": "b"}, {"t": 7, "name": "a"})
    assert [r["name"] for r in live.live_stats(events, DAY, AS_OF).collect()] == [None, "b", "a"]


def test_pages_of_events_have_the_size_asked_for(make_events):
    events = make_events(*[{"t": i} for i in range(500)])
    assert live.page_events(events, 450).count() == 450
    for limit, offset in ((0, 0), (1, -1)):
        with pytest.raises(ValueError):
            live.page_events(events, limit, offset)


def test_status_of_an_empty_table(make_events):
    status = ingest_checks.ingest_status(make_events({"t": 1}).limit(0), "received_at").collect()
    assert [(r["scope"], r["row_count"], r["last_ingested_at"]) for r in status] == [("table", 0, None)]


def test_report_panels_agree_with_the_operators(make_events):
    dice = random.Random(1)
    names = ["$pageview", "$pageview", FORM, DETAIL, CTA, "faq_opened"]
    rows = [
        {"t": dice.randrange(DAY), "session": f"s{dice.randrange(12)}", "name": dice.choice(names), "page": dice.choice(["/a", "/b", None]),
         "anon": f"a{dice.randrange(6)}", "props": '{"blueprint":"b","label":"l"}', "id": f"e{i - i % 10 // 9}"}
        for i in range(150)
    ]
    events = make_events(*rows)
    with report.insights_report(events, AS_OF, window_seconds=DAY // 2) as panels:
        from clickloom.operators import envelope

        current = periods.events_in_window(envelope.dedupe_events(events), DAY // 2, AS_OF)
        flags = sessions.session_flags(current)
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
        assert same(panels["funnel"], insights.funnel(flags))
        assert same(panels["kpis"], insights.kpis(current))
        assert same(panels["top_paths"], insights.top_paths(current))
        assert same(panels["activity_trends"], insights.activity_trends(current, hourly=True))
        assert same(panels["activity_heatmap"], insights.activity_heatmap(current))
        assert same(panels["time_to_convert"], insights.time_to_convert(flags))
        assert same(panels["blueprint_treemap"], insights.blueprint_treemap(current))
        assert same(panels["cta_leaderboard"], insights.cta_leaderboard(current))
        assert same(panels["recent_converters"], sessions.recent_converters(current))
        assert same(panels["all_sessions"], sessions.session_rows(current))
        assert report.flat_report(panels).where("panel = 'session_summary'").count() == 5


def test_custom_vocabulary(make_events):
    mine = tx.Taxonomy(pageview="view", form_submit=("paid",))
    events = make_events({"name": "view"}, {"name": "paid"})
    row = insights.kpis(events, taxonomy=mine).first()
    assert (row["form_submissions"], row["conversion_rate_pct"]) == (1, 100.0)
    flags = sessions.session_flags(events, taxonomy=mine).select(F.col("has_pageview"), F.col("has_form_submit")).first()
    assert tuple(flags) == (1, 1)
