import pytest
from pyspark.sql import functions as F

from clickloom import taxonomy as tx
from clickloom.functions import scalars as sf
from clickloom.functions import sql


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def pairs(spark, values, fn):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a double, b double")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("a"), F.col("b"))).collect()]


def test_pct_rounds_half_to_even_and_guards_the_base(spark):
    assert pairs(spark, [(1.0, 0.0), (1.0, 16.0), (3.0, 16.0), (2.0, 3.0)], sf.pct) == [0.0, 6.2, 18.8, 66.7]


def test_delta_pct(spark):
    got = pairs(spark, [(0.0, 0.0), (5.0, 0.0), (0.0, 4.0), (3.0, 2.0)], sf.delta_pct)
    assert got == [None, 100.0, -100.0, 50.0]


MASKS = {
    "a@b.c": "a***@b.c", "@b.c": "***@b.c", "ab": "***", "abc": "ab***", "a@b@c": "a***@b@c", "": "***",
    " x@y ": "x***@y", None: None,
}


def test_mask_email(spark):
    assert column(spark, list(MASKS), sf.mask_email) == list(MASKS.values())


def test_truncate_id(spark):
    assert column(spark, ["x" * 13, "x" * 14, "x" * 15, None, ""], sf.truncate_id) == [
        "x" * 13, "x" * 14, "x" * 14 + "…", None, None,
    ]


def test_sanitize_label(spark):
    got = column(spark, ["Héllo wörld!!", "a" * 70, "___", "   ", None, "a/b:c-d.e"], sf.sanitize_label)
    assert got == ["Héllo_wörld", "a" * 64, "unknown", "unknown", None, "a/b:c-d.e"]


def test_strip_covers_unicode_white_space(spark):
    assert column(spark, ["  x\t\n\xa0", "　"], sf.nonblank) == ["x", None]


def test_keys(spark):
    row = spark.createDataFrame(
        [("s", "a", "u"), ("", "a", ""), (None, "", None)], "session string, anon string, user string"
    )
    session = sf.session_key(F.col("session"), F.col("anon"), F.lit("7"))
    got = row.select(session, sf.actor_key(F.col("user"), F.col("anon"), session)).collect()
    assert [tuple(r) for r in got] == [("s", "user:u"), ("anon:a", "anon:a"), ("evt:7", "evt:7")]


def test_parse_time_forms(spark):
    values = [
        None, "1704067200", "1704067200123", "2024-01-01 00:00:00.5", "2024-01-01 00:00:00",
        "2024-01-01T00:00:00.123456", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "soon", "12",
    ]
    got = column(spark, values, lambda c: sf.parse_time(c).cast("string"))
    day = "2024-01-01 00:00:00"
    assert got == [None, day, day + ".123", day + ".5", day, day + ".123456", day, day, None, None]


def test_parse_utm(spark):
    got = column(
        spark,
        ["http://x/?utm_source=a%20b&utm_medium=", "http://x/?utm_term=1&utm_term=2", "http://x/", "no url", None],
        lambda c: F.to_json(sf.parse_utm(c)),
    )
    assert got == ['{"source":"a b"}', '{"term":"1"}', None, None, None]


def test_int_or_null(spark):
    assert column(spark, ["5", "1.5", "-2.9", "1.7040672071795E12", "x", None, ""], sf.int_or_null) == [
        5, 1, -2, 1704067207179, None, None, None,
    ]


def test_rules(spark):
    default = lambda c: sf.rule_classify(c, tx.CATEGORY_RULES, F.lit(tx.CATEGORY_DEFAULT))
    assert column(spark, ["My-Kafka-Trino", "TRINO", "other"], default) == ["Streaming", "Lakehouse", "Platform"]
    prefix = lambda c: sf.prefix_key(c, (("lake", "a"), ("la", "b")))
    assert column(spark, ["lake-1", "lark", "x"], prefix) == ["a", "b", None]


def test_component(spark):
    cases = [
        ("x", '{"href":"/a","button":"Buy now"}', "button:Buy_now"),
        ("x", '{"button":" ","tab":"t"}', "tab:t"),
        ("$pageview", '{"path":"/p"}', "path:/p"),
        ("x", '{"path":"/p"}', "-"),
        ("x", '{"b\\u0075tton":"hidden"}', "button:hidden"),
        ("x", "not json", "-"),
        ("x", None, "-"),
        ("x", '{"button":true}', "button:true"),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, n string, p string").orderBy("i")
    want = [c[2] for c in cases]
    parsed = rows.withColumn("s", sf.property_struct(F.col("p"), sf.COMPONENT_PROPS))
    assert [r[0] for r in parsed.select(sf.event_component(F.col("n"), F.col("s"))).collect()] == want
    sql.register(spark)
    assert [r[0] for r in rows.selectExpr("event_component(n, p)").collect()] == want


def test_sql_functions_agree_with_columns(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(v,) for v in MASKS if v], "v string")
    assert rows.where(~(F.expr("mask_email(v)") == sf.mask_email(F.col("v")))).count() == 0
    odd = ["cafe\u0301 x", "a\u203fb", "\u00a0who@x.y\t", "\t", "", "é/ü:1", "__a__", "x" * 90, None]
    texts = spark.createDataFrame([(v,) for v in odd], "v string")
    for name, rule in (("mask_email", sf.mask_email), ("sanitize_label", sf.sanitize_label)):
        assert texts.where(~F.expr(f"{name}(v)").eqNullSafe(rule(F.col("v")))).count() == 0
    assert spark.sql("""SELECT event_component('x', '{"button":"\\t","tab":"t1"}')""").first()[0] == "tab:t1"
    assert spark.sql("SELECT pct(1, 16), pct(1, 0)").first() == (6.2, 0.0)
    assert spark.sql("SELECT session_key('', '', '9'), session_key(NULL, 'a', '9')").first() == ("evt:9", "anon:a")


@pytest.mark.parametrize("name,short", [("marketplace_doc_viewed", "doc_viewed"), ("blueprint_card", "card"), ("x_blueprint_", "x_blueprint_")])
def test_short_event_name(spark, name, short):
    assert column(spark, [name], sf.short_event_name) == [short]


def test_event_classes_hold_the_named_sets():
    assert set(tx.MARKETPLACE) < set(tx.MARKETPLACE_BROWSE)
    assert set(tx.CTA) < set(tx.CTA_LEADERBOARD)
    assert len(tx.MARKETPLACE_BROWSE) == 10 and len(tx.CTA_LEADERBOARD) == 6
