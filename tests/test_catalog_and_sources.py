import json

import pytest
from pyspark.sql import functions as F

from clickloom import schema
from clickloom.operators import catalog, envelope, ingest_checks
from clickloom.sources import documents, events as table_io, kafka, sample
from conftest import AS_OF, DAY


@pytest.fixture
def items(spark):
    rows = [("1", "kafka-prod", "beta"), ("2", "zz", "Alpha"), ("3", "Trino-x", "gamma"), ("4", "zz", "alpha")]
    return spark.createDataFrame(rows, "id string, name string, title string")


def test_classification(items):
    rows = {r["id"]: (r["category"], r["icon"]) for r in catalog.classify_items(items, "name").collect()}
    assert rows == {"1": ("Streaming", "KM"), "2": ("Platform", "ZZ"), "3": ("Lakehouse", "TR"), "4": ("Platform", "ZZ")}


def test_dimension_lookup_keeps_items_without_a_match(spark, items):
    dim = spark.createDataFrame([("k", "Kafka"), ("t", None)], "key string, label string")
    key = F.when(F.col("name").startswith("kafka"), "k").when(F.col("name").startswith("Trino"), "t")
    rows = catalog.lookup_dimension(items, dim, key, "key", {"label": F.col("name")})
    assert {r["id"]: r["label"] for r in rows.collect()} == {"1": "Kafka", "2": "zz", "3": "Trino-x", "4": "zz"}


def test_picks(items):
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(catalog.first_by_title(items, "title", "id", 3)) == ["2", "4", "1"]
    assert ids(catalog.preferred_topk(items, F.col("id") == "3", "title", "id", 3)) == ["3", "2", "4"]
    assert ids(catalog.preferred_topk(items, F.col("id") != "2", "title", "id", 2)) == ["4", "1"]
    assert ids(catalog.lookup_item(items, " zz ", ["id", "name"], [F.desc("id")])) == ["4"]
    assert ids(catalog.lookup_item(items, "3", ["id", "name"], [F.col("id")])) == ["3"]
    assert ids(catalog.newest_created(items, "id", "name")) == ["4", "3", "2", "1"]


def test_catalog_document(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"synced_at": "now", "engines": [{"name": "b"}, {"name": "a", "displayName": "A"}], "blueprints": []}, indent=1))
    loaded = documents.load_catalog(spark, str(path))
    meta = documents.catalog_meta(loaded).first().asDict()
    assert meta == {"synced_at": "now", "console_url": None, "experience_count": 0, "engine_count": 2, "blueprint_count": 0}
    assert [(r["position"], r["name"]) for r in documents.catalog_items(loaded, "engines").collect()] == [(0, "b"), (1, "a")]
    missing = documents.catalog_meta(documents.load_catalog(spark, str(tmp_path / "none.json"))).first()
    assert tuple(missing) == (None, None, 0, 0, 0)


def test_kafka_options():
    env = {"KAFKA_BOOTSTRAP_SERVERS": " host:1 ", "KAFKA_SASL_MECHANISM": ""}
    options = kafka.stream_options("t", "latest", 100, env)
    assert options == {
        "kafka.bootstrap.servers": "host:1", "subscribe": "t", "startingOffsets": "latest", "failOnDataLoss": "true", "maxOffsetsPerTrigger": "100",
    }
    bounded = kafka.batch_options("t", {1: 5, 0: 7}, max_per_partition=50, env={})
    assert json.loads(bounded["startingOffsets"]) == {"t": {"0": 7, "1": 5}}
    assert json.loads(bounded["endingOffsets"]) == {"t": {"0": 57, "1": 55}}
    assert kafka.start_position("checkpoint", "t") == "earliest"
    with pytest.raises(ValueError):
        kafka.start_position("middle", "t")
    with pytest.raises(ValueError):
        kafka.batch_options("t", "earliest", max_per_partition=1, env={})


def test_messages_leave_nulls_out(spark):
    df = spark.createDataFrame([("x", None)], "name string, user_id string")
    assert kafka.to_messages(df).first()["value"] == '{"name":"x"}'


def test_ddl():
    ddl = schema.table_ddl("cat.db.events", "iceberg")
    assert ddl[0] == "CREATE DATABASE IF NOT EXISTS cat.db"
    assert "USING iceberg PARTITIONED BY (days(ingested_at))" in ddl[1]
    assert len(schema.EVENT_COLUMNS) == 15
    assert len(schema.table_ddl("events")) == 1


@pytest.fixture(scope="module")
def table(spark):
    name = "shop.events"
    table_io.create_event_table(spark, name)
    table_io.create_event_table(spark, name)
    rows = sample.clickstream_rows(sample.read_events(spark, "/root/testdata/sf0.001"))
    # appended by name: the column order of the frame does not matter
    table_io.append_rows(rows.select(*sorted(rows.columns)), name)
    return name


def test_scan_prunes_days_and_columns(spark, table):
    scan = table_io.scan_events(spark, table, 7, sample.AS_OF)
    assert scan.columns == list(schema.REPORT_COLUMNS)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan and "GreaterThanOrEqual(ingested_at" in plan
    assert "raw_payload" not in plan.split("ReadSchema")[1]
    narrow = scan.groupBy("event_name").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_name:string,ingested_at:timestamp>" in narrow
    whole = spark.table(table).count()
    assert whole == 1000 and 0 < scan.count() < whole
    assert table_io.scan_events(spark, table, 15, sample.AS_OF, comparison=True).count() == whole


def test_load_history(spark, table):
    events = table_io.load_events(spark, f"history:{table}", 30, sample.AS_OF)
    assert events.count() == 1000 and "actor_key" in events.columns
    with pytest.raises(ValueError):
        table_io.load_events(spark, "cache:x")


def test_table_state(make_events):
    events = make_events({"t": 1, "offset": 3}, {"t": 9, "offset": 5}, {"t": 5, "partition": 1, "offset": 0}, {"t": 5, "partition": 1, "offset": 0})
    newest = ingest_checks.verify_table(events, 2).collect()
    assert [(r["kafka_offset"], r["row_count"]) for r in newest] == [(5, 4), (0, 4)]
    gaps = {r["kafka_partition"]: (r["missing"], r["repeated"]) for r in ingest_checks.offset_gaps(events).collect()}
    assert gaps == {0: (1, 0), 1: (0, 1)}
    ends = events.sparkSession.createDataFrame([(0, 10), (1, 1), (2, 4)], "kafka_partition int, end_offset long")
    lag = {r["kafka_partition"]: r["lag"] for r in ingest_checks.ingest_lag(ends, ingest_checks.next_offsets(events)).collect()}
    assert lag == {0: 4, 1: 0, 2: 4}
    row = ingest_checks.reconcile_ingest(events, "2024-01-10 00:00:05", published=4).first()
    assert tuple(row) == (1, 4, 3, False)
    assert ingest_checks.reconcile_ingest(events, "2024-01-10 00:00:05").first()["ok"]


def test_live_source_reads_the_buffer(spark, make_events, tmp_path):
    from clickloom.operators import live

    buffer = str(tmp_path / "buffer")
    rows = envelope.with_component(make_events({"t": DAY - 10}, {"t": DAY - 400}, {"t": DAY - 4000}))
    live.latest_n(rows, 2).write.parquet(buffer)
    assert table_io.load_events(spark, f"live:{buffer}", as_of=AS_OF, seconds=300).count() == 1


def test_shuffles_are_sized_by_the_input(spark):
    from clickloom import runtime

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        path = "/root/testdata/sf0.001/events.parquet"
        assert runtime.size_shuffles(spark, path) == int(before)
        assert runtime.size_shuffles(spark, path, path, partition_bytes=100) > 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_oauth_client_makes_the_login_line():
    env = {"KAFKA_OAUTH_CLIENT_ID": "me", "KAFKA_OAUTH_CLIENT_SECRET": 'a"b\\c', "KAFKA_OAUTH_SCOPE": "read"}
    options = kafka.client_options(env)
    assert options["kafka.sasl.jaas.config"].endswith(r'required clientId="me" clientSecret="a\"b\\c" scope="read";')
    assert options["kafka.sasl.mechanism"] == "OAUTHBEARER"
    whole = kafka.client_options(env | {"KAFKA_SASL_JAAS_CONFIG": "line;", "KAFKA_SASL_MECHANISM": "PLAIN"})
    assert (whole["kafka.sasl.jaas.config"], whole["kafka.sasl.mechanism"]) == ("line;", "PLAIN")
    assert kafka.client_options({}) == {}
    with pytest.raises(ValueError):
        kafka.client_options({"KAFKA_OAUTH_CLIENT_ID": "me"})
