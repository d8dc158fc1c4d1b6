import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clickloom import runtime  # noqa: E402
from clickloom.operators import envelope  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return runtime.configure(session)


EVENT = (
    "event_id string, project_id string, event_name string, properties_json string, event_timestamp long, "
    "source string, user_id string, anonymous_id string, session_id string, page_path string, "
    "kafka_partition int, kafka_offset long, kafka_timestamp timestamp, ingested_at string, raw_payload string"
)


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from short dicts; ``t`` is seconds after midnight."""

    def make(*rows):
        from datetime import datetime, timedelta

        out = []
        for i, r in enumerate(rows):
            at = datetime(2024, 1, 10) + timedelta(seconds=r.get("t", i))
            out.append((
                r.get("id", f"e{i}"), "p1", r.get("name", "$pageview"), r.get("props", "{}"), None, "test",
                r.get("user"), r.get("anon"), r.get("session", "s1"), r.get("page"), r.get("partition", 0),
                r.get("offset", i), None, at.isoformat(" "), None,
            ))
        df = spark.createDataFrame(out, EVENT)
        return envelope.to_canonical(df.withColumn("ingested_at", df.ingested_at.cast("timestamp")))

    return make


AS_OF = "2024-01-11 00:00:00"
DAY = 86400
