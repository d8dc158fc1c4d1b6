"""Kafka reading and writing through Spark's own connector.

Credentials come from the environment and are never part of the code. The connector
package has to be on the session (``spark.jars.packages``).
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Environment variable -> Kafka client option.
ENVIRONMENT = {
    "KAFKA_BOOTSTRAP_SERVERS": "kafka.bootstrap.servers",
    "KAFKA_SECURITY_PROTOCOL": "kafka.security.protocol",
    "KAFKA_SASL_MECHANISM": "kafka.sasl.mechanism",
    "KAFKA_SASL_JAAS_CONFIG": "kafka.sasl.jaas.config",
    "KAFKA_SASL_CALLBACK_HANDLER": "kafka.sasl.login.callback.handler.class",
    "KAFKA_TOKEN_URL": "kafka.sasl.oauthbearer.token.endpoint.url",
    "KAFKA_TRUSTSTORE": "kafka.ssl.truststore.location",
    "KAFKA_TRUSTSTORE_TYPE": "kafka.ssl.truststore.type",
}

MESSAGE = (
    "CAST(value AS STRING) AS message",
    "partition",
    "offset",
    "CAST(timestamp AS TIMESTAMP) AS event_timestamp",
)


#: The login module that takes the client's id and secret from the JAAS line.
OAUTH_MODULE = "org.apache.kafka.common.security.oauthbearer.OAuthBearerLoginModule"


def client_options(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Client options that the environment sets.

    ``KAFKA_OAUTH_CLIENT_ID`` and ``KAFKA_OAUTH_CLIENT_SECRET``, with an optional
    ``KAFKA_OAUTH_SCOPE``, make the JAAS line, unless a whole line is given. One of the
    first two without the other is an error.
    """
    env = os.environ if env is None else env
    options = {option: env[name].strip() for name, option in ENVIRONMENT.items() if env.get(name, "").strip()}
    if "kafka.sasl.jaas.config" not in options and (line := _oauth_line(env)):
        options["kafka.sasl.jaas.config"] = line
        options.setdefault("kafka.sasl.mechanism", "OAUTHBEARER")
    return options


def _oauth_line(env: Mapping[str, str]) -> str | None:
    client, secret, scope = (env.get(f"KAFKA_OAUTH_{name}", "").strip() for name in ("CLIENT_ID", "CLIENT_SECRET", "SCOPE"))
    if not client and not secret:
        return None
    if not client or not secret:
        raise ValueError("KAFKA_OAUTH_CLIENT_ID and KAFKA_OAUTH_CLIENT_SECRET go together")
    given = {"clientId": client, "clientSecret": secret} | ({"scope": scope} if scope else {})
    quoted = " ".join(f'{name}="{_jaas(value)}"' for name, value in given.items())
    return f"{OAUTH_MODULE} required {quoted};"


def _jaas(value: str) -> str:
    return value.replace("\\", "\\\\").replace('"', '\\"')


def start_position(mode: str | Mapping[int, int], topic: str) -> str:
    """``startingOffsets`` for earliest, latest, checkpoint or next offset per partition.

    A stream's checkpoint always wins over this; ``checkpoint`` therefore only says
    where to begin when there is none yet, which is at the earliest message.
    """
    if isinstance(mode, Mapping):
        return json.dumps({topic: {str(p): o for p, o in sorted(mode.items())}})
    if mode == "checkpoint":
        return "earliest"
    if mode not in ("earliest", "latest"):
        raise ValueError("mode must be earliest, latest, checkpoint or offsets per partition")
    return mode


def stream_options(topic: str, starting: str | Mapping[int, int] = "earliest", max_per_trigger: int | None = None,
                   env: Mapping[str, str] | None = None, fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of a stream; offsets that are gone fail the query unless ``fail_on_data_loss`` is off."""
    options = {
        **client_options(env),
        "subscribe": topic,
        "startingOffsets": start_position(starting, topic),
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def kafka_events(spark: SparkSession, topic: str, starting: str | Mapping[int, int] = "earliest",
                 max_per_trigger: int | None = None, fail_on_data_loss: bool = True) -> DataFrame:
    """Messages of a topic as a stream: message, partition, offset, event_timestamp."""
    options = stream_options(topic, starting, max_per_trigger, fail_on_data_loss=fail_on_data_loss)
    return spark.readStream.format("kafka").options(**options).load().selectExpr(*MESSAGE)


def batch_options(topic: str, start: Mapping[int, int] | str = "earliest", end: Mapping[int, int] | str = "latest",
                  max_per_partition: int | None = None, env: Mapping[str, str] | None = None,
                  fail_on_data_loss: bool = True) -> dict[str, str]:
    """Options of a bounded read, at most ``max_per_partition`` messages each."""
    if max_per_partition is not None:
        if not isinstance(start, Mapping):
            raise ValueError("max_per_partition needs a start offset per partition")
        end = {p: o + max_per_partition for p, o in start.items()}
    ending = json.dumps({topic: {str(p): o for p, o in sorted(end.items())}}) if isinstance(end, Mapping) else end
    return {
        **client_options(env),
        "subscribe": topic,
        "startingOffsets": start_position(start, topic),
        "endingOffsets": ending,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }


def kafka_batch(spark: SparkSession, topic: str, **bounds) -> DataFrame:
    return spark.read.format("kafka").options(**batch_options(topic, **bounds)).load().selectExpr(*MESSAGE)


def to_messages(events: DataFrame) -> DataFrame:
    """Events as compact JSON in ``value``, fields that are NULL left out."""
    return events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def publish_events(events: DataFrame, topic: str) -> None:
    to_messages(events).write.format("kafka").options(**client_options()).option("topic", topic).save()
