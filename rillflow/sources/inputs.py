"""Where messages come from and go to: static tables, files, Kafka, and dead letters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.message import from_kafka


@dataclass
class Inputs:
    """Messages by stream name: a table in envelope layout, or a function that gives one for a session."""

    inputs: dict[str, DataFrame | Callable[[SparkSession], DataFrame]] = field(default_factory=dict)

    def open(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.inputs:
            raise ValueError(f"no input is bound to stream {name!r}")
        found = self.inputs[name]
        return found if isinstance(found, DataFrame) else found(spark)


def kafka_options(config: Mapping[str, Any], topic: str, group: str) -> dict[str, str]:
    """Options of Spark's Kafka source.

    ``auto_offset_reset``: earliest, latest (default) or error, which accepts only a
    query with a checkpoint; ``strict_offset_reset`` fails on lost data;
    ``max_offsets_per_trigger`` bounds a micro-batch, so that a slow sink isn't flooded.
    """
    reset = config.get("auto_offset_reset", "latest")
    if reset not in ("earliest", "latest", "error"):
        raise ValueError(f"auto_offset_reset: {reset!r}")
    servers = config["bootstrap_servers"]
    options = {
        "kafka.bootstrap.servers": ",".join(servers) if isinstance(servers, list) else servers,
        "subscribe": topic,
        "kafka.group.id": group,
        "includeHeaders": "true",
        "startingOffsets": "latest" if reset == "error" else reset,
        "failOnDataLoss": str(bool(config.get("strict_offset_reset", False))).lower(),
    }
    for key, option in (("max_offsets_per_trigger", "maxOffsetsPerTrigger"), ("min_partitions", "minPartitions")):
        if config.get(key) is not None:
            options[option] = str(int(config[key]))
    return options | {f"kafka.{k}": str(v) for k, v in (config.get("override_params") or {}).items()}


def kafka_input(config: Mapping[str, Any], topic: str, group: str, *, checkpointed: bool = False) -> Callable[[SparkSession], DataFrame]:
    """A Kafka topic as messages (needs Spark's Kafka connector on the class path)."""
    if config.get("auto_offset_reset") == "error" and not checkpointed:
        raise ValueError("auto_offset_reset is error, and there is no checkpoint to start from")
    return lambda spark: from_kafka(spark.readStream.format("kafka").options(**kafka_options(config, topic, group)).load(), topic)


def kafka_sink_options(config: Mapping[str, Any], topic: str) -> dict[str, str]:
    """Options of Spark's Kafka sink."""
    servers = config["bootstrap_servers"]
    options = {"kafka.bootstrap.servers": ",".join(servers) if isinstance(servers, list) else servers, "topic": topic}
    return options | {f"kafka.{k}": str(v) for k, v in (config.get("override_params") or {}).items()}


@dataclass(frozen=True)
class DeadLetters:
    """Where invalid messages go."""

    topic: str
    options: Mapping[str, str]


def dead_letters(stream: str | None, config: Mapping[str, Any] | None) -> DeadLetters | None:
    """The dead-letter target of a source: its configured topic, else its ``dlq_stream_name``; None if neither is set."""
    if stream is None and not config:
        return None
    if not config:
        raise KeyError("dlq")
    if not config.get("bootstrap_servers"):
        raise ValueError("dlq: bootstrap_servers are required")
    topic = config.get("topic") or stream
    if not topic:
        raise ValueError("dlq: a topic is required")
    return DeadLetters(topic, kafka_sink_options(config, topic))


def sink_value(df: DataFrame, *more: str) -> DataFrame:
    """The payload as the bytes that a stream sink writes; other types are refused when planning."""
    kind = df.schema["payload"].dataType.typeName()
    if kind not in ("binary", "string"):
        raise TypeError(f"a stream sink takes bytes or text, not {kind}; add a serializer")
    return df.select(F.col("payload").cast("binary").alias("value"), *(c for c in ("headers",) if c in df.columns), *more)
