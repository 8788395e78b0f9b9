"""Writers of a pipeline's outputs, for tables and for the micro-batches of a stream."""

from __future__ import annotations

import inspect
import random
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.steps import DevNullSink, ObjectSink, StreamSink
from .inputs import DeadLetters, kafka_sink_options, sink_value


class ObjectStore(ABC):
    """Where an object sink puts its objects; used on the executors, so it must pickle."""

    @abstractmethod
    def put(self, bucket: str, name: str, data: bytes) -> None: ...


class FolderStore(ObjectStore):
    """Buckets as folders of a shared file system."""

    def __init__(self, root: str) -> None:
        self.root = root

    def put(self, bucket: str, name: str, data: bytes) -> None:
        path = Path(self.root, bucket, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


class UriStore(ObjectStore):
    """Buckets below a URI that pyarrow opens: gs://, s3://, hdfs:// or file://; a bucket alone with ``{bucket}`` in it."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def put(self, bucket: str, name: str, data: bytes) -> None:
        uri = self.uri.format(bucket=bucket) if "{bucket}" in self.uri else f"{self.uri.rstrip('/')}/{bucket}"
        system, root = fs.FileSystem.from_uri(uri)
        path = f"{root}/{name}"
        if isinstance(system, (fs.LocalFileSystem, fs.HadoopFileSystem)):
            system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out:
            out.write(data)


def write_objects(df: DataFrame, sink: ObjectSink, store: ObjectStore) -> None:
    """An object per message, by ``thread_count`` tasks at a time."""
    name, bucket = sink.object_generator, sink.bucket
    named = bool(inspect.signature(name).parameters)

    def put(rows: Iterator[Any]) -> None:
        for row in rows:
            store.put(bucket, name((row["src_partition"], row["src_offset"])) if named else name(), bytes(row["value"]))

    sink_value(df, "src_partition", "src_offset").coalesce(max(1, sink.thread_count)).foreachPartition(put)


def discard(df: DataFrame, sink: DevNullSink) -> None:
    """Runs the plan without output; each task sleeps after each ``batch_size`` rows or ``batch_time_ms``."""
    if sink.average_sleep_time_ms is None:
        df.write.format("noop").mode("overwrite").save()
        return
    size, span, average, most = sink.batch_size, sink.batch_time_ms, sink.average_sleep_time_ms, sink.max_sleep_time_ms

    def nap(rows: Iterator[Any]) -> None:
        n, began = 0, time.monotonic()
        for _ in rows:
            n += 1
            if size and n >= size or span and (time.monotonic() - began) * 1000 >= span:
                time.sleep(min(average * random.uniform(0.5, 1.5), most) / 1000)
                n, began = 0, time.monotonic()

    df.foreachPartition(nap)


class AggregationBackend(ABC):
    """Stores windowed aggregates."""

    @abstractmethod
    def flush_aggregate(self, aggregate: Any) -> None: ...


class KVAggregationBackend(AggregationBackend):
    """A mapping in the driver's memory; the last write wins.  For small results only."""

    def __init__(self) -> None:
        self.map: dict[Any, Any] = {}

    def flush_aggregate(self, aggregate: dict[Any, Any]) -> None:
        self.map.update(aggregate)


def flush(df: DataFrame, backend: AggregationBackend) -> None:
    """Each row's payload to the backend, one at a time.

    The backend is an object of the driver, and windows are few beside messages: a
    partition of them at a time is on the driver.
    """
    for row in df.select("payload").toLocalIterator():
        value = row["payload"]
        backend.flush_aggregate(value.asDict() if hasattr(value, "asDict") else value)


class Outputs:
    """Where stream sinks write: a folder of Parquet per stream, or any function of (stream, DataFrame).

    Micro-batches have an id.  In folders each goes to a folder of its own that a repeated
    batch overwrites, so nothing is written twice; a function may be called again.
    """

    def __init__(self, target: str | Callable[[str, DataFrame], None], store: ObjectStore | None = None) -> None:
        self.target, self.store = target, store

    def write(self, sink: Any, df: DataFrame, batch: int | None = None) -> None:
        if isinstance(sink, StreamSink):
            self.stream(sink.stream_name, sink_value(df), sink.name, batch)
        elif isinstance(sink, ObjectSink):
            if self.store is None:
                raise ValueError(f"sink {sink.name}: no object store is bound")
            write_objects(df, sink, self.store)
        elif isinstance(sink, DevNullSink):
            discard(df, sink)
        else:
            raise TypeError(f"sink {sink.name}: unknown kind")

    def stream(self, name: str, df: DataFrame, sink: str, batch: int | None) -> None:
        if callable(self.target):
            self.target(name, df)
        elif batch is None:
            df.write.mode("append").parquet(f"{self.target}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{self.target}/{name}/sink={sink}/batch={batch}")

    def dead(self, target: DeadLetters, df: DataFrame, batch: int | None = None) -> None:
        """Invalid messages with what is known of their origin."""
        self.stream(target.topic, dead_rows(df), "dead-letters", batch)


def dead_rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("raw").alias("value"), "src_partition", "src_offset", "step", "error")


def write_kafka(df: DataFrame, options: Mapping[str, str]) -> None:
    """Rows with ``value``, and maybe ``headers``, into a topic (needs Spark's Kafka connector on the class path)."""
    df.write.format("kafka").options(**options).save()


class KafkaOutputs(Outputs):
    """Stream sinks and dead letters write to Kafka, each to servers and with producer settings of its own.

    ``config``: settings by sink step (``bootstrap_servers``, ``override_params``); dead
    letters have those of their source.  Delivery is at least once.  ``writer`` takes
    (DataFrame, options).
    """

    def __init__(self, config: Mapping[str, Any], store: ObjectStore | None = None, writer: Callable[[DataFrame, Mapping[str, str]], None] = write_kafka) -> None:
        super().__init__("", store)
        self.config, self.writer = config, writer

    def stream(self, name: str, df: DataFrame, sink: str, batch: int | None) -> None:
        settings = self.config.get(sink) or {}
        if not settings.get("bootstrap_servers"):
            raise ValueError(f"sink {sink}: bootstrap_servers are required")
        options = kafka_sink_options(settings, name)
        self.writer(df, options | {"includeHeaders": "true"} if "headers" in df.columns else options)

    def dead(self, target: DeadLetters, df: DataFrame, batch: int | None = None) -> None:
        """The raw bytes as value; the origin, the step and the error as headers."""
        origin = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").cast("binary").alias("value")) for c in ("src_partition", "src_offset", "step", "error")]
        self.writer(dead_rows(df).select("value", F.array(*origin).alias("headers")), dict(target.options) | {"includeHeaders": "true"})
