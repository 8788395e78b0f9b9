"""Steps of a pipeline.  A step only describes; ``translate.py`` turns it into DataFrames."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions.codecs import check_compression
from ..functions.types import DataType, Field, struct_of
from ..operators.grouped import Accumulator, GroupBy, SessionWindow, SlidingWindow, TumblingWindow

#: How long a batch waits if its step names no duration: processing time on a stream, which a table has none of.
DEFAULT_SPAN = datetime.timedelta(seconds=10)

Function = Column | Callable | str


@dataclass
class Step:
    """A named node; ``override`` takes deployment settings, ``validate`` checks the result."""

    name: str

    #: Settings that override fields: setting -> (field, type).
    settings = {}

    def override(self, config: Mapping[str, Any]) -> None:
        for key, (name, kind) in self.settings.items():
            value = config.get(key)
            if value is not None and value != "":
                setattr(self, name, kind(value))

    def validate(self) -> None: ...

    def lower(self) -> Step:
        """The simple step that a composed one stands for."""
        return self


class Source(Step): ...


class Sink(Step): ...


@dataclass
class StreamSource(Source):
    stream_name: str
    header_filter: tuple[str, bytes] | None = None
    consumer_group: str | None = None
    dlq_stream_name: str | None = None
    #: The logical stream, which names the schema and survives a change of the topic.
    logical: str = field(init=False, default="")

    settings = {"topic": ("stream_name", str), "consumer_group": ("consumer_group", str)}

    def __post_init__(self) -> None:
        self.logical = self.stream_name

    def group(self, pipeline: str) -> str:
        """The consumer group: the step's or configuration's, else one named after the pipeline."""
        return self.consumer_group or f"pipeline-{pipeline}"


@dataclass
class Branch(Step): ...


@dataclass
class Map(Step):
    """1:1 by a column expression over the message's columns, or by a callable with its result type."""

    function: Function
    returns: T.DataType | str = "string"


@dataclass
class Filter(Step):
    """Base of filters; use PredicateFilter or HeadersFilter."""

    def __new__(cls, *args: Any, **kwargs: Any):
        if cls is Filter:
            raise TypeError("Filter is abstract; use PredicateFilter or HeadersFilter")
        return super().__new__(cls)


@dataclass
class PredicateFilter(Filter):
    function: Function

    def validate(self) -> None:
        if isinstance(self.function, bool):
            raise TypeError("a predicate is a column expression or a callable")


@dataclass
class HeadersFilter(Filter):
    header_name: str
    value: int

    def __post_init__(self) -> None:
        if not self.header_name:
            raise ValueError("header_name must not be empty")


@dataclass
class FlatMap(Step):
    function: Function
    returns: T.DataType | str = "string"


@dataclass
class Unbatch(Step): ...


@dataclass
class Parser(Step): ...


@dataclass
class BatchParser(Step): ...


@dataclass
class Serializer(Step):
    """``json_style="python"`` gives Python's own JSON text; then ``dt_format`` is a strftime pattern."""

    dt_format: str | None = None
    json_style: str = "spark"


@dataclass
class ParquetSerializer(Step):
    schema_fields: Sequence[Field] | Mapping[str, DataType]
    compression: str = "snappy"

    def __post_init__(self) -> None:
        check_compression(self.compression)

    @property
    def schema(self) -> T.StructType:
        return struct_of(dict(self.schema_fields) if isinstance(self.schema_fields, Mapping) else self.schema_fields)


@dataclass
class Batch(Step):
    """Batches of ``batch_size`` messages or of ``batch_timedelta``, whichever comes first.

    On a table a duration is event time; the default one cuts only batches without a size.
    """

    batch_size: int | None = None
    batch_timedelta: datetime.timedelta | None = DEFAULT_SPAN
    group_by: GroupBy | Mapping[str, Column] | None = None

    def span(self) -> datetime.timedelta | None:
        """The duration by which batches of a table are cut."""
        return None if self.batch_size is not None and self.batch_timedelta is DEFAULT_SPAN else self.batch_timedelta

    def override(self, config: Mapping[str, Any]) -> None:
        if config.get("batch_size") is not None:
            self.batch_size = int(config["batch_size"])
        if config.get("batch_timedelta") is not None:
            self.batch_timedelta = datetime.timedelta(**config["batch_timedelta"])

    def validate(self) -> None:
        if self.batch_size is None and self.batch_timedelta is None:
            raise ValueError(f"batch {self.name}: a size or a duration is needed")
        if self.batch_size is not None and self.batch_size < 1:
            raise ValueError(f"batch {self.name}: the size must be positive")


@dataclass
class Aggregate(Step):
    window: TumblingWindow | SlidingWindow | SessionWindow
    aggregate: Mapping[str, Column] | Callable[[], Accumulator]
    returns: T.DataType | str = "string"
    group_by: GroupBy | Mapping[str, Column] | None = None
    origin: datetime.datetime | None = None
    backend: Any = None
    #: How long a stream's windows wait for late messages, in Spark's interval syntax.
    delay: str = "0 seconds"

    settings = {"watermark_delay": ("delay", str)}

    def validate(self) -> None:
        self.window.check()


@dataclass
class Reducer(Step):
    """Windowed reduction; ``group_by_key`` is {name: column} or a GroupBy, ``aggregate_func`` {name: aggregate} or an Accumulator class."""

    window: TumblingWindow | SlidingWindow | SessionWindow
    aggregate_func: Mapping[str, Column] | Callable[[], Accumulator]
    aggregate_backend: Any = None
    group_by_key: GroupBy | Mapping[str, Column] | None = None
    returns: T.DataType | str = "string"
    origin: datetime.datetime | None = None
    delay: str = "0 seconds"

    def lower(self) -> Step:
        return Aggregate(self.name, self.window, self.aggregate_func, self.returns, self.group_by_key, self.origin, self.aggregate_backend, self.delay)


@dataclass
class Operator(Step):
    """An operator of the user's own: messages in, messages out, as DataFrames.

    ``function`` may use anything that Spark offers, state too (``transformWithState``);
    then ``stateful`` is set, so that a stream runs it in a query of its own.  Envelope
    columns that the result lacks are filled.
    """

    function: Callable[[DataFrame], DataFrame]
    stateful: bool = False


@dataclass
class Router(Step):
    routing_function: Function
    #: key -> name of the branch's root step.
    table: Mapping[Any, str]


@dataclass
class Broadcast(Step):
    branches: Sequence[str]


@dataclass
class StreamSink(Sink):
    stream_name: str

    settings = {"topic": ("stream_name", str)}


@dataclass
class ObjectSink(Sink):
    """An object per message in a bucket, named by a callable.

    A callable with a parameter gets the message's (source partition, offset); names made
    from these are the same when a task or micro-batch is repeated, so nothing is doubled.
    """

    bucket: str
    object_generator: Callable[..., str]
    thread_count: int = 1

    settings = {"bucket": ("bucket", str)}

    def override(self, config: Mapping[str, Any]) -> None:
        super().override(config)
        threads = (config.get("parallelism") or {}).get("threads")
        if threads is not None:
            self.thread_count = int(threads)


GCSSink = ObjectSink


@dataclass
class DevNullSink(Sink):
    """Discards; can sleep like a slow store, uniformly between half and one and a half of the average."""

    batch_size: int | None = None
    batch_time_ms: float | None = None
    average_sleep_time_ms: float | None = None
    max_sleep_time_ms: float | None = None

    settings = {"batch_size": ("batch_size", int), "batch_time_ms": ("batch_time_ms", float), "average_sleep_time_ms": ("average_sleep_time_ms", float), "max_sleep_time_ms": ("max_sleep_time_ms", float)}

    def __post_init__(self) -> None:
        self.validate()

    def validate(self) -> None:
        if self.average_sleep_time_ms is not None and self.max_sleep_time_ms is None:
            raise ValueError("average_sleep_time_ms needs max_sleep_time_ms")
