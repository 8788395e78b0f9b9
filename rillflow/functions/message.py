"""Messages as rows, and calling Python functions on them.

A message is a row of ``ENVELOPE`` columns around a typed ``payload`` column.  Column
expressions run in the JVM; a Python callable sees a ``Message`` and travels in Arrow
batches.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.conversion import LocalDataToArrowConversion
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import InvalidMessageError

HEADERS = "array<struct<key:string,value:binary>>"
ENVELOPE = ("headers", "timestamp", "schema", "src_partition", "src_offset")


@dataclass
class Message:
    """What a Python callable gets: payload, headers as (name, bytes), time in epoch seconds, schema name."""

    payload: Any
    headers: list[tuple[str, bytes]] = field(default_factory=list)
    timestamp: float = 0.0
    schema: str | None = None

    def size(self) -> int | None:
        """Length of a str or bytes payload, else None."""
        return len(self.payload) if isinstance(self.payload, (str, bytes)) else None


def resolve(function: Callable | str) -> Callable:
    """A callable, or the one named by ``"module.Class.function"``."""
    if callable(function):
        return function
    module, cls, name = function.rsplit(".", 2)
    return getattr(getattr(importlib.import_module(module), cls), name)


def _local_times(kind: pa.DataType) -> Callable | None:
    """What turns the instants in a value of this type into local times without a zone, as Spark's rows have them; None if it holds none."""
    if pa.types.is_timestamp(kind):
        return None if kind.tz is None else lambda v: v.astimezone().replace(tzinfo=None)
    if pa.types.is_struct(kind):
        inner = {f.name: c for f in kind if (c := _local_times(f.type))}
        return (lambda v: v | {k: c(v[k]) for k, c in inner.items() if v[k] is not None}) if inner else None
    if pa.types.is_list(kind):
        item = _local_times(kind.value_type)
        return item and (lambda v: [None if x is None else item(x) for x in v])
    if pa.types.is_map(kind):
        key, item = _local_times(kind.key_type) or (lambda x: x), _local_times(kind.item_type) or (lambda x: x)
        return (lambda v: {key(k): None if x is None else item(x) for k, x in v.items()}) if _local_times(kind.key_type) or _local_times(kind.item_type) else None
    return None


def values(column: pa.Array) -> list[Any]:
    """A column as user code expects it: rows and maps as dicts, arrays as lists."""
    out, convert = column.to_pylist(maps_as_pydicts="strict"), _local_times(column.type)
    return [None if v is None else convert(v) for v in out] if convert else out


def to_column(out: list[Any], returns: T.DataType) -> pa.Array:
    """What user code has returned as a column, with the conversions of Spark's Python functions."""
    convert, kind = LocalDataToArrowConversion._create_converter(returns, none_on_identity=True), to_arrow_type(returns)
    out = [convert(v) for v in out] if convert else out
    try:
        return pa.array(out, kind)
    except pa.ArrowInvalid:
        return pa.array(out).cast(kind)


def _plain(value: Any) -> Any:
    """Rows as dicts and arrays as lists, as user code expects."""
    if isinstance(value, T.Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return bytes(value) if isinstance(value, bytearray) else value


def with_column(batches: list[pa.RecordBatch], name: str, column: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` as one batch with a further column."""
    yield from pa.Table.from_batches(batches).append_column(name, column).combine_chunks().to_batches()


def call(function: Callable | str, returns: T.DataType | str, *, catch: bool) -> Column:
    """struct<value, error> of ``function(Message)`` on each row.

    With ``catch`` an InvalidMessageError becomes the row's error; any other exception
    (and without ``catch`` that one too) fails the query.
    """
    run = resolve(function)
    returns = T._parse_datatype_string(returns) if isinstance(returns, str) else returns

    def apply(rows: pa.Array) -> pa.Array:
        out, errors = [], []
        for payload, headers, seconds, schema in zip(*(values(rows.field(k)) for k in range(4)), strict=True):
            try:
                out.append(run(Message(payload, [(h["key"], h["value"] or b"") for h in headers or ()], seconds or 0.0, schema)))
                errors.append(None)
            except InvalidMessageError as e:
                if not catch:
                    raise
                out.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pa.StructArray.from_arrays([to_column(out, returns), pa.array(errors, pa.string())], ["value", "error"])

    kind = T.StructType([T.StructField("value", returns), T.StructField("error", T.StringType())])
    row = F.struct("payload", "headers", F.col("timestamp").cast("timestamp").cast("double").alias("seconds"), "schema")
    return F.arrow_udf(apply, kind)(row)


def to_messages(df: DataFrame, payload: Column, *, schema: str | None = None, timestamp: Column | None = None, offset: Column | None = None, partition: Column | None = None, headers: Column | None = None) -> DataFrame:
    """Any table as messages; a missing time is the epoch, missing headers are empty."""
    return df.select(
        payload.alias("payload"),
        F.coalesce(F.lit(None).cast(HEADERS) if headers is None else headers.cast(HEADERS), F.array().cast(HEADERS)).alias("headers"),
        (F.lit(0).cast("timestamp") if timestamp is None else F.coalesce(timestamp.cast("timestamp"), F.lit(0).cast("timestamp"))).alias("timestamp"),
        F.lit(schema).cast("string").alias("schema"),
        (F.lit(0) if partition is None else partition.cast("int")).alias("src_partition"),
        (F.lit(None).cast("bigint") if offset is None else offset.cast("bigint")).alias("src_offset"),
    )


def from_kafka(df: DataFrame, stream: str) -> DataFrame:
    """Messages of a table in the Kafka source's layout: null values and null header values become empty bytes."""
    headers = F.transform("headers", lambda h: F.struct(h["key"].alias("key"), F.coalesce(h["value"], F.lit(b"")).alias("value")))
    return to_messages(df, F.coalesce("value", F.lit(b"")), schema=stream, timestamp=F.col("timestamp"), offset=F.col("offset"), partition=F.col("partition"), headers=headers)
