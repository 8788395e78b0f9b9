"""Operators on single messages: map, filters, flat map, parsers and serialisers.

Each takes messages and returns (good, bad); ``bad`` is None where nothing can fail,
else rows with an ``error`` for the dead letters.  Column expressions stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.codecs import SchemaRegistry, check_compression, dumps, parquet_bytes, parse_json, to_json
from ..functions.message import HEADERS, call, resolve, with_column

Result = tuple[DataFrame, DataFrame | None]


def split_errors(df: DataFrame, error: str = "_error") -> Result:
    """Rows without and with an error; both sides read the same plan."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull()).withColumnRenamed(error, "error")


Keep = Callable[[DataFrame], DataFrame]


def _called(df: DataFrame, function: Callable | str, returns: T.DataType | str, catch: bool, keep: Keep | None) -> DataFrame:
    """``keep`` holds the results where both sides of a split are read, so that a callable runs once for both."""
    out = df.withColumn("_out", call(function, returns, catch=catch)).withColumn("_error", F.col("_out.error"))
    return keep(out) if keep and catch else out


def map_messages(df: DataFrame, function: Column | Callable | str, returns: T.DataType | str = "string", *, catch: bool = False, drop_headers: bool = False, keep: Keep | None = None) -> Result:
    """1:1.  Time and schema stay; headers too, unless ``drop_headers``."""
    headers = F.array().cast(HEADERS) if drop_headers else F.col("headers")
    if isinstance(function, Column):
        return df.withColumns({"payload": function, "headers": headers}), None
    out = _called(df, function, returns, catch, keep)
    good, bad = split_errors(out) if catch else (out.drop("_error"), None)
    good = good.withColumns({"payload": F.col("_out.value"), "headers": headers}).drop("_out")
    return good, None if bad is None else bad.drop("_out")


def filter_messages(df: DataFrame, function: Column | Callable | str, *, catch: bool = False, keep: Keep | None = None) -> Result:
    """Keeps messages for which the condition is true; null and false drop them."""
    if isinstance(function, Column):
        return df.where(function), None
    out = _called(df, function, "boolean", catch, keep)
    good, bad = split_errors(out) if catch else (out.drop("_error"), None)
    return good.where("_out.value").drop("_out"), None if bad is None else bad.drop("_out")


def filter_header(df: DataFrame, name: str, value: int, *, catch: bool = True) -> Result:
    """Keeps messages with a header ``name`` that is ``value`` as decimal text.

    Any non-empty value under that name that isn't UTF-8 text of a 64-bit integer makes
    the message invalid, even if another one matches.  Missing, empty and other values drop it.
    """
    if not name:
        raise ValueError("the header's name must not be empty")
    named = F.filter("headers", lambda h: (h["key"] == name) & (F.octet_length(h["value"]) > 0))
    text = lambda h: F.when(F.is_valid_utf8(h["value"].cast("string")), h["value"].cast("string"))
    number = lambda h: F.when(F.coalesce(text(h).rlike("^[+-]?[0-9]+$"), F.lit(False)), text(h).try_cast("bigint"))
    invalid = F.exists(named, lambda h: number(h).isNull())
    matches = F.exists(named, lambda h: number(h) == value)
    bad = df.where(invalid).withColumn("error", F.lit(f"header {name} is not a decimal integer"))
    if not catch:
        invalid = F.when(invalid, F.raise_error(F.lit(f"header {name} is not a decimal integer")).cast("boolean")).otherwise(False)
    return df.where(~invalid & matches), bad if catch else None


def filter_header_bytes(df: DataFrame, name: str, value: bytes) -> DataFrame:
    """Keeps messages with exactly this (name, value) among their headers."""
    return df.where(F.exists("headers", lambda h: (h["key"] == name) & (h["value"] == F.lit(value))))


def flat_map(df: DataFrame, function: Column | Callable | str, returns: T.DataType | str = "string", *, catch: bool = False, keep: Keep | None = None) -> Result:
    """1:0..N: an array column, or a callable that returns an iterable; null and empty give no message."""
    if isinstance(function, Column):
        return df.withColumn("payload", F.explode(function)), None
    kind = T.ArrayType(T._parse_datatype_string(returns) if isinstance(returns, str) else returns)
    inner = resolve(function)
    out = _called(df, lambda m: list(inner(m)), kind, catch, keep)
    good, bad = split_errors(out) if catch else (out.drop("_error"), None)
    return good.withColumn("payload", F.explode("_out.value")).drop("_out"), None if bad is None else bad.drop("_out")


def unbatch(df: DataFrame) -> DataFrame:
    """The items of array payloads, in order."""
    return df.select("*", F.posexplode("payload").alias("_pos", "_item")).withColumn("payload", F.col("_item")).drop("_pos", "_item")


def parse(df: DataFrame, stream: str | None, registry: SchemaRegistry) -> Result:
    """JSON bytes to the stream's typed payload."""
    payload, error = parse_json(F.col("payload"), registry.get(stream))
    out = df.withColumns({"_parsed": payload, "_error": error})
    good, bad = split_errors(out)
    return good.withColumn("payload", F.col("_parsed")).drop("_parsed"), bad.drop("_parsed")


def parse_batch(df: DataFrame, stream: str | None, registry: SchemaRegistry) -> Result:
    """Arrays of JSON bytes to arrays of typed payloads; one bad item makes the batch bad."""
    schema = registry.get(stream)
    items = F.transform("payload", lambda x: F.struct(*(c.alias(n) for c, n in zip(parse_json(x, schema), ("v", "e"), strict=True))))
    out = df.withColumn("_items", items).withColumn("_error", F.array_join(F.filter(F.transform("_items", lambda i: i["e"]), lambda e: e.isNotNull()), "; "))
    out = out.withColumn("_error", F.when(F.col("_error") != "", F.col("_error")))
    good, bad = split_errors(out)
    return good.withColumn("payload", F.transform("_items", lambda i: i["v"])).drop("_items"), bad.drop("_items")


def serialize(df: DataFrame, dt_format: str | None = None, *, style: str = "spark") -> DataFrame:
    """Payloads to JSON bytes.  ``style="python"`` gives Python's own spacing and escapes (and a strftime ``dt_format``)."""
    if style == "spark":
        return df.withColumn("payload", to_json(F.col("payload"), dt_format))
    return df.withColumn("payload", call(lambda m: dumps(m.payload, dt_format), "binary", catch=False)["value"])


def serialize_parquet(df: DataFrame, schema: T.StructType, compression: str = "snappy") -> DataFrame:
    """Array payloads to the bytes of one Parquet file each; a null payload fails the query.

    The items go to Python as rows of their own, next to each other, so that an Arrow
    batch is bounded by items and a task holds one message's at a time.
    """
    check_compression(compression)
    fields = pa.schema(to_arrow_schema(schema))
    others = [c for c in df.columns if c != "payload"]
    payload = F.coalesce("payload", F.raise_error(F.lit("a Parquet file needs an array of items, not null")).cast(df.schema["payload"].dataType))
    items = df.select(*others, F.posexplode_outer(payload).alias("_pos", "_item"))
    first = F.coalesce(F.col("_pos") == 0, F.lit(True))
    # the other columns go along with a message's first item only
    items = items.select(*(F.when(first, F.col(c)).alias(c) for c in others), first.alias("_first"), "_item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        for b in batches:
            item, starts = b.column("_item"), np.flatnonzero(b.column("_first").to_numpy(zero_copy_only=False))
            if not len(starts):
                parts.append(item)
                continue
            if starts[0]:
                parts.append(item.slice(0, starts[0]))
            envelope = b.select(others)
            heads = [envelope.take(pa.array(starts[:-1]))]
            groups = [[item.slice(i, j - i)] for i, j in pairwise(starts.tolist())]
            if head is not None:
                heads, groups = [head, *heads], [parts, *groups]
            yield from files(heads, groups)
            head, parts = envelope.take(pa.array(starts[-1:])), [item.slice(starts[-1])]
        if head is not None:
            yield from files([head], [parts])

    def files(heads: list[pa.RecordBatch], groups: list[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        yield from with_column(heads, "payload", pa.array([parquet_bytes(pa.chunked_array(g), fields, compression) for g in groups], pa.binary()))

    kinds = [T.StructField(c, items.schema[c].dataType) for c in others]
    return items.mapInArrow(run, T.StructType([*kinds, T.StructField("payload", T.BinaryType())])).select(*df.columns)
