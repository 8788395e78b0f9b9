"""Codecs: JSON to typed payloads and back, and rows to Parquet bytes."""

from __future__ import annotations

import datetime
import io
import json
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Compressions of the Parquet serializer; the two others that users may name have no codec in this Spark.
COMPRESSIONS = ("lz4", "uncompressed", "snappy", "gzip", "zstd")
UNSUPPORTED_COMPRESSIONS = ("lzo", "brotli")

_CORRUPT = "_corrupt"


class SchemaRegistry:
    """Payload schemas by logical stream name."""

    def __init__(self, schemas: dict[str, T.StructType | str] | None = None) -> None:
        self._schemas: dict[str, T.StructType | str] = {}
        for name, schema in (schemas or {}).items():
            self.add(name, schema)

    def add(self, name: str, schema: T.StructType | str) -> None:
        self._schemas[name] = schema

    def get(self, name: str | None) -> T.StructType:
        if name is None:
            raise ValueError("a parser needs messages with a schema name")
        if name not in self._schemas:
            raise ValueError(f"no schema is registered for stream {name!r}")
        schema = self._schemas[name]
        return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def parse_json(value: Column, schema: T.StructType) -> tuple[Column, Column]:
    """(payload, error) of JSON bytes or text: malformed input, wrong types and missing required fields are errors.

    The error quotes the first 200 characters; dead letters hold the raw bytes whole.
    """
    text = value.cast("string")
    loose = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema), T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(text, loose, {"columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE"})
    missing = [F.when(parsed[f.name].isNull(), f.name) for f in schema if not f.nullable]
    error = F.when(parsed.isNull() | parsed[_CORRUPT].isNotNull(), F.concat(F.lit("malformed: "), F.coalesce(F.substring(text, 1, 200), F.lit("null"))))
    if missing:
        error = F.coalesce(error, F.when(F.concat_ws(",", *missing) != "", F.concat(F.lit("missing: "), F.concat_ws(",", *missing))))
    payload = F.when(error.isNull(), F.struct(*(parsed[f.name].alias(f.name) for f in schema)))
    return payload, error


def to_json(payload: Column, dt_format: str | None = None) -> Column:
    """Compact JSON bytes that keep nulls; ``dt_format`` is a Spark datetime pattern for timestamps."""
    options = {"ignoreNullFields": "false"} | ({"timestampFormat": dt_format, "timestampNTZFormat": dt_format} if dt_format else {})
    return F.to_json(payload, options).cast("binary")


class _Times(json.JSONEncoder):
    """Times by a strftime pattern, or in ISO form without one."""

    pattern: str | None = None

    def default(self, o: Any) -> Any:
        if not isinstance(o, datetime.datetime):
            return super().default(o)
        return o.isoformat() if self.pattern is None else o.strftime(self.pattern)


def dumps(value: Any, dt_format: str | None = None) -> bytes:
    """Python's own JSON text, byte for byte; values that aren't JSON or times raise a TypeError."""
    encoder = _Times()
    encoder.pattern = dt_format or None
    return encoder.encode(value).encode()


def check_compression(name: str) -> str:
    if name in UNSUPPORTED_COMPRESSIONS:
        raise ValueError(f"compression {name!r} has no codec in this Spark; use one of {', '.join(COMPRESSIONS)}")
    if name not in COMPRESSIONS:
        raise ValueError(f"unknown compression {name!r}")
    return name


def parquet_bytes(items: pa.ChunkedArray, schema: pa.Schema, compression: str) -> bytes:
    """One Parquet file without statistics of struct or map items, by field name; null items are left out."""
    items = items.drop_null()
    if pa.types.is_struct(items.type) and all(items.type.get_field_index(f.name) < 0 or items.type.field(f.name).type == f.type for f in schema):
        table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(c) for c in items.chunks], pa.schema(list(items.type)))
        table = pa.Table.from_arrays([table.column(f.name) if f.name in table.schema.names else pa.nulls(len(items), f.type) for f in schema], schema=schema)
    else:  # what Python values convert to
        table = pa.Table.from_pylist(items.to_pylist(maps_as_pydicts="strict"), schema)
    out = io.BytesIO()
    pq.write_table(table, out, compression="none" if compression == "uncompressed" else compression, write_statistics=False)
    return out.getvalue()
