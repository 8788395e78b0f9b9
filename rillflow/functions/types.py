"""Declared column types and their Spark counterparts.

Unsigned integers widen to the next signed type (64 bits to a decimal) and carry a
range check; times of day are microseconds as a long; nanosecond units are refused,
because Spark keeps microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DataType:
    """A declared type; ``spark`` is its Spark type and ``valid`` a condition on values, if it needs one."""

    @property
    def spark(self) -> T.DataType:
        return _PLAIN[type(self).__name__]()

    def valid(self, column: Column) -> Column | None:
        top = _UNSIGNED_BITS.get(type(self).__name__)
        return None if top is None else column.isNull() | column.between(F.lit(0), F.expr(f"cast({2**top - 1} as decimal(20,0))"))


_PLAIN = {
    "Boolean": T.BooleanType, "Int8": T.ByteType, "Int16": T.ShortType, "Int32": T.IntegerType, "Int64": T.LongType,
    "Uint8": T.ShortType, "Uint16": T.IntegerType, "Uint32": T.LongType, "Uint64": lambda: T.DecimalType(20, 0),
    "Float32": T.FloatType, "Float64": T.DoubleType, "String": T.StringType, "Utf8": T.StringType, "Binary": T.BinaryType,
    "Date": T.DateType, "Null": T.NullType, "Time": T.LongType,
}
_UNSIGNED_BITS = {"Uint8": 8, "Uint16": 16, "Uint32": 32, "Uint64": 64}

Boolean, Int8, Int16, Int32, Int64, Uint8, Uint16, Uint32, Uint64, Float32, Float64, String, Utf8, Binary, Date, Null, Time = (
    dataclass(frozen=True)(type(name, (DataType,), {"__doc__": f"Declared type {name}."})) for name in _PLAIN if name
)


def _microseconds(unit: str) -> None:
    if unit not in ("us", "ms"):
        raise ValueError(f"unit {unit!r}: Spark keeps microseconds, so only us and ms are accepted")


@dataclass(frozen=True)
class Decimal(DataType):
    precision: int = 38
    scale: int = 10

    @property
    def spark(self) -> T.DataType:
        return T.DecimalType(self.precision, self.scale)


@dataclass(frozen=True)
class Datetime(DataType):
    """With a time zone an instant, without one local time."""

    timezone: str | None = None
    unit: str = "us"

    @property
    def spark(self) -> T.DataType:
        _microseconds(self.unit)
        return T.TimestampType() if self.timezone else T.TimestampNTZType()


@dataclass(frozen=True)
class Duration(DataType):
    unit: str = "us"

    @property
    def spark(self) -> T.DataType:
        _microseconds(self.unit)
        return T.DayTimeIntervalType()


@dataclass(frozen=True)
class List(DataType):
    inner: DataType

    @property
    def spark(self) -> T.DataType:
        return T.ArrayType(self.inner.spark)


@dataclass(frozen=True)
class Field:
    name: str
    dtype: DataType


@dataclass(frozen=True)
class Struct(DataType):
    fields: tuple[Field, ...] = field(default_factory=tuple)

    @property
    def spark(self) -> T.DataType:
        return T.StructType([T.StructField(f.name, f.dtype.spark) for f in self.fields])


def struct_of(fields: Sequence[Field] | dict[str, DataType]) -> T.StructType:
    """The StructType of declared fields."""
    if isinstance(fields, dict):
        fields = [Field(k, v) for k, v in fields.items()]
    return Struct(tuple(fields)).spark
