"""Operators over many messages of bounded inputs: batches, windows and reductions.

Count windows follow (source partition, offset), as offsets repeat across partitions.
Numbering is two-level (counts of offset ranges, then ranks inside a range), so a
stream without keys doesn't have to pass through one task.
"""

from __future__ import annotations

import datetime
import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.message import call, to_column, values, with_column

#: The order of messages: columns, the last of them a bigint.
ORDER = ("src_partition", "src_offset")
#: Offsets in one numbering range.
RANGE_ROWS = 1 << 20


class Accumulator(ABC):
    """A user-defined aggregate: partial ones are built in tasks, pickled and merged."""

    @abstractmethod
    def add(self, value: Any) -> Accumulator: ...

    @abstractmethod
    def get_value(self) -> Any: ...

    @abstractmethod
    def merge(self, other: Accumulator) -> Accumulator: ...


class KVAccumulator(Accumulator):
    """An accumulator whose value is a mapping."""


class GroupBy(ABC):
    """Gives the key of a payload; ``returns`` is the key's type, ``name`` its column."""

    returns: T.DataType | str = "string"
    name = "group_key"

    @abstractmethod
    def get_group_by_key(self, payload: Any) -> Any: ...


def keyed(df: DataFrame, group_by: GroupBy | Mapping[str, Column] | None) -> tuple[DataFrame, list[str]]:
    """``df`` with its key columns, and their names."""
    if group_by is None:
        return df, []
    if isinstance(group_by, GroupBy):
        key = call(lambda m: group_by.get_group_by_key(m.payload), group_by.returns, catch=False)
        return df.withColumn(group_by.name, key["value"]), [group_by.name]
    return df.withColumns(dict(group_by)), list(group_by)


@dataclass(frozen=True)
class TumblingWindow:
    """Windows of ``window_size`` messages, or of ``window_timedelta`` of event time."""

    window_size: int | None = None
    window_timedelta: datetime.timedelta | None = None

    def check(self) -> None:
        if self.window_size is None and self.window_timedelta is None:
            raise ValueError("a tumbling window needs a size or a duration")
        if self.window_size is not None and (not isinstance(self.window_size, int) or self.window_size < 1):
            raise ValueError("window_size must be a positive number of messages")
        if self.window_timedelta is not None and self.window_timedelta <= datetime.timedelta(0):
            raise ValueError("window_timedelta must be positive")


@dataclass(frozen=True)
class SlidingWindow:
    """Overlapping windows of event time: ``window_size`` long, one every ``window_slide``."""

    window_size: datetime.timedelta
    window_slide: datetime.timedelta

    def check(self) -> None:
        if not all(isinstance(x, datetime.timedelta) for x in (self.window_size, self.window_slide)):
            raise TypeError("sliding windows are durations")
        second = datetime.timedelta(seconds=1)
        if self.window_slide <= datetime.timedelta(0) or self.window_slide > self.window_size:
            raise ValueError("the slide must be positive and not above the size")
        if self.window_size % second or self.window_slide % second:
            raise ValueError("size and slide must be whole seconds")
        if self.window_size % self.window_slide:
            raise ValueError("the size must be a multiple of the slide")


@dataclass(frozen=True)
class SessionWindow:
    """Windows of event time that end after ``gap`` without a message of the key."""

    gap: datetime.timedelta

    def check(self) -> None:
        if self.gap <= datetime.timedelta(0):
            raise ValueError("the gap must be positive")


def sessions(df: DataFrame, window: SessionWindow, aggregate: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """Sessions by key, aggregated by column expressions; on a stream ``df`` has a watermark."""
    if callable(aggregate):
        raise ValueError("session windows take column aggregates, as sessions merge while they grow")
    w = F.session_window("timestamp", interval(window.gap))
    out = df.groupBy(*keys, w.alias("_w")).agg(*(c.alias(f"_a_{n}") for n, c in aggregate.items()))
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), F.struct(*(F.col(f"_a_{n}").alias(n) for n in aggregate)).alias("payload"))


def utc(origin: datetime.datetime) -> datetime.datetime:
    """An origin without a zone is taken for UTC, on tables and streams alike."""
    return origin if origin.tzinfo else origin.replace(tzinfo=datetime.timezone.utc)


def offset_of(origin: datetime.datetime | None, slide: datetime.timedelta) -> datetime.timedelta:
    """How far windows are shifted from multiples of the slide since the epoch."""
    if origin is None:
        return datetime.timedelta(0)
    return (utc(origin) - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) % slide


def interval(x: datetime.timedelta) -> str:
    return f"{round(x.total_seconds() * 1_000_000)} microseconds"


def numbered(df: DataFrame, order: str | Sequence[str] = ORDER, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_n``: 0, 1, ... in the order of the columns, the last a bigint, for each key."""
    order = [order] if isinstance(order, str) else list(order)
    for c in order:
        if c not in df.columns:
            raise ValueError(f"count windows need an order column, and there is no {c!r}")
    *first, last = order
    # the columns before the offset, and the offset's range
    ranged = df.withColumns({f"_f{i}": F.col(c) for i, c in enumerate(first)} | {"_range": F.expr(f"{last} div {RANGE_ROWS}")})
    by = [*(f"_f{i}" for i in range(len(first))), "_range"]
    counts = ranged.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    named = {k: f"_k{i}" for i, k in enumerate([*keys, *by])}
    starts = counts.select(*(F.col(k).alias(n) for k, n in named.items()), F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.lit(True)
    for k, n in named.items():
        same &= F.col(k).eqNullSafe(F.col(n))
    rank = F.row_number().over(Window.partitionBy(*keys, *by).orderBy(last))
    return ranged.join(starts, same).withColumn("_n", F.col("_start") + rank - 1).select(*df.columns, "_n")


def batch(df: DataFrame, size: int | None, *, span: datetime.timedelta | None = None, keys: Sequence[str] = (), order: str | Sequence[str] = ORDER) -> DataFrame:
    """Batches of ``size`` payloads in order; the last may be smaller (a bounded input is flushed at its end).

    With ``span`` batches are also cut at multiples of it from the key's first message
    time.  One row each: keys, batch number, payload array, time of the last message,
    schema, source partition and offset of the batch's first message.
    """
    if size is None and span is None:
        raise ValueError("a batch needs a size or a duration")
    order = [order] if isinstance(order, str) else list(order)
    groups = list(keys)
    if span is not None:
        if keys:
            first = df.groupBy(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys))).agg(F.min("timestamp").alias("_first"))
            same = F.lit(True)
            for i, k in enumerate(keys):
                same &= F.col(k).eqNullSafe(F.col(f"_s{i}"))
            df = df.join(first, same).drop(*(f"_s{i}" for i in range(len(keys))))
        else:
            df = df.withColumn("_first", df.agg(F.min("timestamp")).scalar())
        df = df.withColumn("_span", F.expr(f"(unix_micros(timestamp) - unix_micros(_first)) div {round(span.total_seconds() * 1e6)}")).drop("_first")
        groups.append("_span")
    df = numbered(df, order, groups) if size is not None else df.withColumn("_n", F.lit(0))
    df = df.withColumn("_batch", F.expr(f"_n div {size or 1}"))
    place = F.struct(*order)
    items = F.sort_array(F.collect_list(F.struct(place.alias("o"), F.col("payload").alias("p"))))
    firsts = [F.min_by(c, place).alias(c) for c in ("schema", *order)]
    out = df.groupBy(*groups, "_batch").agg(items.alias("_items"), F.max("timestamp").alias("timestamp"), *firsts)
    return out.select(*keys, F.transform("_items", lambda i: i["p"]).alias("payload"), "timestamp", "schema", *order)


def windowed(df: DataFrame, window: TumblingWindow | SlidingWindow, *, keys: Sequence[str] = (), order: str | Sequence[str] = ORDER, origin: datetime.datetime | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with its window columns, and their names.

    Event-time windows give ``window_start`` and ``window_end``; they start at multiples
    of the slide from ``origin`` (default: the epoch), and with an origin none starts
    before it.  Count windows give ``window_number``.
    """
    window.check()
    if isinstance(window, TumblingWindow) and window.window_size is not None:
        if window.window_timedelta is not None:
            df, _ = windowed(df, TumblingWindow(window_timedelta=window.window_timedelta), origin=origin)
            keys = [*keys, "window_start", "window_end"]
        out = numbered(df, order, keys).withColumn("window_number", F.expr(f"_n div {window.window_size}")).drop("_n")
        return out, [k for k in ("window_start", "window_end") if k in keys] + ["window_number"]
    size, slide = (window.window_timedelta, window.window_timedelta) if isinstance(window, TumblingWindow) else (window.window_size, window.window_slide)
    out = df.withColumn("_w", F.window("timestamp", interval(size), interval(slide), interval(offset_of(origin, slide))))
    if origin is not None:
        out = out.where(F.col("_w.start") >= F.lit(utc(origin)))
    return out.withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w"), ["window_start", "window_end"]


def accumulate(df: DataFrame, groups: Sequence[str], accumulator: Callable[[], Accumulator], returns: T.DataType | str) -> DataFrame:
    """One row per group: its columns and ``payload``, the merged accumulator's value.

    Tasks build partial accumulators, so a hot group reaches its merging task as a few
    pickled partials, not as rows.  A task's rows are sorted by group, so it has one
    partial of each group and one accumulator open at a time, however many groups there are.
    """
    returns = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    if groups:
        df = df.sortWithinPartitions(*groups, *(c for c in ORDER if c in df.columns)).select(*groups, "payload")
    else:
        df = df.select(F.lit(0).alias("_all"), "payload")
    names = list(groups) or ["_all"]
    kept = [T.StructField(n, df.schema[n].dataType) for n in names]
    make = cloudpickle.dumps(accumulator)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, key, total = pickle.loads(make), None, None
        for b in batches:
            keys, payloads = b.select(names), values(b.column("payload"))
            if not payloads:
                continue
            goes_on = key is not None and key.equals(keys.slice(0, 1))
            ended = [] if key is None or goes_on else [key]
            data = [_pickled(total)] if ended else []
            starts = np.flatnonzero(np.any([_changes(c) for c in keys.columns], axis=0)).tolist()
            for lo, hi in pairwise([*starts, len(payloads)]):
                if lo:
                    data.append(_pickled(total))
                if lo or not goes_on:
                    total = new()
                for value in payloads[lo:hi]:
                    total = total.add(value)
            yield from with_column([*ended, keys.take(pa.array(starts[:-1], pa.int64()))], "_acc", pa.array(data, pa.binary()))
            key = keys.take(pa.array(starts[-1:]))
        if key is not None:
            yield from with_column([key], "_acc", pa.array([_pickled(total)], pa.binary()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("_acc").to_pylist():
                total = pickle.loads(parts[0])
                for data in parts[1:]:
                    total = total.merge(pickle.loads(data))
                out.append(total.get_value())
            yield from with_column([b.select(names)], "payload", to_column(out, returns))

    partials = df.mapInArrow(partial, T.StructType([*kept, T.StructField("_acc", T.BinaryType())]))
    out = partials.groupBy(*names).agg(F.collect_list("_acc").alias("_acc")).mapInArrow(merge, T.StructType([*kept, T.StructField("payload", returns)]))
    return out if groups else out.drop("_all")


def _pickled(accumulator: Accumulator) -> bytes:
    try:
        return pickle.dumps(accumulator)
    except Exception:  # a class that can't be imported by its name
        return cloudpickle.dumps(accumulator)


def _changes(column: pa.Array) -> np.ndarray:
    """True at the first value and where one differs from that before; maybe also elsewhere (NaN)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    try:
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    except pa.ArrowNotImplementedError:  # nested keys
        differ = [x != y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    return np.r_[True, np.asarray(differ, bool)]


def reduce_messages(
    df: DataFrame,
    window: TumblingWindow | SlidingWindow | SessionWindow,
    aggregate: Mapping[str, Column] | Callable[[], Accumulator],
    *,
    returns: T.DataType | str = "string",
    group_by: GroupBy | Mapping[str, Column] | None = None,
    order: str | Sequence[str] = ORDER,
    origin: datetime.datetime | None = None,
) -> DataFrame:
    """Windows by key, aggregated by column expressions or an Accumulator.

    Columns: the keys, the window's columns and ``payload`` (a struct of the named
    aggregates, or the accumulator's value).  Empty windows are never given.
    """
    window.check()
    df, keys = keyed(df, group_by)
    if isinstance(window, SessionWindow):
        return sessions(df, window, aggregate, keys)
    df, names = windowed(df, window, keys=keys, order=order, origin=origin)
    groups = [*keys, *names]
    if callable(aggregate):
        return accumulate(df, groups, aggregate, returns)
    out = df.groupBy(*groups).agg(*(c.alias(f"_a_{n}") for n, c in aggregate.items()))
    return out.select(*groups, F.struct(*(F.col(f"_a_{n}").alias(n) for n in aggregate)).alias("payload"))
