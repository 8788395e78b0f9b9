"""Stateful operators on streams: batches and custom accumulators in Spark's state store (RocksDB)."""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.message import _plain
from ..operators.grouped import Accumulator, GroupBy, SessionWindow, SlidingWindow, TumblingWindow, interval, keyed, offset_of, sessions, utc, windowed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(df: DataFrame) -> None:
    """Stateful processors need the RocksDB provider; a session that names another one keeps it."""
    conf = df.sparkSession.conf
    if not conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Batches(StatefulProcessor):
    """Items in arrival order; full batches at once, the rest when the time since its first item is up."""

    def __init__(self, size: int | None, span_ms: int | None, item: T.StructType, names: list[str]) -> None:
        self.size, self.span_ms, self.item, self.names = size, span_ms, item, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", self.item)

    def _row(self, key: tuple, items: list[Row]) -> Row:
        return Row(*self.names)(*key, [i[0] for i in items], max(i[1] for i in items), *items[0][2:])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = [tuple(r) for r in self.items.get()] if self.items.exists() else []
        was_open = bool(held)
        # a micro-batch brings the rows of several partitions mixed
        for row in sorted(rows, key=lambda r: (r["src_partition"] or 0, r["src_offset"] or 0)):
            held.append((row["payload"], row["timestamp"], row["schema"], row["src_partition"], row["src_offset"]))
            if self.size is not None and len(held) >= self.size:
                yield self._row(key, held)
                held, was_open = [], False
                self._forget()
        if held:
            self.items.put(held)
            if not was_open and self.span_ms is not None:
                self._forget()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.span_ms)
        else:
            self.items.clear()

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = [tuple(r) for r in self.items.get()] if self.items.exists() else []
        self.items.clear()
        if held:
            yield self._row(key, held)

    def close(self) -> None: ...


def stream_batches(df: DataFrame, size: int | None, span: datetime.timedelta | None, keys: Sequence[str] = ()) -> DataFrame:
    """Batches of exactly ``size`` items by key, or what has come ``span`` of processing time after a batch's first item."""
    if size is None and span is None:
        raise ValueError("a batch needs a size or a duration")
    use_rocksdb(df)
    df = df if keys else df.withColumn("_all", F.lit(0))
    names = list(keys) or ["_all"]
    item = T.StructType([T.StructField(n, df.schema[n].dataType) for n in ("payload", "timestamp", "schema", "src_partition", "src_offset")])
    out = T.StructType([*(df.schema[k] for k in names), T.StructField("payload", T.ArrayType(df.schema["payload"].dataType)), *item.fields[1:]])
    processor = _Batches(size, None if span is None else round(span.total_seconds() * 1000), item, out.names)
    result = df.groupBy(*names).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="ProcessingTime")
    return result if keys else result.drop("_all")


class _Accumulators(StatefulProcessor):
    """One pickled accumulator per key; emitted after ``size`` messages, or when the watermark passes the window's end."""

    def __init__(self, make: bytes, size: int | None, end: int | None, names: list[str]) -> None:
        self.make, self.size, self.end, self.names = make, size, end, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("accumulator", T.StructType([T.StructField("data", T.BinaryType()), T.StructField("n", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = pickle.loads(self.make)
        found = self.state.get() if self.state.exists() else None
        acc, n = (pickle.loads(bytes(found[0])), found[1]) if found else (new(), 0)
        if not found and self.end is not None:
            self.handle.registerTimer(round(key[self.end].timestamp() * 1000))
        for row in rows:
            acc, n = acc.add(_plain(row["payload"])), n + 1
            if self.size is not None and n >= self.size:
                yield Row(*self.names)(*key, acc.get_value())
                acc, n = new(), 0
        if n:
            self.state.update((cloudpickle.dumps(acc), n))
        else:
            self.state.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.state.exists():
            acc = pickle.loads(bytes(self.state.get()[0]))
            self.state.clear()
            yield Row(*self.names)(*key, acc.get_value())

    def close(self) -> None: ...


def stream_reduce(
    df: DataFrame,
    window: TumblingWindow | SlidingWindow | SessionWindow,
    aggregate: Mapping[str, Column] | Callable[[], Accumulator],
    *,
    returns: T.DataType | str = "string",
    group_by: GroupBy | Mapping[str, Column] | None = None,
    origin: datetime.datetime | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """Like ``reduce_messages`` on a stream: a window closes when the watermark (``delay`` behind) passes its end."""
    window.check()
    df, keys = keyed(df, group_by)
    if isinstance(window, SessionWindow):
        return sessions(df.withWatermark("timestamp", delay), window, aggregate, keys)
    counted = isinstance(window, TumblingWindow) and window.window_size is not None
    if counted:
        if not callable(aggregate):
            raise ValueError("count windows on a stream need an Accumulator")
        names = keys or ["_all"]
        df = df if keys else df.withColumn("_all", F.lit(0))
    elif callable(aggregate):
        df, extra = windowed(df.withWatermark("timestamp", delay), window, origin=origin)
        names = [*keys, *extra]
    else:
        size, slide = (window.window_timedelta, window.window_timedelta) if isinstance(window, TumblingWindow) else (window.window_size, window.window_slide)
        w = F.window("timestamp", interval(size), interval(slide), interval(offset_of(origin, slide)))
        out = df.withWatermark("timestamp", delay).groupBy(*keys, w.alias("_w")).agg(*(c.alias(f"_a_{n}") for n, c in aggregate.items()))
        if origin is not None:
            out = out.where(F.col("_w.start") >= F.lit(utc(origin)))
        return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), F.struct(*(F.col(f"_a_{n}").alias(n) for n in aggregate)).alias("payload"))
    use_rocksdb(df)
    returns = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
    schema = T.StructType([*(df.schema[n] for n in names), T.StructField("payload", returns)])
    processor = _Accumulators(cloudpickle.dumps(aggregate), window.window_size if counted else None, None if counted else names.index("window_end"), schema.names)
    out = df.groupBy(*names).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None" if counted else "EventTime")
    return out.drop("_all") if names == ["_all"] else out
