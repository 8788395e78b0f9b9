"""Metrics of steps and queries: counts through ``observe``, progress through a listener, pluggable backends."""

from __future__ import annotations

import logging
import time
from abc import ABC, abstractmethod
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

FLUSH_SECONDS = 10.0
log = logging.getLogger(__name__)


class Metrics(ABC):
    """Buffers counters (summed) and timings (largest kept) and sends them every FLUSH_SECONDS."""

    def __init__(self, tags: Mapping[str, str] | None = None, period: float = FLUSH_SECONDS) -> None:
        self.tags, self.period = dict(tags or {}), period
        self.counters: dict[tuple[str, tuple], float] = {}
        self.largest: dict[tuple[str, tuple], float] = {}
        self.flushed = time.monotonic()

    def _key(self, name: str, tags: Mapping[str, str] | None) -> tuple[str, tuple]:
        return name, tuple(sorted((self.tags | dict(tags or {})).items()))

    def increment(self, name: str, value: float = 1, tags: Mapping[str, str] | None = None) -> None:
        key = self._key(name, tags)
        self.counters[key] = self.counters.get(key, 0) + value
        self._maybe_flush()

    def timing(self, name: str, seconds: float, tags: Mapping[str, str] | None = None) -> None:
        key = self._key(name, tags)
        self.largest[key] = max(self.largest.get(key, 0.0), seconds)
        self._maybe_flush()

    def _maybe_flush(self) -> None:
        if time.monotonic() - self.flushed >= self.period:
            self.flush()

    def flush(self) -> None:
        for kind, values in (("c", self.counters), ("g", self.largest)):
            for (name, tags), value in values.items():
                self.send(kind, name, value, dict(tags))
            values.clear()
        self.flushed = time.monotonic()

    @abstractmethod
    def send(self, kind: str, name: str, value: float, tags: Mapping[str, str]) -> None: ...


class DummyMetrics(Metrics):
    def send(self, kind: str, name: str, value: float, tags: Mapping[str, str]) -> None: ...


class LogMetrics(Metrics):
    def send(self, kind: str, name: str, value: float, tags: Mapping[str, str]) -> None:
        log.info("metric %s %s=%s %s", kind, name, value, tags)


class StatsdMetrics(Metrics):
    """DogStatsD datagrams over UDP."""

    def __init__(self, host: str, port: int, tags: Mapping[str, str] | None = None, period: float = FLUSH_SECONDS) -> None:
        import socket

        super().__init__(tags, period)
        self.socket, self.address = socket.socket(socket.AF_INET, socket.SOCK_DGRAM), (host, port)

    def send(self, kind: str, name: str, value: float, tags: Mapping[str, str]) -> None:
        text = f"{name}:{value}|{kind}" + ("|#" + ",".join(f"{k}:{v}" for k, v in tags.items()) if tags else "")
        self.socket.sendto(text.encode(), self.address)


def backend(config: Mapping[str, Any] | None) -> Metrics:
    """The backend of a configuration's metrics section (default: none)."""
    config = config or {"type": "dummy"}
    if config["type"] == "datadog":
        return StatsdMetrics(config["host"], config["port"], config.get("tags"), config.get("flush_interval_ms", FLUSH_SECONDS * 1000) / 1000)
    if config["type"] == "log":
        return LogMetrics(config.get("tags"), config["period_sec"])
    return DummyMetrics()


def counted(df: DataFrame, step: str, metric: str = "input.messages") -> tuple[DataFrame, Observation | None]:
    """``df`` with its rows counted as they pass; on a stream the count arrives with the query's progress."""
    name = f"{metric}:{step}"
    if df.isStreaming:
        return df.observe(name, F.count(F.lit(1)).alias("n")), None
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def _observed(seen: Observation, wait: float = 5.0) -> dict[str, Any] | None:
    """An observation's values, which follow its first action by a moment; None if there was none, where ``get`` would wait for ever."""
    until = time.monotonic() + wait
    while not seen._jo.future().isCompleted():
        if time.monotonic() > until:
            return None
        time.sleep(0.05)
    return seen.get


def report(metrics: Metrics, counts: Iterable[tuple[str, str, Observation]], seconds: float | None = None) -> None:
    """What the steps of a written plan have read and refused, and how long it took.

    A step that no sink has run has counted nothing and is left out.
    """
    for metric, step, seen in counts:
        if (found := _observed(seen)) is not None:
            metrics.increment(f"pipeline.step.{metric}", found["n"], {"step": step})
    if seconds is not None:
        metrics.timing("pipeline.duration", seconds)


class ProgressListener(StreamingQueryListener):
    """Reports each micro-batch, and touches a health file."""

    def __init__(self, metrics: Metrics, health_file: str | None = None) -> None:
        self.metrics, self.health_file = metrics, health_file

    def onQueryStarted(self, event: Any) -> None: ...

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        self.metrics.increment("pipeline.input.messages", progress.numInputRows)
        self.metrics.timing("pipeline.duration", (progress.batchDuration or 0) / 1000)
        for name, row in (progress.observedMetrics or {}).items():
            metric, _, step = name.partition(":")
            self.metrics.increment(f"pipeline.step.{metric}", row["n"], {"step": step})
        if self.health_file:
            Path(self.health_file).touch()

    def onQueryIdle(self, event: Any) -> None:
        if self.health_file:
            Path(self.health_file).touch()

    def onQueryTerminated(self, event: Any) -> None:
        if event.exception:
            self.metrics.increment("pipeline.errors")
        self.metrics.flush()
