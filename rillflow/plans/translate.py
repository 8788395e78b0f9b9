"""From a pipeline to DataFrames: one lazy plan per sink, and one of invalid messages."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import SchemaRegistry
from ..functions.message import HEADERS
from ..functions.metrics import counted
from ..operators import grouped, routing, rowwise
from ..streaming import state
from ..sources.inputs import DeadLetters, Inputs, dead_letters
from . import steps as S
from .graph import Pipeline


@dataclass
class Plan:
    """``sinks``: (step, table) by sink name; ``dead``: invalid messages, if they are kept; ``order``: steps as visited.

    ``kept``: tables held while the plan's sinks are written; ``counts``: what each step
    has read and refused, by metric and step, once a sink has run.
    """

    sinks: dict[str, tuple[S.Sink, DataFrame]] = field(default_factory=dict)
    dead: DataFrame | None = None
    dead_target: DeadLetters | None = None
    order: list[str] = field(default_factory=list)
    backends: list[tuple[Any, DataFrame]] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)
    counts: list[tuple[str, str, Observation]] = field(default_factory=list)


class Translator:
    """Lowers steps, applies overrides and visits edges once.

    ``on_error``: "fail" stops the query at an invalid message, "drop" leaves it out,
    "dlq" collects it.  The default is dlq where the source has dead letters, else fail.
    ``keep``: on tables, what callables return is held on the executors' disks until all
    sinks are written, so that valid and invalid messages come from the same calls.
    ``count``: steps count what they read and refuse.  ``overrides``: by kind of step, a
    function of (step, DataFrame) that takes the place of the built-in translation.
    """

    def __init__(self, inputs: Inputs, registry: SchemaRegistry | None = None, config: Mapping[str, Any] | None = None, *, on_error: str | None = None, compat_headers: bool = False, keep: bool = False, count: bool = False, overrides: Mapping[type[S.Step], Callable[[Any, DataFrame], DataFrame]] | None = None) -> None:
        self.inputs, self.registry = inputs, registry or SchemaRegistry()
        self.keep, self.count, self.overrides = keep, count, dict(overrides or {})
        self.config = (config or {}).get("steps_config", {})
        self.on_error, self.compat_headers = on_error, compat_headers

    def translate(self, spark: SparkSession, pipeline: Pipeline) -> Plan:
        pipeline.validate()
        plan, tables, bad = Plan(), {}, []
        for parent, step in pipeline.walk():
            step = step.lower()
            step.override(self.config.get(step.name) or {})
            step.validate()
            plan.order.append(step.name)
            if isinstance(step, S.StreamSource):
                plan.dead_target = dead_letters(step.dlq_stream_name, (self.config.get(step.name) or {}).get("dlq"))
                self.policy = self.on_error or ("dlq" if plan.dead_target else "fail")
                self.stream = step.logical
                df = self.inputs.open(spark, step.stream_name).withColumn("schema", F.coalesce("schema", F.lit(step.logical)))
                if step.header_filter:
                    df = rowwise.filter_header_bytes(df, *step.header_filter)
                if self.policy == "dlq":
                    df = df.withColumn("raw", _bytes(df, "payload"))
                tables[step.name] = df
                continue
            df = tables[step.name] if isinstance(step, S.Branch) else tables[parent]
            if isinstance(step, S.Sink):
                plan.sinks[step.name] = (step, df)
            elif isinstance(step, S.Router):
                for key, part in routing.route(df, step.routing_function, list(step.table)).items():
                    name = step.table[key]
                    tables[name] = tables[name].unionByName(part) if name in tables else part
            elif isinstance(step, S.Broadcast):
                tables |= routing.broadcast(df, step.branches)
            elif not isinstance(step, S.Branch):
                parallelism = ((self.config.get(step.name) or {}).get("parallelism") or {}).get("multi_process")
                if parallelism:  # so many tasks at a time for this step and those after it
                    df = df.repartition(int(parallelism["processes"]))
                if self.count:
                    df = self._counted(plan, df, step.name, "input.messages")
                self.plan = plan
                tables[step.name], invalid = self.transform(step, df)
                if invalid is not None and self.policy == "dlq":
                    if self.count and plan.dead_target:
                        invalid = self._counted(plan, invalid, step.name, "errors")
                    bad.append(invalid.select("raw", "src_partition", "src_offset", F.lit(step.name).alias("step"), "error"))
                if isinstance(step, S.Aggregate) and step.backend is not None:
                    plan.backends.append((step.backend, tables[step.name]))
        if bad:
            plan.dead = reduce(DataFrame.unionByName, bad)
        return plan

    def transform(self, step: S.Step, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """One simple step on messages: (good, invalid)."""
        catch = self.policy != "fail"
        own = next((f for kind, f in self.overrides.items() if isinstance(step, kind)), None)
        if own is not None:
            return self._messages(own(step, df)), None
        if isinstance(step, S.Operator):
            return self._messages(step.function(df)), None
        if isinstance(step, S.Map):
            return rowwise.map_messages(df, step.function, step.returns, catch=catch, drop_headers=self.compat_headers, keep=self._kept)
        if isinstance(step, S.PredicateFilter):
            return rowwise.filter_messages(df, step.function, catch=catch, keep=self._kept)
        if isinstance(step, S.HeadersFilter):
            return rowwise.filter_header(df, step.header_name, step.value, catch=catch)
        if isinstance(step, S.FlatMap):
            return rowwise.flat_map(df, step.function, step.returns, catch=catch, keep=self._kept)
        if isinstance(step, S.Unbatch):
            return rowwise.unbatch(df), None
        if isinstance(step, (S.Parser, S.BatchParser)):
            parse = rowwise.parse if isinstance(step, S.Parser) else rowwise.parse_batch
            good, bad = parse(df, self.stream, self.registry)
            if catch:
                return good, bad
            return self._or_fail(parse, df), None
        if isinstance(step, S.Serializer):
            return rowwise.serialize(df, step.dt_format, style=step.json_style), None
        if isinstance(step, S.ParquetSerializer):
            return rowwise.serialize_parquet(df, step.schema, step.compression), None
        if isinstance(step, S.Batch):
            df, keys = grouped.keyed(df, step.group_by)
            if df.isStreaming:
                return self._messages(state.stream_batches(df, step.batch_size, step.batch_timedelta, keys)), None
            return self._messages(grouped.batch(df, step.batch_size, span=step.span(), keys=keys)), None
        if isinstance(step, S.Aggregate):
            options = {"returns": step.returns, "group_by": step.group_by, "origin": step.origin}
            out = state.stream_reduce(df, step.window, step.aggregate, **options, delay=step.delay) if df.isStreaming else grouped.reduce_messages(df, step.window, step.aggregate, **options)
            return self._messages(out), None
        raise TypeError(f"step {step.name}: unknown kind {type(step).__name__}")

    def _kept(self, df: DataFrame) -> DataFrame:
        if not self.keep or df.isStreaming:
            return df
        self.plan.kept.append(df.persist(StorageLevel.DISK_ONLY))
        return self.plan.kept[-1]

    @staticmethod
    def _counted(plan: Plan, df: DataFrame, step: str, metric: str) -> DataFrame:
        out, seen = counted(df, step, metric)
        if seen is not None:
            plan.counts.append((metric, step, seen))
        return out

    def _or_fail(self, parse: Any, df: DataFrame) -> DataFrame:
        """Good rows; a bad one fails the query when it runs."""
        good, bad = parse(df, self.stream, self.registry)
        failed = bad.where(F.raise_error(F.concat(F.lit("invalid message: "), F.col("error"))).cast("boolean")).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema))
        return good.unionByName(failed)

    @staticmethod
    def _messages(df: DataFrame) -> DataFrame:
        """Fills the envelope columns that grouping leaves out."""
        missing = {"headers": F.array().cast(HEADERS), "timestamp": F.current_timestamp(), "schema": F.lit(None).cast("string"), "src_partition": F.lit(0), "src_offset": F.lit(None).cast("bigint"), "raw": F.lit(None).cast("binary")}
        return df.withColumns({k: v for k, v in missing.items() if k not in df.columns})


def _bytes(df: DataFrame, name: str):
    """A column as bytes for the dead letters: its own, or its JSON."""
    kind = df.schema[name].dataType.typeName()
    return F.col(name).cast("binary") if kind in ("binary", "string") else F.to_json(F.struct(name)).cast("binary")
