"""Running plans: once on tables, or as streaming queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.metrics import Metrics, report
from ..plans.graph import Pipeline
from ..plans.steps import Aggregate, Batch, Operator, StreamSource
from ..plans.translate import Plan, Translator
from ..sources.sinks import Outputs, flush
from ..sources.inputs import Inputs


def write(plan: Plan, outputs: Outputs, batch: int | None = None) -> None:
    """Writes every sink, the dead letters and the aggregation backends of a plan over tables."""
    try:
        for step, df in plan.sinks.values():
            outputs.write(step, df, batch)
        if plan.dead is not None and plan.dead_target is not None:
            outputs.dead(plan.dead_target, plan.dead, batch)
        for backend, df in plan.backends:
            flush(df, backend)
    finally:
        for df in plan.kept:
            df.unpersist()


def run_once(spark: SparkSession, pipeline: Pipeline, translator: Translator, outputs: Outputs, *, metrics: Metrics | None = None) -> Plan:
    """The pipeline over bounded inputs; callables run once where valid and invalid messages are both written."""
    began = time.monotonic()
    translator.keep, translator.count = True, metrics is not None
    plan = translator.translate(spark, pipeline)
    write(plan, outputs)
    if metrics is not None:
        report(metrics, plan.counts, time.monotonic() - began)
    return plan


def run_stream(spark: SparkSession, pipeline: Pipeline, translator: Translator, outputs: Outputs, checkpoint: str, *, trigger: dict[str, Any] | None = None, metrics: Metrics | None = None) -> list[StreamingQuery]:
    """The pipeline over unbounded inputs.

    Without stateful steps one query reads the source once and writes all sinks of each
    micro-batch, kept while there are several.  With stateful steps each sink is a query
    of its own, as state lives in the query; their steps' counts come with the progress.
    """
    source = pipeline.root
    assert isinstance(source, StreamSource)
    stateful = any(isinstance(s.lower(), (Aggregate, Batch)) or isinstance(s, Operator) and s.stateful for s in pipeline.steps.values())
    if stateful:
        translator.count = metrics is not None
        plan = translator.translate(spark, pipeline)
        tables = [(n, lambda df, i, step=step: outputs.write(step, df, i), df) for n, (step, df) in plan.sinks.items()]
        tables += [(f"backend-{k}", lambda df, i, b=b: flush(df, b), df) for k, (b, df) in enumerate(plan.backends)]
        if plan.dead is not None and plan.dead_target is not None:
            tables.append(("dead-letters", lambda df, i, t=plan.dead_target: outputs.dead(t, df, i), plan.dead))
        return [_start(df, put, f"{checkpoint}/{name}", trigger) for name, put, df in tables]

    def each(batch: DataFrame, i: int) -> None:
        kept = batch.persist() if len(pipeline.steps) > 3 else batch
        try:
            bound = Translator(Inputs({source.stream_name: kept}), translator.registry, {"steps_config": translator.config}, on_error=translator.on_error, compat_headers=translator.compat_headers, keep=True, count=metrics is not None, overrides=translator.overrides)
            plan = bound.translate(batch.sparkSession, pipeline)
            write(plan, outputs, i)
            if metrics is not None:
                report(metrics, plan.counts)
        finally:
            if kept is not batch or batch.is_cached:
                kept.unpersist()

    source.override(translator.config.get(source.name) or {})
    return [_start(translator.inputs.open(spark, source.stream_name), each, f"{checkpoint}/all", trigger)]


def _start(df: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict[str, Any] | None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()
