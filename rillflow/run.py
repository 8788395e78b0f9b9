"""Command line: ``python -m rillflow.run NAME --config FILE [--segment-id N] application.py``.

The application defines ``pipeline`` and may define ``inputs``, ``outputs`` and
``registry``; without ``inputs`` the source is Kafka as the configuration says, and
without ``outputs`` sinks with ``bootstrap_servers`` in their settings write to Kafka.
"""

from __future__ import annotations

import argparse
import runpy

from pyspark.sql import SparkSession

from .functions.metrics import ProgressListener, backend
from .plans import config as configuration
from .plans.graph import Pipeline
from .plans.steps import StreamSink
from .plans.translate import Translator
from .sources.sinks import KafkaOutputs, Outputs
from .sources.inputs import Inputs, kafka_input
from .streaming.run import run_once, run_stream


def load_application(path: str) -> dict:
    """The globals of an application file, which must define ``pipeline``."""
    found = runpy.run_path(path)
    if not isinstance(found.get("pipeline"), Pipeline):
        raise ValueError(f"{path} defines no pipeline")
    return found


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("name")
    p.add_argument("application")
    p.add_argument("--config", required=True)
    p.add_argument("--segment-id", type=int)
    p.add_argument("--checkpoint", help="a folder that driver and executors share (default: pipelines below spark.checkpoint.dir)")
    p.add_argument("--output", help="the folder of Parquet sinks (default: output below the checkpoint)")
    p.add_argument("--once", action="store_true", help="bounded inputs: run to the end and stop")
    p.add_argument("--health-file", default="/tmp/health.txt")
    a = p.parse_args(argv)
    settings = configuration.load(a.config)
    segment = configuration.segment(settings, a.segment_id)
    app = load_application(a.application)
    pipeline: Pipeline = app["pipeline"]
    pipeline.validate()
    spark = SparkSession.builder.appName(a.name).getOrCreate()
    source = pipeline.root
    step = segment["steps_config"].get(source.name, {})
    source.override(step)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if a.checkpoint is None and shared is None:
        p.error("--checkpoint is needed where spark.checkpoint.dir isn't set")
    checkpoint = a.checkpoint or f"{shared.rstrip('/')}/pipelines/{a.name}"
    inputs = app.get("inputs") or Inputs({source.stream_name: kafka_input(step, source.stream_name, source.group(a.name))})
    translator = Translator(inputs, app.get("registry"), segment)
    sinks = {n: segment["steps_config"].get(n) or {} for n, s in pipeline.steps.items() if isinstance(s, StreamSink)}
    to_kafka = any(s.get("bootstrap_servers") for s in sinks.values())
    outputs = app.get("outputs") or (KafkaOutputs(sinks) if to_kafka else Outputs(a.output or f"{checkpoint}/output"))
    metrics = backend(settings.get("metrics"))
    if a.once:
        run_once(spark, pipeline, translator, outputs, metrics=metrics)
        metrics.flush()
        return
    health = a.health_file if segment["adapter_config"].get("write_healthcheck", False) else None
    spark.streams.addListener(ProgressListener(metrics, health))
    trigger = segment["adapter_config"].get("trigger")
    for query in run_stream(spark, pipeline, translator, outputs, checkpoint, trigger=trigger, metrics=metrics):
        query.awaitTermination()


if __name__ == "__main__":
    main()
