import datetime

import pytest

from rillflow.errors import ConfigEnvError, InvalidPipelineError
from rillflow.plans import config
from rillflow.plans.graph import branch, streaming_source
from rillflow.plans.steps import Batch, DevNullSink, Filter, HeadersFilter, Map, ObjectSink, ParquetSerializer, StreamSink, StreamSource
from rillflow.sources.inputs import dead_letters, kafka_options


def test_visits_breadth_first_through_broadcast_and_router():
    inner = branch("c").route("router", "f", {1: branch("d").sink(StreamSink("s1", "x")), 2: branch("e").sink(StreamSink("s2", "y"))})
    p = streaming_source("source", "in").apply(Map("map", "m.C.f")).broadcast("cast", [branch("a").sink(StreamSink("s0", "z")), inner])
    assert [s.name for _, s in p.walk()] == ["source", "map", "cast", "a", "c", "s0", "router", "d", "e", "s1", "s2"]
    p.validate()


def test_names_closing_and_leaves():
    p = streaming_source("source", "in")
    with pytest.raises(InvalidPipelineError):
        p.apply(Map("source", "m.C.f"))
    with pytest.raises(InvalidPipelineError, match="map"):
        streaming_source("source", "in").apply(Map("map", "m.C.f")).validate()
    p = streaming_source("source", "in").sink(StreamSink("sink", "out"))
    with pytest.raises(InvalidPipelineError):
        p.apply(Map("late", "m.C.f"))
    with pytest.raises(InvalidPipelineError):
        streaming_source("a", "in").broadcast("cast", [streaming_source("b", "in").sink(StreamSink("s", "x"))])
    with pytest.raises(TypeError):
        Filter("abstract")


def test_overrides():
    s = StreamSource("s", "events")
    s.override({"topic": "other", "consumer_group": "g"})
    assert (s.stream_name, s.logical, s.group("p")) == ("other", "events", "g")
    assert StreamSource("s", "events").group("p") == "pipeline-p"
    b = Batch("b", batch_size=3)
    b.override({"batch_timedelta": {"minutes": 2}})
    assert (b.batch_size, b.batch_timedelta) == (3, datetime.timedelta(minutes=2))
    b = Batch("b", batch_timedelta=None)
    with pytest.raises(ValueError):
        b.validate()
    o = ObjectSink("o", "bucket", lambda: "x")
    o.override({"bucket": "b2", "parallelism": {"threads": 4}})
    assert (o.bucket, o.thread_count) == ("b2", 4)
    with pytest.raises(ValueError):
        DevNullSink("d", average_sleep_time_ms=1)
    with pytest.raises(ValueError):
        HeadersFilter("h", "", 1)
    for name in ("lzo", "brotli", "nonsense"):
        with pytest.raises(ValueError):
            ParquetSerializer("p", {}, name)


def test_configuration(tmp_path, monkeypatch):
    f = tmp_path / "c.yaml"
    f.write_text("env: {a: 1}\nmetrics: {type: log, period_sec: 1, tags: {}}\npipeline:\n  segments:\n  - steps_config:\n      s: {topic: '${envvar:TOPIC}'}\n")
    with pytest.raises(ConfigEnvError):
        config.load(f)
    monkeypatch.setenv("TOPIC", "t")
    loaded = config.load(f)
    assert config.segment(loaded, 0)["steps_config"] == {"s": {"topic": "t"}} and config.segment(loaded)["env"] == {"a": 1}
    for bad in ("pipeline: {}", "metrics: {type: other}", "metrics: {type: datadog, host: h}", "pipeline: {segments: [{steps_config: {s: {dlq: {topic: ''}}}}]}", "[]"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            config.load(f)


def test_dead_letter_settings():
    servers = {"bootstrap_servers": ["a:1", "b:2"], "override_params": {"linger.ms": "5"}}
    d = dead_letters("dead", servers)
    assert d.topic == "dead" and d.options["kafka.bootstrap.servers"] == "a:1,b:2" and d.options["kafka.linger.ms"] == "5"
    assert dead_letters("dead", servers | {"topic": "t"}).topic == "t"
    assert dead_letters(None, None) is None
    with pytest.raises(KeyError):
        dead_letters("dead", None)
    with pytest.raises(ValueError):
        dead_letters("dead", {"topic": "t"})
    with pytest.raises(ValueError):
        kafka_options({"bootstrap_servers": "a:1", "auto_offset_reset": "middle"}, "t", "g")
    assert kafka_options({"bootstrap_servers": "a:1"}, "t", "g")["startingOffsets"] == "latest"
