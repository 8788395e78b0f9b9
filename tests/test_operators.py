import datetime
import io
import json
import re

import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillflow.errors import InvalidMessageError
from rillflow.functions import types as ty
from rillflow.functions.codecs import SchemaRegistry, dumps
from rillflow.functions.message import to_messages
from rillflow.operators import grouped, routing, rowwise
from rillflow.functions.metrics import Metrics
from rillflow.operators.grouped import SessionWindow, SlidingWindow, TumblingWindow
from rillflow.plans.graph import streaming_source
from rillflow.plans.steps import Batch, FlatMap, Map, ObjectSink, PredicateFilter, Reducer, StreamSink
from rillflow.plans.translate import Translator
from rillflow.sources.sinks import FolderStore, KafkaOutputs, KVAggregationBackend, Outputs, UriStore
from rillflow.sources.inputs import Inputs, sink_value
from rillflow.streaming.run import run_once

T0 = datetime.datetime(2024, 1, 1)


def messages(spark, rows, kind="string"):
    """(payload, seconds) rows as messages with offsets."""
    df = spark.createDataFrame([(i, p, T0 + datetime.timedelta(seconds=s)) for i, (p, s) in enumerate(rows)], f"o bigint, p {kind}, t timestamp")
    return to_messages(df, F.col("p"), schema="s", timestamp=F.col("t"), offset=F.col("o"))


def header_verdict(headers, name, value):
    seen = [v for k, v in headers if k == name and v]
    for v in seen:
        if not re.fullmatch(rb"[+-]?[0-9]+", v) or not -(2**63) <= int(v) < 2**63:
            return "bad"
    return "kept" if any(int(v) == value for v in seen) else "dropped"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["pid", "x"]), st.one_of(st.sampled_from([b"", b"42", b"41", b"-1", b"+42", b" 42", b"not-int", b"\xff", b"99999999999999999999"]), st.binary(max_size=3))), max_size=3), min_size=1, max_size=12))
def test_header_filter(spark, cases):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "o bigint, h array<struct<key:string,value:binary>>")
    m = to_messages(df, F.lit("p"), offset=F.col("o"), headers=F.col("h"))
    good, bad = rowwise.filter_header(m, "pid", 42)
    verdict = {r.src_offset: "kept" for r in good.collect()} | {r.src_offset: "bad" for r in bad.collect()}
    assert [verdict.get(i, "dropped") for i in range(len(cases))] == [header_verdict(h, "pid", 42) for h in cases]


def golden(spark, seconds, ids):
    out = grouped.reduce_messages(messages(spark, [(str(i), s) for i, s in zip(ids, seconds, strict=True)]), SlidingWindow(datetime.timedelta(seconds=6), datetime.timedelta(seconds=2)), {"ids": F.sort_array(F.collect_list(F.col("payload").cast("int")))}, origin=T0)
    return [r.payload.ids for r in out.orderBy("window_start").collect()]


def test_sliding_window_golden(spark):
    assert golden(spark, [0, 2, 4, 6, 8, 10, 24, 26], [0, 1, 2, 3, 4, 5, 12, 13]) == [[0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, 5], [4, 5], [5], [12], [12, 13], [12, 13], [13]]


def test_window_checks():
    s = lambda x: datetime.timedelta(seconds=x)
    for size, slide in ((4, 5), (5, 0), (5.5, 1.5), (6, 0), (7, 2)):
        with pytest.raises(ValueError):
            SlidingWindow(s(size), s(slide)).check()
    with pytest.raises(TypeError):
        SlidingWindow(10, 5).check()
    with pytest.raises(ValueError):
        TumblingWindow().check()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2_500_000), min_size=1, max_size=30, unique=True), st.integers(1, 7))
def test_numbering_and_batches(spark, offsets, size):
    df = spark.createDataFrame([(o, f"p{o}") for o in offsets], "o bigint, p string").repartition(3)
    out = grouped.batch(to_messages(df, F.col("p"), offset=F.col("o")), size).orderBy("src_offset").collect()
    want = [f"p{o}" for o in sorted(offsets)]
    assert [r.payload for r in out] == [want[i : i + size] for i in range(0, len(want), size)]


def test_batches_by_time_and_order_column(spark):
    m = messages(spark, [("a", 0), ("b", 3), ("c", 9), ("d", 10), ("e", 31)])
    out = grouped.batch(m, None, span=datetime.timedelta(seconds=10)).orderBy("src_offset").collect()
    assert [r.payload for r in out] == [["a", "b", "c"], ["d"], ["e"]]
    with pytest.raises(ValueError):
        grouped.batch(m, None)
    with pytest.raises(ValueError):
        grouped.numbered(m, "missing")


def test_callables_errors_and_references(spark):
    m = messages(spark, [("1", 0), ("x", 1)])

    def number(msg):
        if not msg.payload.isdigit():
            raise InvalidMessageError(msg.payload)
        return int(msg.payload) + int(msg.timestamp > 0) + (msg.schema == "s")

    good, bad = rowwise.map_messages(m, number, "int", catch=True)
    assert [r.payload for r in good.collect()] == [3] and [r.error for r in bad.collect()] == ["InvalidMessageError: x"]
    with pytest.raises(Exception, match="InvalidMessageError"):
        rowwise.map_messages(m, number, "int")[0].collect()
    with pytest.raises(Exception, match="ZeroDivisionError"):
        rowwise.map_messages(m, lambda msg: 1 // 0, "int", catch=True)[0].collect()


def test_flat_map_unbatch_and_headers(spark):
    m = messages(spark, [("a b", 0), ("", 1)])
    assert sorted(r.payload for r in rowwise.flat_map(m, lambda x: x.payload.split())[0].collect()) == ["a", "b"]
    arrays = m.withColumn("payload", F.split("payload", " "))
    assert [r.payload for r in rowwise.unbatch(arrays).collect()] == ["a", "b", ""]
    with_header = to_messages(spark.range(1), F.lit("p"), headers=F.expr("array(struct('k' as key, X'01' as value))"))
    assert len(rowwise.map_messages(with_header, F.col("payload"))[0].first().headers) == 1
    assert rowwise.map_messages(with_header, F.col("payload"), drop_headers=True)[0].first().headers == []


def test_parser_required_fields_and_batches(spark):
    registry = SchemaRegistry({"s": "a int not null, b string"})
    rows = ['{"a": 1}', '{"a": null}', '{"b": "x"}', '{"a": "text"}', "nonsense", '{"a": 2, "extra": 3}']
    m = messages(spark, [(r, i) for i, r in enumerate(rows)]).withColumn("payload", F.col("payload").cast("binary"))
    good, bad = rowwise.parse(m, "s", registry)
    assert sorted(r.payload.a for r in good.collect()) == [1, 2] and bad.count() == 4
    good, bad = rowwise.parse_batch(grouped.batch(m, 2), "s", registry)
    assert (good.count(), bad.count()) == (0, 3)
    for name in (None, "unknown"):
        with pytest.raises(ValueError):
            registry.get(name)


def test_serializers(spark):
    when = datetime.datetime(2025, 6, 5, 14, 30)
    assert dumps({"t": when, "x": None, "é": 1}) == json.dumps({"t": when.isoformat(), "x": None, "é": 1}).encode()
    assert dumps({"t": when}, "%Y/%m/%d %H:%M") == b'{"t": "2025/06/05 14:30"}'
    with pytest.raises(TypeError):
        dumps({"t": object()})
    m = messages(spark, [("a", 0)]).withColumn("payload", F.expr("struct(timestamp'2025-06-05 14:30:00' as t, cast(null as int) as x)"))
    assert bytes(rowwise.serialize(m, "yyyy/MM/dd HH:mm").first().payload) == b'{"t":"2025/06/05 14:30","x":null}'
    arrays = messages(spark, [("a", 0)]).withColumn("payload", F.expr("array(named_struct('n', 1), null, named_struct('n', 2))"))
    data = rowwise.serialize_parquet(arrays, ty.struct_of({"n": ty.Int32()}), "gzip").first().payload
    assert pq.read_table(io.BytesIO(bytes(data))).to_pydict() == {"n": [1, 2]}


def test_unknown_route_fails_and_sink_types(spark):
    m = messages(spark, [("a", 0), ("z", 1)])
    parts = routing.route(m, F.col("payload"), ["a"])
    with pytest.raises(Exception, match="no route for key z"):
        parts["a"].collect()
    assert routing.route(m, lambda x: x.payload, ["a", "z"])["z"].count() == 1
    with pytest.raises(TypeError):
        sink_value(m.withColumn("payload", F.lit(1)))


def test_types():
    assert ty.struct_of([ty.Field("a", ty.List(ty.Uint64())), ty.Field("b", ty.Datetime("UTC")), ty.Field("c", ty.Datetime()), ty.Field("d", ty.Duration()), ty.Field("e", ty.Decimal(10, 2))]).simpleString() == "struct<a:array<decimal(20,0)>,b:timestamp,c:timestamp_ntz,d:interval day to second,e:decimal(10,2)>"
    with pytest.raises(ValueError):
        _ = ty.Datetime(unit="ns").spark


def test_run_once_writes_sinks_objects_and_backends(spark, tmp_path):
    store, backend = FolderStore(str(tmp_path)), KVAggregationBackend()
    m = messages(spark, [("a", 0), ("b", 1), ("a", 2)])
    p = streaming_source("source", "s").apply(FlatMap("twice", F.array("payload", "payload"))).sink(StreamSink("sink", "out"))
    run_once(spark, p, Translator(Inputs({"s": m})), Outputs(f"file://{tmp_path}/tables"))
    assert spark.read.parquet(f"file://{tmp_path}/tables/out").count() == 6

    def name():
        import uuid

        return f"{uuid.uuid4()}.bin"

    p = streaming_source("source", "s").apply(Map("same", F.col("payload"))).sink(ObjectSink("sink", "bucket", name))
    run_once(spark, p, Translator(Inputs({"s": m})), Outputs("unused", store))
    assert sorted(f.read_bytes() for f in (tmp_path / "bucket").iterdir()) == [b"a", b"a", b"b"]
    reduce = Reducer("r", TumblingWindow(window_timedelta=datetime.timedelta(days=1)), {"n": F.count(F.lit(1))}, backend)
    p = streaming_source("source", "s").apply(reduce).apply(Map("text", F.to_json("payload"))).sink(StreamSink("sink", "sums"))
    run_once(spark, p, Translator(Inputs({"s": m})), Outputs(f"file://{tmp_path}/tables"))
    assert backend.map == {"n": 3}


def partitioned(spark, rows):
    """(partition, offset, payload, seconds) rows as messages."""
    df = spark.createDataFrame([(p, o, x, T0 + datetime.timedelta(seconds=s)) for p, o, x, s in rows], "part int, o bigint, p string, t timestamp").repartition(3)
    return to_messages(df, F.col("p"), schema="s", timestamp=F.col("t"), offset=F.col("o"), partition=F.col("part"))


def test_offsets_repeat_across_partitions(spark):
    m = partitioned(spark, [(p, o, f"{p}-{o}", o) for o in range(7) for p in (0, 1)])
    want = [f"{p}-{o}" for p in (0, 1) for o in range(7)]
    for _ in range(2):
        out = grouped.batch(m, 4).collect()
        assert [r.payload for r in sorted(out, key=lambda r: (r.src_partition, r.src_offset))] == [want[i : i + 4] for i in range(0, 14, 4)]
    counted = grouped.reduce_messages(m, TumblingWindow(5), {"ids": F.sort_array(F.collect_list("payload"))}).orderBy("window_number").collect()
    assert [r.payload.ids for r in counted] == [want[i : i + 5] for i in range(0, 14, 5)]


def test_batches_by_size_or_time_and_null_keys(spark):
    m = messages(spark, [("a", 0), ("b", 1), ("c", 2), ("d", 11), ("e", 12), ("f", 40)])
    step = Batch("b", batch_size=2, batch_timedelta=datetime.timedelta(seconds=10))
    p = streaming_source("source", "s").apply(step).apply(Map("text", F.array_join("payload", ""))).sink(StreamSink("sink", "out"))
    plan = Translator(Inputs({"s": m})).translate(spark, p)
    assert sorted(r.payload for r in plan.sinks["sink"][1].collect()) == ["ab", "c", "de", "f"]
    assert Batch("b", batch_size=2).span() is None and Batch("b").span() == datetime.timedelta(seconds=10)
    keyed = m.withColumn("k", F.when(F.col("payload") < "d", "x"))
    out = grouped.batch(keyed, 2, span=datetime.timedelta(seconds=10), keys=["k"]).collect()
    assert sorted("".join(r.payload) for r in out) == ["ab", "c", "de", "f"]


class ByLetter(grouped.GroupBy):
    def get_group_by_key(self, payload):
        return payload[0]


def test_group_by_objects(spark):
    m = messages(spark, [("a1", 0), ("b1", 1), ("a2", 2)])
    out = grouped.reduce_messages(m, TumblingWindow(window_timedelta=datetime.timedelta(hours=1)), {"n": F.count(F.lit(1))}, group_by=ByLetter()).collect()
    assert sorted((r.group_key, r.payload.n) for r in out) == [("a", 2), ("b", 1)]
    p = streaming_source("source", "s").apply(Batch("b", batch_size=5, group_by=ByLetter())).apply(Map("text", F.array_join("payload", ""))).sink(StreamSink("sink", "out"))
    plan = Translator(Inputs({"s": m})).translate(spark, p)
    assert sorted(r.payload for r in plan.sinks["sink"][1].collect()) == ["a1a2", "b1"]


def test_sessions(spark):
    m = messages(spark, [("a", 0), ("b", 5), ("c", 30), ("d", 31)])
    gap = SessionWindow(datetime.timedelta(seconds=10))
    out = grouped.reduce_messages(m, gap, {"n": F.count(F.lit(1))}).orderBy("window_start").collect()
    assert [(r.payload.n, (r.window_end - r.window_start).total_seconds()) for r in out] == [(2, 15), (2, 11)]
    with pytest.raises(ValueError):
        SessionWindow(datetime.timedelta(0)).check()
    with pytest.raises(ValueError):
        grouped.reduce_messages(m, gap, KVAggregationBackend)


def test_windows_with_a_naive_origin_follow_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql("SELECT 0L AS o, timestamp_micros(1704067200000000) AS t UNION ALL SELECT 1L, timestamp_micros(1704067199000000)")
        m = to_messages(df, F.lit("p"), timestamp=F.col("t"), offset=F.col("o"))
        out = grouped.reduce_messages(m, TumblingWindow(window_timedelta=datetime.timedelta(hours=1)), {"n": F.count(F.lit(1))}, origin=T0)
        assert [(r.s, r.payload.n) for r in out.select(F.unix_seconds("window_start").alias("s"), "payload").collect()] == [(1704067200, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_objects_with_names_by_origin_and_uris(spark, tmp_path):
    m = messages(spark, [("a", 0), ("b", 1)])
    sink = ObjectSink("sink", "bucket", lambda origin: f"{origin[0]}/{origin[1]}.bin")
    p = streaming_source("source", "s").apply(Map("same", F.col("payload"))).sink(sink)
    for _ in range(2):
        run_once(spark, p, Translator(Inputs({"s": m})), Outputs("unused", UriStore(f"file://{tmp_path}/objects")))
    assert {str(f.relative_to(tmp_path / "objects")): f.read_bytes() for f in (tmp_path / "objects").rglob("*.bin")} == {"bucket/0/0.bin": b"a", "bucket/0/1.bin": b"b"}


def test_kafka_outputs_get_their_own_settings(spark):
    """Sinks and dead letters through a writer that keeps what it gets."""
    sent = {}
    config = {"steps_config": {"source": {"dlq": {"bootstrap_servers": ["dead:1"], "topic": "letters", "override_params": {"linger.ms": "9"}}}, "sink": {"bootstrap_servers": ["a:1", "b:2"], "override_params": {"acks": "all"}}}}
    outputs = KafkaOutputs(config["steps_config"], writer=lambda df, options: sent.update({options["topic"]: (options, df.collect())}))

    def number(m):
        if not m.payload.isdigit():
            raise InvalidMessageError("not a number")
        return m.payload

    p = streaming_source("source", "s", dlq_stream_name="dead").apply(Map("number", number)).sink(StreamSink("sink", "out"))
    run_once(spark, p, Translator(Inputs({"s": messages(spark, [("1", 0), ("x", 1)])}), config=config), outputs)
    options, rows = sent["out"]
    assert options == {"kafka.bootstrap.servers": "a:1,b:2", "topic": "out", "kafka.acks": "all", "includeHeaders": "true"} and [bytes(r.value) for r in rows] == [b"1"]
    options, rows = sent["letters"]
    assert options["kafka.bootstrap.servers"] == "dead:1" and options["kafka.linger.ms"] == "9"
    assert [bytes(r.value) for r in rows] == [b"x"] and {h.key: bytes(h.value) for h in rows[0].headers}["src_offset"] == b"1"
    with pytest.raises(ValueError, match="bootstrap_servers"):
        KafkaOutputs({}).write(StreamSink("sink", "out"), messages(spark, [("1", 0)]))


class Kept(Metrics):
    def __init__(self):
        super().__init__(period=1e9)

    def send(self, kind, name, value, tags): ...


def test_callables_run_once_for_both_sides_and_steps_count(spark, tmp_path):
    calls, metrics = spark.sparkContext.accumulator(0), Kept()

    def check(m):
        calls.add(1)
        if m.payload == "x":
            raise InvalidMessageError("x")
        return m.payload

    config = {"steps_config": {"source": {"dlq": {"bootstrap_servers": ["a:1"]}}}}
    p = streaming_source("source", "s", dlq_stream_name="dead").apply(Map("check", check)).apply(PredicateFilter("some", F.col("payload") != "b")).sink(StreamSink("sink", "out"))
    run_once(spark, p, Translator(Inputs({"s": messages(spark, [("a", 0), ("x", 1), ("b", 2)])}), config=config), Outputs(f"file://{tmp_path}/o"), metrics=metrics)
    assert calls.value == 3
    assert spark.read.parquet(f"file://{tmp_path}/o/out").count() == 1 and spark.read.parquet(f"file://{tmp_path}/o/dead").count() == 1
    assert {(n, dict(t)["step"]): v for (n, t), v in metrics.counters.items()} == {("pipeline.step.input.messages", "check"): 3, ("pipeline.step.input.messages", "some"): 2, ("pipeline.step.errors", "check"): 1}
    assert metrics.largest


def test_processes_become_partitions(spark):
    config = {"steps_config": {"same": {"parallelism": {"multi_process": {"processes": 5, "batch_size": 10, "batch_time": 0.2}}}}}
    p = streaming_source("source", "s").apply(Map("same", F.col("payload"))).sink(StreamSink("sink", "out"))
    plan = Translator(Inputs({"s": messages(spark, [(str(i), i) for i in range(50)])}), config=config).translate(spark, p)
    assert plan.sinks["sink"][1].rdd.getNumPartitions() == 5


def test_overridden_steps(spark):
    p = streaming_source("source", "s").apply(Map("upper", F.upper("payload"))).apply(Batch("b", batch_size=2)).sink(StreamSink("sink", "out"))
    own = {Batch: lambda step, df: df.select(F.concat("payload", F.lit(f"-{step.batch_size}")).alias("payload"))}
    plan = Translator(Inputs({"s": messages(spark, [("a", 0), ("b", 1)])}), overrides=own).translate(spark, p)
    rows = plan.sinks["sink"][1].collect()
    assert sorted(r.payload for r in rows) == ["A-2", "B-2"] and rows[0].headers == []


def test_parquet_files_are_built_from_single_items(spark):
    """Items reach Python as rows, so that no Arrow batch holds many whole messages; a file's items may span Arrow batches."""
    df = spark.range(1, 60, numPartitions=2).select(F.when(F.col("id") % 7 != 0, F.transform(F.sequence(F.lit(1), F.expr("id % 40 + 1")), lambda i: F.struct((i * 100 + F.col("id")).alias("n"), i.cast("string").alias("s"), F.timestamp_seconds(i).alias("t")))).otherwise(F.array()).alias("payload"), "id")
    m = to_messages(df, F.col("payload"), offset=F.col("id"), timestamp=F.timestamp_seconds("id"), headers=F.array(F.struct(F.lit("h").alias("key"), F.lit(b"v").alias("value"))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        out = rowwise.serialize_parquet(m, ty.struct_of({"t": ty.Datetime("UTC"), "n": ty.Int64(), "none": ty.String()}), "zstd")
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and "ArrowEvalPython" not in plan
    assert out.columns == m.columns and sorted(r.src_offset for r in rows) == list(range(1, 60))
    for r in rows:
        k = r.src_offset
        n = k % 40 + 1 if k % 7 else 0
        at = [datetime.datetime.fromtimestamp(i, datetime.timezone.utc) for i in range(1, n + 1)]
        assert pq.read_table(io.BytesIO(bytes(r.payload))).to_pydict() == {"t": at, "n": [i * 100 + k for i in range(1, n + 1)], "none": [None] * n}
        assert [(h.key, bytes(h.value)) for h in r.headers] == [("h", b"v")]
    with pytest.raises(Exception, match="not null"):
        rowwise.serialize_parquet(m.withColumn("payload", F.when(F.col("src_offset") > 1, F.col("payload"))), ty.struct_of({"n": ty.Int64()})).collect()
    with pytest.raises(Exception, match="(?i)int"):  # types aren't guessed
        rowwise.serialize_parquet(m, ty.struct_of({"s": ty.Int64()})).collect()


def test_callables_work_on_arrow_columns(spark):
    """Python functions get whole Arrow columns, and in them the values that Spark's own rows have."""
    nested = "named_struct('t', timestamp'2025-06-05 14:30:00', 'l', array(named_struct('t', timestamp'2024-01-01 00:00:00', 'd', date'2024-01-01'), null), 'm', map('a', 1.5d), 'b', cast('x' as binary), 'n', cast(null as int), 'z', cast(1.25 as decimal(5, 2)))"
    m = messages(spark, [("a", 0), (None, 1)]).withColumn("payload", F.when(F.col("payload").isNotNull(), F.expr(nested)))
    good, _ = rowwise.map_messages(m, lambda x: repr(x.payload))
    want = [None if r.payload is None else r.payload.asDict(recursive=True) for r in m.orderBy("src_offset").collect()]
    if want[0]:
        want[0]["b"] = bytes(want[0]["b"])
    assert [r.payload for r in good.orderBy("src_offset").collect()] == [repr(w) for w in want]
    assert "SQL_SCALAR_ARROW" in (plan := good._jdf.queryExecution().executedPlan().toString()) or ", 250" in plan
    # results convert as those of Spark's Python functions do
    assert [r.payload for r in rowwise.map_messages(m, lambda x: 7)[0].collect()] == ["7", "7"]
    when = datetime.datetime(2025, 1, 2, 3, 4)
    assert [r.payload for r in rowwise.map_messages(m, lambda x: {"t": when, "m": {"k": 1}}, "struct<t:timestamp,m:map<string,int>>")[0].collect()] == [((when, {"k": 1}))] * 2


class Alone(grouped.Accumulator):
    """Refuses to be merged."""

    def __init__(self):
        self.seen = []

    def add(self, value):
        self.seen.append(value)
        return self

    def get_value(self):
        return self.seen

    def merge(self, other):
        raise AssertionError("a task has made two partials of one group")


def test_accumulators_have_one_partial_a_task(spark):
    """However many groups a task has; null keys and values stay null."""
    df = spark.range(0, 36_000, numPartitions=1).select(F.expr("nullif(id % 12000, 5)").alias("k"), F.expr("nullif(id, 7)").alias("payload"), F.lit(0).alias("src_partition"), F.col("id").alias("src_offset"))
    got = {r.k: r.payload for r in grouped.accumulate(df, ["k"], Alone, "array<bigint>").collect()}
    assert got == {None if k == 5 else k: [None if x == 7 else x for x in (k, k + 12000, k + 24000)] for k in range(12000)}
    some = spark.createDataFrame([(float("nan"), (1, "a"), 1), (0.0, None, 2), (-0.0, None, 3), (None, (1, "a"), 4), (float("nan"), (1, "a"), 5)], "x double, s struct<i:int,t:string>, payload long").repartition(3)
    sums = grouped.accumulate(some, ["x", "s"], Total, "long").collect()
    assert sorted((repr(r.x), r.s, r.payload) for r in sums) == sorted([("nan", (1, "a"), 6), ("0.0", None, 5), ("None", (1, "a"), 4)])
    assert grouped.accumulate(some, [], Total, "long").collect()[0].payload == 15


class Total(grouped.Accumulator):
    def __init__(self):
        self.n = 0

    def add(self, value):
        self.n += value
        return self

    def get_value(self):
        return self.n

    def merge(self, other):
        self.n += other.n
        return self
