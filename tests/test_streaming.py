import datetime

from pyspark.sql import functions as F

from rillflow.functions.message import to_messages
from rillflow.operators.grouped import Accumulator, TumblingWindow
from rillflow.plans.graph import branch, streaming_source
from rillflow.plans.steps import Batch, Map, Reducer, StreamSink
from rillflow.plans.translate import Translator
from rillflow.sources.sinks import Outputs
from rillflow.sources.inputs import Inputs
from rillflow.streaming.run import run_stream

SECOND = datetime.timedelta(seconds=1)


class Joined(Accumulator):
    def __init__(self):
        self.items = []

    def add(self, value):
        self.items.append(value)
        return self

    def get_value(self):
        return ",".join(sorted(self.items))

    def merge(self, other):
        self.items += other.items
        return self


def stream(spark, folder, rows):
    t0 = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, p, t0 + s * SECOND) for i, (p, s) in enumerate(rows)], "o bigint, p string, t timestamp")
    df.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return to_messages(source, F.col("p"), schema="s", timestamp=F.col("t"), offset=F.col("o"))


def run(spark, pipeline, messages, tmp_path):
    seen = {}
    outputs = Outputs(lambda name, df: seen.setdefault(name, []).extend(bytes(r.value).decode() for r in df.collect()))
    for q in run_stream(spark, pipeline, Translator(Inputs({"s": messages})), outputs, str(tmp_path / "checkpoint"), trigger={"availableNow": True}):
        q.awaitTermination(120)
        assert q.exception() is None
    return seen


def test_stateless_branches_share_one_query(spark, tmp_path):
    ends = [branch(n).apply(Map(f"map-{n}", F.concat("payload", F.lit(n)))).sink(StreamSink(f"sink-{n}", n)) for n in "xy"]
    m = stream(spark, str(tmp_path / "in"), [("a", 0), ("b", 1)])
    seen = run(spark, streaming_source("source", "s").broadcast("both", ends), m, tmp_path)
    assert {k: sorted(v) for k, v in seen.items()} == {"x": ["ax", "bx"], "y": ["ay", "by"]}


def test_batches_by_size(spark, tmp_path):
    m = stream(spark, str(tmp_path / "in"), [(c, i) for i, c in enumerate("abcdefg")])
    p = streaming_source("source", "s").apply(Batch("threes", batch_size=3, batch_timedelta=None)).apply(Map("join", F.array_join("payload", ""))).sink(StreamSink("sink", "out"))
    assert sorted(run(spark, p, m, tmp_path)["out"]) == ["abc", "def"]


def test_event_time_windows(spark, tmp_path):
    m = stream(spark, str(tmp_path / "in"), [("a", 0), ("b", 5), ("c", 12)])
    stream(spark, str(tmp_path / "in"), [("d", 60)])
    p = streaming_source("source", "s").apply(Reducer("r", TumblingWindow(window_timedelta=10 * SECOND), {"n": F.count(F.lit(1))})).apply(Map("text", F.col("payload.n").cast("string"))).sink(StreamSink("sink", "out"))
    assert sorted(run(spark, p, m, tmp_path)["out"]) == ["1", "2"]


def test_accumulators_by_count(spark, tmp_path):
    m = stream(spark, str(tmp_path / "in"), [(c, i) for i, c in enumerate("abcde")])
    p = streaming_source("source", "s").apply(Reducer("r", TumblingWindow(2), Joined)).sink(StreamSink("sink", "out"))
    assert sorted(run(spark, p, m, tmp_path)["out"]) == ["a,b", "c,d"]


def test_accumulators_by_event_time(spark, tmp_path):
    m = stream(spark, str(tmp_path / "in"), [("a", 0), ("b", 5), ("c", 12)])
    stream(spark, str(tmp_path / "in"), [("d", 60)])
    p = streaming_source("source", "s").apply(Reducer("r", TumblingWindow(window_timedelta=10 * SECOND), Joined)).sink(StreamSink("sink", "out"))
    assert sorted(run(spark, p, m, tmp_path)["out"]) == ["a,b", "c"]


def late(spark, folder, tmp_path, delay):
    m = stream(spark, folder, [("a", 0), ("b", 12)])
    stream(spark, folder, [("e", 13)])
    stream(spark, folder, [("c", 5)])
    stream(spark, folder, [("d", 120)])
    p = streaming_source("source", "s").apply(Reducer("r", TumblingWindow(window_timedelta=10 * SECOND), {"n": F.count(F.lit(1))})).apply(Map("text", F.concat(F.second("window_start").cast("string"), F.lit(":"), F.col("payload.n").cast("string")))).sink(StreamSink("sink", "out"))
    seen = []
    outputs = Outputs(lambda name, df: seen.extend(bytes(r.value).decode() for r in df.collect()))
    config = {"steps_config": {"r": {"watermark_delay": delay}}}
    for q in run_stream(spark, p, Translator(Inputs({"s": m}), config=config), outputs, str(tmp_path / f"checkpoint-{delay}"), trigger={"availableNow": True}):
        q.awaitTermination(120)
    return sorted(seen)


def test_late_messages_wait_for_the_configured_delay(spark, tmp_path):
    assert late(spark, str(tmp_path / "a"), tmp_path, "30 seconds") == ["0:2", "10:2"]
    assert late(spark, str(tmp_path / "b"), tmp_path, "0 seconds") == ["0:1", "10:2"]


def test_a_restart_goes_on_and_a_repeated_batch_writes_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    p = streaming_source("source", "s").apply(Map("same", F.col("payload"))).sink(StreamSink("sink", "copies"))
    for rows in ([("a", 0), ("b", 1)], [("c", 2)]):
        m = stream(spark, folder, rows)
        for q in run_stream(spark, p, Translator(Inputs({"s": m})), Outputs(out), str(tmp_path / "checkpoint"), trigger={"availableNow": True}):
            q.awaitTermination(120)
            assert q.exception() is None
    read = lambda: sorted(bytes(r.value).decode() for r in spark.read.parquet(f"{out}/copies").collect())
    assert read() == ["a", "b", "c"]
    again = spark.read.parquet(folder).where("o < 2 and p <> 'c'")
    Outputs(out).write(StreamSink("sink", "copies"), to_messages(again, F.col("p")), 0)
    assert read() == ["a", "b", "c"]


def test_batches_follow_partitions_and_keys(spark, tmp_path):
    df = spark.createDataFrame([(o % 2, o // 2, f"{'ab'[o % 2]}{o // 2}") for o in range(8)], "part int, o bigint, p string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    m = to_messages(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), F.col("p"), offset=F.col("o"), partition=F.col("part"))
    p = streaming_source("source", "s").apply(Batch("fours", batch_size=4, batch_timedelta=None)).apply(Map("join", F.array_join("payload", ""))).sink(StreamSink("sink", "out"))
    assert sorted(run(spark, p, m, tmp_path)["out"]) == ["a0a1a2a3", "b0b1b2b3"]


def test_naive_origins_on_a_stream_follow_utc(spark, tmp_path):
    m = stream(spark, str(tmp_path / "in"), [("a", 0), ("b", 5)])
    stream(spark, str(tmp_path / "in"), [("c", 60)])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        origin = datetime.datetime(2024, 1, 1)
        m = m.withColumn("timestamp", F.expr("timestamp_micros(1704067200000000 + 1000000 * CASE payload WHEN 'a' THEN 0 WHEN 'b' THEN 5 ELSE 60 END)"))
        p = streaming_source("source", "s").apply(Reducer("r", TumblingWindow(window_timedelta=10 * SECOND), {"n": F.count(F.lit(1))}, origin=origin)).apply(Map("text", F.concat(F.unix_seconds("window_start").cast("string"), F.lit(":"), F.col("payload.n").cast("string")))).sink(StreamSink("sink", "out"))
        assert run(spark, p, m, tmp_path)["out"] == ["1704067200:2"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
