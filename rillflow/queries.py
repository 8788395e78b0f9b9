"""A query for each operator, over the driver's tables, with its DuckDB twin where SQL can express it.

``events`` stands for a stream: event_id is the offset, ts the time, props JSON bytes.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidMessageError
from .functions import types as ty
from .functions.codecs import SchemaRegistry
from .functions.message import from_kafka, to_messages
from .operators import grouped, rowwise
from .operators.grouped import Accumulator, KVAccumulator, SlidingWindow, TumblingWindow
from .plans.graph import Pipeline, branch, streaming_source
from .plans.steps import Batch, BatchParser, DevNullSink, FlatMap, HeadersFilter, Map, Operator, ParquetSerializer, Parser, PredicateFilter, Reducer, Serializer, StreamSink, Unbatch
from .plans.translate import Translator
from .sources.inputs import Inputs
from .sources.sinks import KafkaOutputs
from .streaming.run import write

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = datetime.timedelta(hours=1)
REGISTRY = SchemaRegistry({"events": "k bigint", "strict": "k bigint not null, name string not null"})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, payload: Column | None = None, headers: Column | None = None) -> DataFrame:
    """``events`` as messages of stream events; the session's zone is taken for UTC."""
    row = F.struct("event_id", "user_id", "event_type", "value", "props")
    return to_messages(table(spark, sf_dir, "events"), row if payload is None else payload, schema="events", timestamp=F.col("ts"), offset=F.col("event_id"), headers=headers)


def outputs(spark: SparkSession, pipeline: Pipeline, messages: DataFrame, **options) -> dict[str, DataFrame]:
    """Each sink's table of a pipeline over one stream."""
    plan = Translator(Inputs({"events": messages}), REGISTRY, options.pop("config", None), **options).translate(spark, pipeline)
    return {name: df for name, (_, df) in plan.sinks.items()} | ({"dead": plan.dead} if plan.dead is not None else {})


def text(column: str = "payload") -> Column:
    return F.col(column).cast("string")


@query("""SELECT event_id AS id, '{"event_id":' || event_id || ',"event_type":"error","transformed":true}' AS body FROM events WHERE event_type = 'error'""")
def simple_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, map and serialise by expressions into a stream sink."""
    p = (
        streaming_source("source", "events")
        .apply(PredicateFilter("errors", F.col("payload.event_type") == "error"))
        .apply(Map("transform", F.struct("payload.event_id", "payload.event_type", F.lit(True).alias("transformed"))))
        .apply(Serializer("json"))
        .sink(StreamSink("sink", "out"))
    )
    return outputs(spark, p, events(spark, sf_dir))["sink"].select(F.col("src_offset").alias("id"), text().alias("body"))


@query("SELECT event_id AS id, CAST(value * 2 AS DOUBLE) AS doubled FROM events WHERE user_id % 3 = 0")
def map_filter_callables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operators with Python callables on Message."""
    p = streaming_source("source", "events").apply(PredicateFilter("third", lambda m: m.payload["user_id"] % 3 == 0)).apply(Map("double", lambda m: m.payload["value"] * 2, "double")).sink(StreamSink("sink", "out"))
    return outputs(spark, p, events(spark, sf_dir))["sink"].select(F.col("src_offset").alias("id"), F.col("payload").alias("doubled"))


@query("SELECT event_id AS id, event_type || '!' AS body FROM events")
def map_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive maps become one projection."""
    p = streaming_source("source", "events").apply(Map("type", F.col("payload.event_type"))).apply(Map("mark", F.concat("payload", F.lit("!")))).sink(StreamSink("sink", "out"))
    return outputs(spark, p, events(spark, sf_dir))["sink"].select(F.col("src_offset").alias("id"), F.col("payload").alias("body"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def flat_map_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat map by an array expression, then a word count."""
    docs = to_messages(table(spark, sf_dir, "documents"), F.col("text"), offset=F.col("doc_id"))
    p = streaming_source("source", "events").apply(FlatMap("words", F.split(F.lower("payload"), " "))).apply(PredicateFilter("some", F.col("payload") != "")).sink(StreamSink("sink", "out"))
    return outputs(spark, p, docs)["sink"].groupBy(F.col("payload").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, user_id AS copy FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, -user_id FROM events WHERE event_type = 'view'")
def flat_map_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat map by a generator."""

    def both(m):
        if m.payload["event_type"] == "view":
            yield m.payload["user_id"]
            yield -m.payload["user_id"]

    p = streaming_source("source", "events").apply(FlatMap("both", both, "bigint")).sink(StreamSink("sink", "out"))
    return outputs(spark, p, events(spark, sf_dir))["sink"].select(F.col("src_offset").alias("id"), F.col("payload").alias("copy"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bytes to the stream's typed payload."""
    p = streaming_source("source", "events").apply(Parser("parse")).sink(StreamSink("sink", "out"))
    return outputs(spark, p, events(spark, sf_dir, F.col("props").cast("binary")))["sink"].select(F.col("src_offset").alias("id"), F.col("payload.k").alias("k"))


@query("SELECT CASE WHEN event_id % 5 = 0 THEN 'malformed' WHEN event_id % 5 = 1 THEN 'missing' ELSE 'good' END AS kind, count(*) AS n FROM events GROUP BY 1")
def parser_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed JSON and missing required fields go to the dead letters with their raw bytes."""
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("{not json")).when(F.col("event_id") % 5 == 1, F.col("props")).otherwise(F.lit('{"k": 1, "name": "n"}'))
    p = streaming_source("source", "events", dlq_stream_name="dead").apply(Parser("parse")).sink(StreamSink("sink", "out"))
    p.root.logical = "strict"
    out = outputs(spark, p, events(spark, sf_dir, raw.cast("binary")), config={"steps_config": {"source": {"dlq": {"bootstrap_servers": ["localhost:9092"]}}}})
    kinds = out["sink"].select(F.lit("good").alias("kind")).unionByName(out["dead"].select(F.substring_index("error", ":", 1).alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id % 7 = 0 AS dead, count(*) AS n FROM events GROUP BY 1")
def callable_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callable's InvalidMessageError sends its message to the dead letters."""

    def check(m):
        if m.payload["event_id"] % 7 == 0:
            raise InvalidMessageError("divisible by seven")
        return m.payload["event_id"]

    p = streaming_source("source", "events", dlq_stream_name="dead").apply(Map("check", check, "bigint")).sink(StreamSink("sink", "out"))
    out = outputs(spark, p, events(spark, sf_dir), config={"steps_config": {"source": {"dlq": {"bootstrap_servers": ["localhost:9092"]}}}})
    both = out["sink"].select(F.lit(False).alias("dead")).unionByName(out["dead"].select(F.lit(True).alias("dead")))
    return both.groupBy("dead").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id // 10 AS batch, list(CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY event_id)[1] AS first_k, count(*) AS n FROM events GROUP BY 1")
def batch_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten raw messages, parsed as a whole."""
    p = streaming_source("source", "events").apply(Batch("tens", batch_size=10)).apply(BatchParser("parse")).sink(StreamSink("sink", "out"))
    out = outputs(spark, p, events(spark, sf_dir, F.col("props").cast("binary")))["sink"]
    return out.select(F.expr("src_offset div 10").alias("batch"), F.col("payload")[0]["k"].alias("first_k"), F.size("payload").cast("bigint").alias("n"))


@query("""SELECT event_id AS id, '{"user": ' || user_id || ', "note": null}' AS body FROM events""")
def serializer_python_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with Python's own spacing and nulls."""
    p = streaming_source("source", "events").apply(Map("pick", F.struct(F.col("payload.user_id").alias("user"), F.lit(None).cast("string").alias("note")))).apply(Serializer("json", json_style="python")).sink(StreamSink("sink", "out"))
    return outputs(spark, p, events(spark, sf_dir))["sink"].select(F.col("src_offset").alias("id"), text().alias("body"))


@query("SELECT 'kept' AS kind, count(*) FILTER (user_id % 4 = 1) AS n FROM events UNION ALL SELECT 'dead', count(*) FILTER (user_id % 4 = 2) FROM events")
def header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways: the value matches, differs or is missing, or isn't a number (dead letters)."""
    value = F.when(F.col("user_id") % 4 == 1, "42").when(F.col("user_id") % 4 == 2, "not-int").when(F.col("user_id") % 4 == 3, "41").otherwise("")
    headers = F.array(F.struct(F.lit("pid").alias("key"), value.cast("binary").alias("value")))
    p = streaming_source("source", "events", dlq_stream_name="dead").apply(HeadersFilter("pid", "pid", 42)).sink(StreamSink("sink", "out"))
    out = outputs(spark, p, events(spark, sf_dir, headers=headers), config={"steps_config": {"source": {"dlq": {"bootstrap_servers": ["localhost:9092"]}}}})
    return out["sink"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("kind"), "n").unionByName(out["dead"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead").alias("kind"), "n"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'click'")
def source_header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source keeps messages with one exact header."""
    headers = F.array(F.struct(F.lit("type").alias("key"), F.col("event_type").cast("binary").alias("value")))
    p = streaming_source("source", "events", header_filter=("type", b"click")).sink(StreamSink("sink", "out"))
    return outputs(spark, p, events(spark, sf_dir, headers=headers))["sink"].select(F.col("src_offset").alias("id"))


@query("SELECT CASE event_type WHEN 'error' THEN 'errors' WHEN 'click' THEN 'clicks' ELSE 'rest' END AS branch, count(*) AS n FROM events GROUP BY 1")
def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message to exactly one branch."""
    key = F.when(F.col("payload.event_type").isin("error", "click"), F.col("payload.event_type")).otherwise("rest")
    ends = {k: branch(n).sink(StreamSink(f"{n}-sink", n)) for k, n in (("error", "errors"), ("click", "clicks"), ("rest", "rest"))}
    out = outputs(spark, streaming_source("source", "events").route("by-type", key, ends), events(spark, sf_dir))
    parts = [out[f"{n}-sink"].select(F.lit(n).alias("branch")) for n in ("errors", "clicks", "rest")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, 'Hello, ' || event_type || '!' AS body FROM events UNION ALL SELECT event_id, 'Goodbye, ' || event_type || '.' FROM events")
def broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message to both branches."""
    hello = branch("hello").apply(Map("greet", F.concat(F.lit("Hello, "), "payload.event_type", F.lit("!")))).sink(StreamSink("a", "a"))
    goodbye = branch("goodbye").apply(Map("leave", F.concat(F.lit("Goodbye, "), "payload.event_type", F.lit(".")))).sink(StreamSink("b", "b"))
    out = outputs(spark, streaming_source("source", "events").broadcast("both", [hello, goodbye]), events(spark, sf_dir))
    return out["a"].unionByName(out["b"]).select(F.col("src_offset").alias("id"), F.col("payload").alias("body"))


@query("SELECT event_id // 100 AS batch, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def batch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a hundred in offset order."""
    p = streaming_source("source", "events").apply(Batch("hundreds", batch_size=100)).sink(StreamSink("sink", "out"))
    out = outputs(spark, p, events(spark, sf_dir))["sink"]
    total = F.aggregate("payload", F.lit(0).cast("bigint"), lambda a, x: a + x["user_id"])
    return out.select(F.expr("src_offset div 100").alias("batch"), F.size("payload").cast("bigint").alias("n"), total.alias("users"))


@query("SELECT user_id, batch, count(*) AS n, min(event_id) AS first FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS batch FROM events) GROUP BY user_id, batch")
def batch_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of five for each user."""
    df = events(spark, sf_dir).withColumn("user_id", F.col("payload.user_id"))
    n = grouped.numbered(df, "src_offset", ["user_id"]).withColumn("batch", F.expr("_n div 5"))
    return n.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("src_offset").alias("first"))


@query("SELECT event_id AS id, user_id AS item FROM events")
def unbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches taken apart again."""
    p = streaming_source("source", "events").apply(Batch("tens", batch_size=10)).apply(Unbatch("items")).sink(StreamSink("sink", "out"))
    return outputs(spark, p, events(spark, sf_dir))["sink"].select(F.col("payload.event_id").alias("id"), F.col("payload.user_id").alias("item"))


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of event time."""
    out = grouped.reduce_messages(events(spark, sf_dir), TumblingWindow(window_timedelta=HOUR), {"n": F.count(F.lit(1)), "users": F.sum("payload.user_id")})
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "payload.n", "payload.users")


@query("""SELECT event_type, s AS window_start, count(*) AS n
FROM (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS s FROM events)
WHERE s >= TIMESTAMP '2024-01-01' GROUP BY 1, 2""")
def sliding_window_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hours every two hours from an origin, for each type; no window starts before the origin."""
    out = grouped.reduce_messages(events(spark, sf_dir), SlidingWindow(6 * HOUR, 2 * HOUR), {"n": F.count(F.lit(1))}, group_by={"event_type": F.col("payload.event_type")}, origin=datetime.datetime(2024, 1, 1))
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "payload.n")


@query("SELECT event_id // 250 AS window_number, max(user_id) AS top FROM events GROUP BY 1")
def count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 250 messages."""
    out = grouped.reduce_messages(events(spark, sf_dir), TumblingWindow(250), {"top": F.max("payload.user_id")})
    return out.select("window_number", "payload.top")


class CountByKey(KVAccumulator):
    """Outcome counter: a mapping from key to count."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def add(self, value):
        key = (value["event_type"] or "") + str(value["user_id"] % 3)
        self.counts[key] = self.counts.get(key, 0) + 1
        return self

    def get_value(self):
        return self.counts

    def merge(self, other):
        for k, v in other.counts.items():
            self.counts[k] = self.counts.get(k, 0) + v
        return self


class Largest(Accumulator):
    def __init__(self) -> None:
        self.value = None

    def add(self, value):
        self.value = value["value"] if self.value is None else max(self.value, value["value"])
        return self

    def get_value(self):
        return self.value

    def merge(self, other):
        self.value = other.value if self.value is None else self.value if other.value is None else max(self.value, other.value)
        return self


@query("SELECT date_trunc('day', ts) AS day, event_type || (user_id % 3) AS key, count(*) AS n FROM events GROUP BY 1, 2")
def accumulator_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping accumulator over days, through the pipeline."""
    p = streaming_source("source", "events").apply(Reducer("count", TumblingWindow(window_timedelta=24 * HOUR), CountByKey, returns="map<string,bigint>")).sink(DevNullSink("sink"))
    out = outputs(spark, p, events(spark, sf_dir))["sink"]
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("day"), F.explode("payload").alias("key", "n"))


@query("SELECT user_id, max(value) AS largest FROM events GROUP BY 1")
def accumulator_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value of each user, by an accumulator over one long window."""
    out = grouped.reduce_messages(events(spark, sf_dir), TumblingWindow(window_timedelta=datetime.timedelta(days=36500)), Largest, returns="double", group_by={"user_id": F.col("payload.user_id")})
    return out.select("user_id", F.col("payload").alias("largest"))


@query("SELECT user_id, CAST(sum(user_id + event_id) AS BIGINT) AS total_duration, count(*) AS spans FROM events GROUP BY 1")
def span_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments: the sum of durations and the list of spans, by built-in aggregates."""
    keyed = {"user_id": F.col("payload.user_id")}
    out = grouped.reduce_messages(events(spark, sf_dir), TumblingWindow(window_timedelta=datetime.timedelta(days=36500)), {"total": F.sum(F.col("payload.user_id") + F.col("payload.event_id")), "segment": F.collect_list("payload")}, group_by=keyed)
    return out.select("user_id", F.col("payload.total").alias("total_duration"), F.size("payload.segment").cast("bigint").alias("spans"))


@query("SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' - INTERVAL 600 SECOND THEN 'delayed' ELSE 'recent' END AS branch, count(*) AS n FROM events GROUP BY 1")
def late_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages older than ten minutes go to the delayed branch."""
    now = F.lit(datetime.datetime(2024, 1, 15, tzinfo=datetime.timezone.utc))
    key = F.when(F.col("timestamp") < now - F.expr("interval 600 seconds"), "delayed").otherwise("recent")
    ends = {n: branch(n).sink(StreamSink(f"{n}-sink", n)) for n in ("delayed", "recent")}
    out = outputs(spark, streaming_source("source", "events").route("age", key, ends), events(spark, sf_dir))
    both = [out[f"{n}-sink"].select(F.lit(n).alias("branch")) for n in ("delayed", "recent")]
    return both[0].unionByName(both[1]).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id // 1000 AS batch, count(*) AS n FROM events GROUP BY 1")
def parquet_serializer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a thousand as Parquet files; the row count is read back from each file's footer."""
    fields = {"event_id": ty.Int64(), "event_type": ty.String(), "value": ty.Float64()}
    p = streaming_source("source", "events").apply(Batch("thousands", batch_size=1000)).apply(ParquetSerializer("file", fields, "zstd")).sink(StreamSink("sink", "out"))
    out = outputs(spark, p, events(spark, sf_dir, F.struct("event_id", "event_type", "value")))["sink"]

    @F.udf("bigint")
    def rows(data):
        import io

        import pyarrow.parquet as pq

        return pq.read_metadata(io.BytesIO(bytes(data))).num_rows

    return out.select(F.expr("src_offset div 1000").alias("batch"), rows("payload").alias("n"))


@query("SELECT event_id AS id, CAST(user_id AS SMALLINT) AS small, CAST(user_id AS VARCHAR) AS big, (user_id BETWEEN 0 AND 255) AS fits FROM events")
def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared unsigned types, widened and checked; what the widened type can't hold is null, and doesn't fit."""
    df, user = events(spark, sf_dir), F.col("payload.user_id")
    return df.select(F.col("src_offset").alias("id"), user.try_cast(ty.Uint8().spark).alias("small"), user.cast(ty.Uint64().spark).cast("string").alias("big"), ty.Uint8().valid(user).alias("fits"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'doc', count(*) FROM documents")
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams as one."""
    a = events(spark, sf_dir, F.col("event_type"))
    b = to_messages(table(spark, sf_dir, "documents"), F.lit("doc"), offset=F.col("doc_id"))
    out, _ = rowwise.map_messages(a.unionByName(b), F.col("payload"))
    return out.groupBy(F.col("payload").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id AS id, '{"at":"' || strftime(ts, '%Y/%m/%d %H:%M') || '","note":null}' AS spark_style, '{"at": "' || strftime(ts, '%d.%m.%Y %H:%M:%S') || '", "note": null}' AS python_style FROM events""")
def serializer_dt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in a format of the step's own, in both JSON styles."""
    body = Map("pick", F.struct(F.col("payload.at"), F.lit(None).cast("string").alias("note")))
    ends = [branch("a").apply(Serializer("spark", "yyyy/MM/dd HH:mm")).sink(StreamSink("spark-sink", "a")), branch("b").apply(Serializer("python", "%d.%m.%Y %H:%M:%S", "python")).sink(StreamSink("python-sink", "b"))]
    out = outputs(spark, streaming_source("source", "events").apply(body).broadcast("both", ends), events(spark, sf_dir, F.struct(F.col("ts").cast("timestamp").alias("at"))))
    a, b = (out[f"{n}-sink"].select(F.col("src_offset").alias("id"), text().alias(f"{n}_style")) for n in ("spark", "python"))
    return a.join(b, "id")


@query("SELECT event_id // 1000 AS batch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, min(event_type) AS first_type, max(value) AS top FROM events GROUP BY 1")
def parquet_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as Parquet files, read back whole."""
    fields = {"event_id": ty.Int64(), "event_type": ty.String(), "value": ty.Float64()}
    p = streaming_source("source", "events").apply(Batch("thousands", batch_size=1000)).apply(ParquetSerializer("file", fields, "gzip")).sink(StreamSink("sink", "out"))
    out = outputs(spark, p, events(spark, sf_dir, F.struct("event_id", "event_type", "value")))["sink"]

    def read(frames):
        import io

        import pandas as pd
        import pyarrow.parquet as pq

        for frame in frames:
            for o, data in zip(frame["src_offset"], frame["payload"], strict=True):
                table = pq.read_table(io.BytesIO(bytes(data))).to_pandas()
                yield pd.DataFrame({"batch": o // 1000, "event_id": table["event_id"], "event_type": table["event_type"], "value": table["value"]})

    rows = out.select("src_offset", "payload").mapInPandas(read, "batch bigint, event_id bigint, event_type string, value double")
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.min("event_type").alias("first_type"), F.max("value").alias("top"))


class ByType(grouped.GroupBy):
    def get_group_by_key(self, payload):
        return payload["event_type"]


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def group_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by the key that an object gives."""
    p = streaming_source("source", "events").apply(Reducer("count", TumblingWindow(window_timedelta=24 * HOUR), {"n": F.count(F.lit(1))}, group_by_key=ByType())).sink(DevNullSink("sink"))
    out = outputs(spark, p, events(spark, sf_dir))["sink"]
    return out.select(F.col("group_key").alias("event_type"), F.col("window_start").cast("timestamp_ntz").alias("day"), "payload.n")


@query("""SELECT min(event_id) AS first, count(*) AS n FROM
(SELECT event_id, span, (row_number() OVER (PARTITION BY span ORDER BY event_id) - 1) // 20 AS batch
 FROM (SELECT event_id, epoch_us(ts - (SELECT min(ts) FROM events)) // 3600000000 AS span FROM events)) GROUP BY span, batch""")
def batch_size_or_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of twenty or of an hour, whichever comes first."""
    p = streaming_source("source", "events").apply(Batch("batch", batch_size=20, batch_timedelta=HOUR)).sink(StreamSink("sink", "out"))
    return outputs(spark, p, events(spark, sf_dir))["sink"].select(F.col("src_offset").alias("first"), F.size("payload").cast("bigint").alias("n"))


@query("""SELECT batch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM
(SELECT event_id, (row_number() OVER (ORDER BY event_id % 4, event_id // 4) - 1) // 100 AS batch FROM events) GROUP BY 1""")
def batch_over_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a stream of four partitions, each with offsets of its own that the others repeat."""
    m = events(spark, sf_dir).withColumns({"src_partition": (F.col("src_offset") % 4).cast("int"), "src_offset": F.expr("src_offset div 4")})
    p = streaming_source("source", "events").apply(Batch("hundreds", batch_size=100)).sink(StreamSink("sink", "out"))
    ids = F.aggregate("payload", F.lit(0).cast("bigint"), lambda a, x: a + x["event_id"])
    out = outputs(spark, p, m)["sink"].select("src_partition", "src_offset", F.size("payload").cast("bigint").alias("n"), ids.alias("ids"))
    starts = grouped.numbered(m, keys=()).select(F.col("src_partition").alias("p"), F.col("src_offset").alias("o"), F.expr("_n div 100").alias("batch"))
    return out.join(starts, (F.col("src_partition") == F.col("p")) & (F.col("src_offset") == F.col("o"))).select("batch", "n", "ids")


@query("""SELECT window_number, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM
(SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS window_number FROM events WHERE user_id % 3 = 0) GROUP BY 1""")
def count_window_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of fifty messages after a filter, so that offsets have gaps."""
    p = streaming_source("source", "events").apply(PredicateFilter("third", F.col("payload.user_id") % 3 == 0)).apply(Reducer("sum", TumblingWindow(50), {"n": F.count(F.lit(1)), "ids": F.sum("payload.event_id")})).sink(DevNullSink("sink"))
    return outputs(spark, p, events(spark, sf_dir))["sink"].select("window_number", "payload.n", "payload.ids")


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM
(SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM
 (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, session""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that end after six hours without a message."""
    out = grouped.reduce_messages(events(spark, sf_dir), grouped.SessionWindow(6 * HOUR), {"n": F.count(F.lit(1))}, group_by={"user_id": F.col("payload.user_id")})
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("session_start"), "payload.n")


@query("""SELECT event_type, date_trunc('hour', ts) AS hour, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS top, event_type || ':' || (max(value) > 40) AS alert FROM events GROUP BY 1, 2""")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aggregates of a window side by side, and a map that turns them into an alert."""
    keyed = {"event_type": F.col("payload.event_type")}
    reduce = Reducer("stats", TumblingWindow(window_timedelta=HOUR), {"p95": F.percentile("payload.value", 0.95), "top": F.max("payload.value")}, group_by_key=keyed)
    alert = Map("alert", F.struct("payload.*", F.concat("event_type", F.lit(":"), (F.col("payload.top") > 40).cast("string")).alias("alert")))
    out = outputs(spark, streaming_source("source", "events").apply(reduce).apply(alert).sink(DevNullSink("sink")), events(spark, sf_dir))["sink"]
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("hour"), F.round("payload.p95", 6).alias("p95"), "payload.top", "payload.alert")


@query("SELECT event_id // 40 AS batch, count(*) AS n FROM events GROUP BY 1")
def configured_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings override what the step says."""
    p = streaming_source("source", "events").apply(Batch("batch", batch_size=7)).sink(StreamSink("sink", "out"))
    out = outputs(spark, p, events(spark, sf_dir), config={"steps_config": {"batch": {"batch_size": 40}}})["sink"]
    return out.select(F.expr("src_offset div 40").alias("batch"), F.size("payload").cast("bigint").alias("n"))


class Shout:
    @staticmethod
    def loud(message) -> str:
        return message.payload["event_type"].upper()


@query("SELECT event_id AS id, upper(event_type) AS body FROM events")
def string_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function by its name."""
    p = streaming_source("source", "events").apply(Map("loud", "rillflow.queries.Shout.loud")).sink(StreamSink("sink", "out"))
    return outputs(spark, p, events(spark, sf_dir))["sink"].select(F.col("src_offset").alias("id"), F.col("payload").alias("body"))


@query("""SELECT event_id AS "offset", CAST(user_id % 3 AS INTEGER) AS "partition", ts AS at, 'events' AS schema, CASE WHEN user_id % 5 = 0 THEN 0 ELSE length(event_type) END AS bytes, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS headers FROM events""")
def kafka_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the layout of Spark's Kafka source as messages: null values and header values become empty bytes."""
    header = F.array(F.struct(F.lit("h").alias("key"), F.lit(None).cast("binary").alias("value")))
    rows = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 5 != 0, F.col("event_type").cast("binary")).alias("value"),
        F.when(F.col("user_id") % 2 == 0, header).alias("headers"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id").alias("offset"),
        (F.col("user_id") % 3).cast("int").alias("partition"),
    )
    m = from_kafka(rows, "events")
    whole = F.forall("headers", lambda h: F.octet_length(h["value"]) == 0)
    return m.where(whole).select(F.col("src_offset").alias("offset"), F.col("src_partition").alias("partition"), F.col("timestamp").cast("timestamp_ntz").alias("at"), "schema", F.octet_length("payload").cast("bigint").alias("bytes"), F.size("headers").alias("headers"))


@query("""SELECT CASE WHEN user_id % 4 = 0 THEN 'letters' ELSE 'out' END AS topic, CASE WHEN user_id % 4 = 0 THEN 'dead:1' ELSE 'a:1,b:2' END AS servers, event_id AS id FROM events""")
def kafka_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes to Kafka, and with which options: a sink and the dead letters, each with servers of its own."""

    def check(m):
        if m.payload["user_id"] % 4 == 0:
            raise InvalidMessageError("divisible by four")
        return str(m.payload["event_id"])

    p = streaming_source("source", "events", dlq_stream_name="dead").apply(Map("check", check)).sink(StreamSink("sink", "out"))
    config = {"source": {"dlq": {"bootstrap_servers": ["dead:1"], "topic": "letters"}}, "sink": {"bootstrap_servers": ["a:1", "b:2"]}}
    plan = Translator(Inputs({"events": events(spark, sf_dir)}), REGISTRY, {"steps_config": config}).translate(spark, p)
    sent: list[DataFrame] = []
    origin = F.get(F.filter("headers", lambda h: h["key"] == "src_offset"), F.lit(0))["value"].cast("string")
    write(plan, KafkaOutputs(config, writer=lambda df, o: sent.append(df.select(F.lit(o["topic"]).alias("topic"), F.lit(o["kafka.bootstrap.servers"]).alias("servers"), F.coalesce(origin, F.col("value").cast("string")).cast("bigint").alias("id")))))
    return sent[0].unionByName(sent[1])


@query("SELECT user_id, min(event_id) AS first, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def own_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator of the user's own between built-in steps."""

    def firsts(df: DataFrame) -> DataFrame:
        out = df.groupBy(F.col("payload.user_id")).agg(F.min("src_offset").alias("src_offset"), F.count(F.lit(1)).alias("n"))
        return out.select(F.struct("user_id", "n").alias("payload"), "src_offset")

    p = streaming_source("source", "events").apply(Operator("firsts", firsts)).apply(PredicateFilter("several", F.col("payload.n") > 1)).sink(DevNullSink("sink"))
    return outputs(spark, p, events(spark, sf_dir))["sink"].select("payload.user_id", F.col("src_offset").alias("first"), "payload.n")
