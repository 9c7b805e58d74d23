import datetime as dt
import json
import os
import time

from spantail.config import PolicyConfig, SamplerConfig
from spantail.operators.policies import compiled
from spantail.streaming.listener import LATE, MAX_SPANS, MAX_TRACES, NOT_SAMPLED, SAMPLED, SPANS, Counters
from spantail.streaming.sampler import sampled_stream, stream_of, waiting

SCHEMA = "trace_id string, span_id string, status_code string, duration_ns long, timestamp timestamp"
T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def put(folder, n, rows):
    lines = [json.dumps({"trace_id": t, "span_id": s, "status_code": c, "duration_ns": 1, "timestamp": (T0 + dt.timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%S.000Z")}) for t, s, c, at in rows]
    path = folder / f"{n:03}.json"
    path.write_text("\n".join(lines))
    os.utime(path, (n + 1, n + 1))  # the source reads files in this order


def told(counters, query, expected):
    for _ in range(150):
        found = {name: n for (q, name), n in counters.totals.items() if q == query}
        if found == expected:
            return
        time.sleep(0.2)
    assert found == expected


def test_keep_late_keep_duplicate_cap_and_expiry(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    batches = [
        [("a", "1", "OK", 0), ("b", "1", "ERROR", 0), ("e", "1", "OK", 0), ("g", "1", "OK", 0)],
        [("a", "2", "OK", 1), ("a", "1", "OK", 1), ("c", "1", "OK", 1)],
        [("a", "3", "ERROR", 2), ("d", "1", "OK", 30)],
        [("e", "2", "ERROR", 60), ("c", "2", "OK", 61)],
        [("f", "1", "OK", 120), ("f", "2", "OK", 120), ("f", "3", "ERROR", 120), ("g", "2", "ERROR", 120)],
    ]
    for n, rows in enumerate(batches):
        put(source, n, rows)
        os.utime(source / f"{n:03}.json", (n + 1, n + 1))
    spans = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    out = sampled_stream(spans, compiled([PolicyConfig("status_code", keep="ERROR")]), wait_s=10, max_spans=2, clock="event")
    counters = Counters()
    spark.streams.addListener(counters)
    query = out.writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    # a, c, d and g expire; a second of a, its third and f's third come at the cap
    told(counters, "kept", {SPANS: sum(map(len, batches)), SAMPLED: 4, MAX_SPANS: 3, MAX_TRACES: 0, NOT_SAMPLED: 4, LATE: 0})
    spark.streams.removeListener(counters)
    assert counters.table(spark).where("name = 'sampled_spans'").agg({"value": "max"}).first()[0] == 4
    got = sorted((r.trace_id, r.span_id) for r in spark.table("kept").collect())
    # a, f: the cap of two hides the error; b: kept at once; e: due, but its input comes first; g: expired, then a new trace
    assert got == [("b", "1"), ("e", "1"), ("e", "2"), ("g", "2")]


def test_a_failed_sink_stores_each_span_once(spark, tmp_path):
    """From files through the sampler to the store; the sink fails after it wrote, and the query starts again."""
    from pyspark.sql import functions as F

    from spantail.config import StoreConfig
    from spantail.sources.store import SpanStore

    source = tmp_path / "in"
    source.mkdir()
    put(source, 0, [("a", "1", "OK", 0), ("a", "2", "ERROR", 0), ("b", "1", "OK", 0)])
    put(source, 1, [("b", "2", "ERROR", 1), ("c", "1", "ERROR", 1)])
    store = SpanStore(spark, StoreConfig(location=f"file://{tmp_path}/store"))
    spans = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    kept = sampled_stream(spans, compiled([PolicyConfig("status_code", keep="ERROR")]), wait_s=10, clock="event")
    rows = kept.select("timestamp", (F.unix_micros("timestamp") * 1000).alias("timestamp_ns"), "trace_id", "span_id", F.lit("op").alias("name"), "status_code", "duration_ns", F.create_map(F.lit("k"), F.col("span_id")).alias("attributes"))
    failures = [1]

    def sink(df, batch_id):
        store.write(df, batch_id, stream="s")
        if failures:
            failures.pop()
            raise RuntimeError("after the write")

    for _ in range(2):
        query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(300)
        except Exception:
            assert not failures
    got = sorted((r.trace_id, r.span_id) for r in store.read().collect())
    assert got == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1")]
    assert sorted(r.trace_id for r in store.where_attr("k", "2").collect()) == ["a", "b"]


def test_capped_stream_equals_the_exact_sampler(spark, tmp_path):
    import random

    from spantail.operators.exact import Sampler, Span
    from spantail.streaming.capped import capped_stream

    source = tmp_path / "in"
    source.mkdir()
    r = random.Random(3)
    expected, at = [], 0
    machine = Sampler(lambda spans: expected.extend((s.trace_id, s.span_id) for s in spans), max_traces=4, max_spans=3)
    for n in range(5):
        rows = []
        for _ in range(12):
            at += 1
            rows.append((f"t{r.randint(0, 9)}", str(r.randint(1, 5)), r.choice(["OK"] * 5 + ["ERROR"]), at))
        put(source, n, rows)
        os.utime(source / f"{n:03}.json", (n + 1, n + 1))
        machine.consume([Span(t, s, c == "ERROR") for t, s, c, _ in rows], at)
    spans = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    out = capped_stream(spans, compiled([PolicyConfig("status_code", keep="ERROR")]), wait_s=0, max_traces=4, buckets=1, max_spans=3, clock="event")
    counters = Counters()
    spark.streams.addListener(counters)
    query = out.writeStream.format("memory").queryName("capped").outputMode("append").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert sorted((x.trace_id, x.span_id) for x in spark.table("capped").collect()) == sorted(expected) and expected
    told(counters, "capped", {SPANS: 60, SAMPLED: machine.sampled_spans, MAX_SPANS: machine.dropped_max_spans, MAX_TRACES: machine.dropped_max_traces, NOT_SAMPLED: machine.not_sampled, LATE: 0})
    spark.streams.removeListener(counters)
    assert machine.not_sampled > 0


def test_a_stream_equals_the_exact_sampler(spark, tmp_path):
    """Random batches; the times of one batch are equal and the watermark is that of the batch before, as Spark moves it."""
    import random

    from spantail.operators.exact import Sampler, Span

    source = tmp_path / "in"
    source.mkdir()
    r = random.Random(11)
    expected = []
    machine = Sampler(lambda spans: expected.extend((s.trace_id, s.span_id) for s in spans), max_spans=3)
    for n in range(5):
        rows = [(f"t{r.randint(0, 9)}", str(r.randint(1, 5)), r.choice(["OK"] * 5 + ["ERROR"]), n) for _ in range(12)]
        put(source, n, rows)
        machine.consume([Span(t, s, c == "ERROR") for t, s, c, _ in rows], n)
    spans = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    out = stream_of(spans, SamplerConfig((PolicyConfig("status_code", keep="ERROR"),), decision_wait_s=0, max_traces=0, max_spans_per_trace=3), clock="event")
    counters = Counters()
    spark.streams.addListener(counters)
    query = out.writeStream.format("memory").queryName("plainly").outputMode("append").option("checkpointLocation", str(tmp_path / "cp4")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert sorted((x.trace_id, x.span_id) for x in spark.table("plainly").collect()) == sorted(expected) and expected
    told(counters, "plainly", {SPANS: 60, SAMPLED: machine.sampled_spans, MAX_SPANS: machine.dropped_max_spans, MAX_TRACES: 0, NOT_SAMPLED: 0, LATE: 0})
    spark.streams.removeListener(counters)
    left = {x.trace_id: x.spans for x in waiting(spark, str(tmp_path / "cp4")).collect()}
    assert left == {t: len(x.spans) for t, x in machine.traces.items()} and left
    some = sorted(left)[:2]
    assert {x.trace_id for x in waiting(spark, str(tmp_path / "cp4"), some).collect()} == set(some)


def test_late_spans_are_counted(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, 0, [("a", "1", "OK", 100)])
    put(source, 1, [("b", "1", "OK", 101)])
    put(source, 2, [("c", "1", "ERROR", 5), ("d", "1", "ERROR", 102)])
    spans = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    out = sampled_stream(spans, compiled([PolicyConfig("status_code", keep="ERROR")]), wait_s=1000, clock="event")
    counters = Counters()
    spark.streams.addListener(counters)
    out.writeStream.format("memory").queryName("behind").option("checkpointLocation", str(tmp_path / "cp5")).trigger(availableNow=True).start().awaitTermination(300)
    told(counters, "behind", {SPANS: 4, SAMPLED: 1, MAX_SPANS: 0, MAX_TRACES: 0, NOT_SAMPLED: 0, LATE: 1})
    spark.streams.removeListener(counters)


def test_traces_expire_by_arrival_without_input(spark, tmp_path):
    """No span is late, however old; what waits goes though nothing more comes."""
    source = tmp_path / "in"
    source.mkdir()
    put(source, 0, [("a", "1", "OK", 100), ("b", "1", "ERROR", 100)])
    put(source, 1, [("c", "1", "ERROR", 5), ("d", "1", "OK", 6)])
    spans = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    for name, out in (("arrival", sampled_stream(spans, compiled([PolicyConfig("status_code", keep="ERROR")]), wait_s=1)), ("shared", stream_of(spans, SamplerConfig((PolicyConfig("status_code", keep="ERROR"),), decision_wait_s=1, max_traces=100), buckets=1))):
        counters = Counters()
        spark.streams.addListener(counters)
        query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="500 milliseconds").start()
        told(counters, name, {SPANS: 4, SAMPLED: 2, MAX_SPANS: 0, MAX_TRACES: 0, NOT_SAMPLED: 2, LATE: 0})
        query.stop()
        spark.streams.removeListener(counters)
        assert {x.trace_id for x in spark.table(name).collect()} == {"b", "c"}


def test_two_streams_into_one_store(spark, tmp_path):
    """Batch 0 of two queries, and of a query with a new checkpoint: none replaces another's."""
    from pyspark.sql import functions as F

    from spantail.config import StoreConfig
    from spantail.sources.store import SpanStore

    source = tmp_path / "in"
    source.mkdir()
    put(source, 0, [("a", "1", "OK", 0)])
    store = SpanStore(spark, StoreConfig(location=f"file://{tmp_path}/store", flush_interval_s=0.2))
    spans = spark.readStream.schema(SCHEMA).json(str(source))
    rows = spans.select("timestamp", (F.unix_micros("timestamp") * 1000).alias("timestamp_ns"), "trace_id", "span_id", F.lit("op").alias("name"), "status_code", "duration_ns", F.create_map(F.lit("k"), F.col("span_id")).alias("attributes"))
    for n in range(3):
        query = store.stream(rows, str(tmp_path / f"cp{n}"))
        query.processAllAvailable()
        query.stop()
    assert store.read().count() == 3
