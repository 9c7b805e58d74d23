"""Tail sampling of a stream: keyed state and one timer for each trace that waits.

A trace's spans are buffered in state until one of them matches; then all leave at once and the state
goes. Input of a micro-batch is handled before its timers, so a late match still keeps its trace. A span
that comes after the decision starts a new trace. The state is in RocksDB and spills; a failed
micro-batch is replayed from the checkpoint, so nothing has to be held for a sink that failed.

The clock is that of arrival: the wait begins with the micro-batch of a trace's first span, no span is
late, and traces expire in micro-batches without input, too. With clock="event" it is the spans' own time
behind a watermark, which gives the same result each time; there time stands still without input, and
spans behind the watermark are dropped, which the listener counts. A query on the clock of arrival has
no end of its own, so it takes a trigger by interval (half the wait, say); availableNow needs the other.

What is dropped comes out of the processor as counts, is observed, and leaves the stream. After a query
was stopped, `waiting` reads what its state still holds: as every batch was decided when it came, none of
it matches, and a sampler that shuts down counts it as not sampled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spantail.config import SamplerConfig
from spantail.operators.policies import Policy, compiled, matches
from spantail.ship import ship
from spantail.streaming.listener import COUNT, EVENT, MAX_SPANS, NOT_SAMPLED, incoming, is_span, observed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Clocks and Spark's names for them.
CLOCKS = {"arrival": "ProcessingTime", "event": "EventTime"}


def plain(row: tuple) -> tuple:
    """A row of pandas values as Python values, as state takes them."""
    return tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in row)


def with_counts(payload: T.StructType) -> T.StructType:
    """The schema of spans and counts."""
    fields = [T.StructField(f.name, f.dataType, True) for f in payload.fields]
    return T.StructType([*fields, T.StructField(EVENT, T.StringType()), T.StructField(COUNT, T.LongType())])


def told(names: Sequence[str], spans: Sequence[tuple], **counts: int) -> pd.DataFrame:
    """Spans that leave, and counts of others."""
    rows = [(*s, None, None) for s in spans] + [(*[None] * len(names), k, n) for k, n in counts.items() if n]
    return pd.DataFrame(rows, columns=[*names, EVENT, COUNT], dtype=object)


class TailSampling(StatefulProcessor):
    """The processor. payload: schema of the buffered columns; wait_ms and max_spans: off at zero or less."""

    def __init__(self, payload: T.StructType, wait_ms: int, max_spans: int, arrival: bool):
        self.payload, self.wait_ms, self.max_spans, self.arrival = payload, wait_ms, max_spans, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", "at long")
        self.spans = handle.getListState("spans", self.payload)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        new = new.sort_values("span_at", kind="stable")
        held = list(self.spans.get()) if self.deadline.exists() else []
        names = self.payload.fieldNames()
        place = names.index("span_id")
        seen = {s[place] for s in held}
        match, fresh, dropped = False, [], 0
        for n, (row, found) in enumerate(zip(new[names].itertuples(index=False, name=None), new["span_match"], strict=True)):
            if 0 < self.max_spans <= len(held) + len(fresh):
                dropped = len(new) - n
                break
            if not str(row[place] or "").strip("0") or row[place] not in seen:
                seen.add(row[place])
                fresh.append(plain(row))
                match = match or bool(found)
        if match:
            if self.deadline.exists():
                if self.wait_ms > 0:
                    self.handle.deleteTimer(self.deadline.get()[0])
                self.deadline.clear()
                self.spans.clear()
            yield told(names, [*map(tuple, held), *fresh], **{MAX_SPANS: dropped})
            return
        if not self.deadline.exists():
            now = timerValues.getCurrentProcessingTimeInMs() if self.arrival else int(new["span_at"].min())
            self.deadline.update((now + self.wait_ms,))
            if self.wait_ms > 0:
                self.handle.registerTimer(now + self.wait_ms)
        if fresh:
            self.spans.appendList(fresh)
        yield told(names, [], **{MAX_SPANS: dropped})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.deadline.clear()
        self.spans.clear()
        yield told(self.payload.fieldNames(), [], **{NOT_SAMPLED: 1})

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """State that spills needs this provider; it must be set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def sampled_stream(spans: DataFrame, policies: Sequence[Policy], wait_s: float, max_spans: int = 0, time_col: str = "timestamp", clock: str = "arrival", late: str = "0 seconds") -> DataFrame:
    """The forwarded spans of a stream, with its columns. time_col orders the spans of a batch; late is the watermark's delay, if the clock is theirs."""
    prepare(spans.sparkSession)
    ship(spans.sparkSession)
    payload = spans.schema
    marked = incoming(spans).withColumn("span_match", matches(policies)).withColumn("span_at", F.unix_millis(time_col))
    kept = (marked.withWatermark(time_col, late) if clock == "event" else marked).groupBy("trace_id").transformWithStateInPandas(
        statefulProcessor=TailSampling(payload, int(wait_s * 1000), max_spans, clock != "event"),
        outputStructType=with_counts(payload),
        outputMode="Append",
        timeMode=CLOCKS[clock],
    )
    return observed(kept).where(is_span()).select(*[F.col(f"`{c}`") for c in spans.columns])


def stream_of(spans: DataFrame, config: SamplerConfig, **options) -> DataFrame:
    """The forwarded spans of a stream by the settings: with a cap on waiting traces if max_traces says so."""
    from spantail.streaming.capped import capped_stream

    config.validate()
    policies = compiled(config.policies)
    if config.max_traces > 0:
        return capped_stream(spans, policies, config.decision_wait_s, config.max_traces, max_spans=config.max_spans_per_trace, **options)
    return sampled_stream(spans, policies, config.decision_wait_s, config.max_spans_per_trace, **options)


def waiting(spark: SparkSession, checkpoint: str, ids: Sequence[str] | None = None) -> DataFrame:
    """trace_id and spans of each trace that waits in the state of a stopped sampled_stream, of those asked for if there are ids."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "spans").load()
    held = state.groupBy(F.col("key.trace_id").alias("trace_id")).agg(F.count("*").alias("spans"))
    return held if ids is None else held.where(F.col("trace_id").isin(list(ids)))
