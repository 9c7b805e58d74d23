"""The sampler with a cap on traces: one ordered run over all batches.

A cap on the number of buffered traces couples every trace to every other, so its exact outcome needs
one total order. `Sampler` is that machine; `Replay` feeds it span by span and can be set down after any.

`replayed` cuts the order into chunks, anywhere, and runs each from a guess of what waits at its start:
nothing, and from then on what the chunk before left in its last run. Chunks whose guess was wrong run
again. The first chunk's start is known, so once every guess agrees all of them are right. Under a cap
or a wait what came long before no longer counts and two rounds do; where starts still change after
ROUNDS of them, the rest runs as one chunk. A task holds what the sampler holds, not its chunk.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantail.operators.policies import Policy, matches
from spantail.shared import written
from spantail.ship import ship

#: Rounds after which chunks whose start still changes run as one.
ROUNDS = 4
#: Kinds of rows of a replay, in their order within a batch: a state to go on from, a trace that the batch brings, spans.
STATE, COMING, SPAN, MATCH = range(4)


@dataclass
class Span:
    trace_id: str
    span_id: str
    match: bool
    payload: object = None


@dataclass
class Trace:
    arrival: float
    spans: list[Span] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)
    held: bool = False


class Sampler:
    """Buffers traces, decides once a batch, drops what no span keeps in time.

    Sink: gets the spans of a kept trace; if it raises, the trace is held and sent again when it is
    touched next, or at the end. Held traces neither expire nor make room.
    """

    def __init__(self, sink: Callable[[list[Span]], None], wait: float = 0, max_traces: int = 0, max_spans: int = 0):
        self.sink, self.wait, self.max_traces, self.max_spans = sink, wait, max_traces, max_spans
        self.traces: OrderedDict[str, Trace] = OrderedDict()
        self.dropped_max_traces = self.dropped_max_spans = self.not_sampled = self.sampled_spans = 0

    @property
    def dropped(self) -> int:
        return self.dropped_max_traces + self.dropped_max_spans

    @property
    def pending(self) -> list[str]:
        return [i for i, t in self.traces.items() if not t.held]

    def consume(self, batch: Iterable[Span], now: float) -> Exception | None:
        """One batch at one instant; returns the sink's first error."""
        batch = list(batch)
        self.expire(now, skip={s.trace_id for s in batch})
        touched = dict.fromkeys(s.trace_id for s in batch if self._ingest(s, now))
        errors = [e for e in map(self._decide, [i for i in touched if i in self.traces]) if e]
        self.expire(now)
        return errors[0] if errors else None

    def _ingest(self, span: Span, now: float) -> bool:
        trace = self.traces.get(span.trace_id)
        if trace is None:
            if 0 < self.max_traces <= len(self.traces):
                oldest = next((i for i, t in self.traces.items() if not t.held), None)
                if oldest is None:
                    self.dropped_max_traces += 1
                    return False
                del self.traces[oldest]
                self.not_sampled += 1
            trace = self.traces[span.trace_id] = Trace(now)
        if 0 < self.max_spans <= len(trace.spans):
            self.dropped_max_spans += 1
        elif not (span.span_id or "").strip("0") or span.span_id not in trace.seen:
            trace.seen.add(span.span_id)
            trace.spans.append(span)
        return True

    def _decide(self, trace_id: str) -> Exception | None:
        trace = self.traces[trace_id]
        if not trace.held and not any(s.match for s in trace.spans):
            return None
        try:
            self.sink(trace.spans)
        except Exception as e:
            trace.held = True
            return e
        self.sampled_spans += len(trace.spans)
        del self.traces[trace_id]
        return None

    def expire(self, now: float, skip: frozenset[str] | set[str] = frozenset()) -> None:
        """Drops pending traces whose wait is over; the ticker of a live sampler calls it between batches."""
        if self.wait <= 0:
            return
        due = [i for i, t in self.traces.items() if not t.held and i not in skip and t.arrival + self.wait <= now]
        for i in due:
            del self.traces[i]
        self.not_sampled += len(due)

    def shutdown(self) -> Exception | None:
        """Decides all once more; unless the sink fails, the rest is dropped."""
        errors = [e for e in map(self._decide, list(self.traces)) if e]
        if errors:
            return errors[0]
        self.not_sampled += len(self.traces)
        self.traces.clear()
        return None

    def buffered(self, ids: Iterable[str]) -> dict[str, int]:
        return {i: len(self.traces[i].spans) for i in dict.fromkeys(ids) if i in self.traces}


class Replay:
    """A sampler whose sink never fails, fed in order span by span, that can be set down after any of them.

    Before the spans of a batch come its trace ids, if there is a wait. Its state is what the sampler
    holds and which of that the batch has brought.
    """

    def __init__(self, sampler: Sampler, state: str | None = None):
        self.sampler, self.clock, self.begun = sampler, None, False
        self.coming: set[str] = set()
        self.touched: set[str] = set()
        if state:
            self.clock, self.begun, coming, touched, traces = json.loads(state)
            self.coming, self.touched = set(coming), set(touched)
            for trace_id, arrival, spans in traces:
                held = [Span(trace_id, i, m) for i, m in spans]
                sampler.traces[trace_id] = Trace(arrival, held, {s.span_id for s in held})

    def state(self) -> str:
        """What later outcomes hang on, the same text for the same state."""
        traces = self.sampler.traces
        of = lambda ids: sorted(ids & traces.keys(), key=lambda i: (i is None, i))
        return json.dumps([self.clock, self.begun, of(self.coming), of(self.touched), [(i, t.arrival, [(s.span_id, s.match) for s in t.spans]) for i, t in traces.items()]])

    def comes(self, batch: int, trace_id: str) -> None:
        self._enter(batch)
        if trace_id in self.sampler.traces:
            self.coming.add(trace_id)

    def span(self, batch: int, span: Span) -> None:
        self._enter(batch)
        if not self.begun:
            self.sampler.expire(batch, self.coming)
            self.begun = True
        if self.sampler._ingest(span, batch):
            self.touched.add(span.trace_id)
            if len(self.touched) > 2 * len(self.sampler.traces) + 1000:
                self.touched &= self.sampler.traces.keys()

    def end(self) -> None:
        """The batch is over."""
        if self.clock is not None:
            for i in self.touched & self.sampler.traces.keys():
                self.sampler._decide(i)
            self.sampler.expire(self.clock)

    def _enter(self, batch: int) -> None:
        if batch != self.clock:
            self.end()
            self.clock, self.begun, self.coming, self.touched = batch, False, set(), set()


def _ordered(spans: DataFrame, policies: Sequence[Policy], order: Sequence[str], batch_col: str, wait: int, parts: int | None) -> DataFrame:
    """A written table of the rows of a replay (at, chunk, kind, batch, trace_id, span_id) in order of `at`; equal places in `order` go by ids."""
    kind = F.when(matches(policies), MATCH).otherwise(SPAN)
    rows = spans.select(F.col(batch_col).cast("long").alias("batch"), kind.alias("kind"), F.struct(*order).alias("order"), F.col("trace_id").cast("string"), F.col("span_id").cast("string")).where("batch is not null")
    if wait > 0:
        coming = rows.select("batch", "trace_id").distinct()
        rows = rows.unionByName(coming.withColumn("kind", F.lit(COMING)), allowMissingColumns=True)
    keys = ["batch", F.col("kind") > COMING, "order", "trace_id", "span_id", "kind"]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    at = dealt.sortWithinPartitions(*keys).select(F.monotonically_increasing_id().alias("at"), "kind", "batch", "trace_id", "span_id")
    return written(at.select("at", F.shiftright("at", 33).alias("chunk"), "kind", "batch", "trace_id", "span_id"), "ordered")[0]


def _run(rows: DataFrame, last: int, wait: int, max_traces: int, max_spans: int) -> DataFrame:
    """A written table of what each chunk of rows forwards (chunk, kind, batch, trace_id, span_id), and its end state as trace_id of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = machine = None

        def sink(spans: list[Span]) -> None:
            out.extend((now, SPAN, machine.clock, s.trace_id, s.span_id) for s in spans)

        def close() -> None:
            if machine:
                if now == last:
                    machine.end()
                out.append((now, STATE, 0, machine.state(), None))

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out.clear()
            return batch

        for batch in batches:
            for chunk, kind, clock, trace_id, span_id in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True):
                if chunk != now:
                    close()
                    now, machine = chunk, Replay(Sampler(sink, wait, max_traces, max_spans), trace_id if kind == STATE else None)
                if kind == COMING:
                    machine.comes(clock, trace_id)
                elif kind != STATE:
                    machine.span(clock, Span(trace_id, span_id, kind == MATCH))
            if out:
                yield given()
        close()
        if out:
            yield given()

    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("batch", pa.int64()), ("trace_id", pa.string()), ("span_id", pa.string())])
    ship(rows.sparkSession)
    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "at").select("chunk", "kind", "batch", "trace_id", "span_id")
    return written(dealt.mapInArrow(run, "chunk long, kind int, batch long, trace_id string, span_id string"), "forwarded")[0]


def replayed(spans: DataFrame, policies: Sequence[Policy], order: Sequence[str], batch_col: str = "batch", wait: int = 0, max_traces: int = 0, max_spans: int = 0, parts: int | None = None) -> DataFrame:
    """trace_id, span_id and batch of each forwarded span, as one run in the order of batches and `order` gives them, in `parts` chunks (None: as Spark deals them).

    Spans without a batch take no part. Chunks hand on their end states in a table; the driver sees their hashes.
    """
    spark = spans.sparkSession
    rows = _ordered(spans, policies, order, batch_col, wait, parts)
    chunks = todo = sorted(r.chunk for r in rows.select("chunk").distinct().collect())
    runs, last, started, ended = [], {}, dict.fromkeys(chunks), {}
    while todo:
        asked = rows.where(F.col("chunk").isin(todo))
        before = dict(zip(chunks[1:], chunks, strict=False))
        for n, run in enumerate(runs):
            onward = [(before[c], c) for c in todo if c in before and last[before[c]] == n]
            if onward:
                states = run.where(F.col("kind") == STATE).join(F.broadcast(spark.createDataFrame(onward, "chunk long, next long")), "chunk")
                asked = asked.unionByName(states.select(F.lit(-1).cast("long").alias("at"), F.col("next").alias("chunk"), "kind", "batch", "trace_id", "span_id"))
        started.update({c: ended.get(before.get(c)) for c in todo})
        found = _run(asked, chunks[-1], wait, max_traces, max_spans)
        ended.update(found.where(F.col("kind") == STATE).select("chunk", F.sha2("trace_id", 256)).collect())
        last.update(dict.fromkeys(todo, len(runs)))
        runs.append(found)
        todo = [c for c, b in zip(chunks[1:], chunks, strict=False) if started[c] != ended[b]]
        if todo and len(runs) >= ROUNDS:
            rows = rows.withColumn("chunk", F.least("chunk", F.lit(todo[0])))
            chunks, todo = [c for c in chunks if c <= todo[0]], todo[:1]
    out = [run.where((F.col("kind") == SPAN) & F.col("chunk").isin([c for c in chunks if last[c] == n])) for n, run in enumerate(runs)]
    none = spark.createDataFrame([], "trace_id string, span_id string, batch long")
    return reduce(DataFrame.unionAll, [o.select("trace_id", "span_id", "batch") for o in out], none)
