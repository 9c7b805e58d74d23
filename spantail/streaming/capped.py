"""The sampler over a stream with a cap on buffered traces.

A cap needs an order over all traces that share it. Traces are dealt to buckets by a hash of their id,
and each bucket keeps at most its share of max_traces: exact with one bucket, and otherwise near it, as
every bucket evicts its own oldest. A bucket's order is one small value; spans are in a map of state by
trace, so a micro-batch reads only the traces that it touches. The rules are those of operators.exact,
but for the wait: a trace goes when a timer of its bucket passes its first span's time and the wait. Clocks
are those of streaming.sampler.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spantail.operators.policies import Policy, matches
from spantail.ship import ship
from spantail.streaming.listener import MAX_SPANS, NOT_SAMPLED, incoming, is_span, observed
from spantail.streaming.sampler import CLOCKS, plain, prepare, told, with_counts


class CappedSampling(StatefulProcessor):
    """max_traces: of one bucket. wait_ms, max_traces and max_spans are off at zero or less."""

    def __init__(self, payload: T.StructType, wait_ms: int, max_traces: int, max_spans: int, arrival: bool):
        self.names, self.wait_ms, self.max_traces, self.max_spans, self.arrival = payload.fieldNames(), wait_ms, max_traces, max_spans, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = handle.getValueState("order", "held binary")
        self.spans = handle.getMapState("spans", "trace_id string", "held binary")

    def _arrivals(self) -> dict[str, int]:
        """Arrival of each waiting trace, oldest first."""
        return pickle.loads(self.order.get()[0]) if self.order.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True).sort_values("span_at", kind="stable")
        arrivals = self._arrivals()
        touched: dict[str, list] = {}
        hits: set[str] = set()
        seen: dict[str, set] = {}
        dropped = evicted = 0
        clock = timerValues.getCurrentProcessingTimeInMs() if self.arrival else None
        ids, span_ids = new["trace_id"], new["span_id"]
        for trace, span, at, hit, row in zip(ids, span_ids, new["span_at"], new["span_match"], new[self.names].itertuples(index=False, name=None), strict=True):
            if trace not in arrivals:
                if 0 < self.max_traces <= len(arrivals):
                    oldest = next(iter(arrivals))
                    del arrivals[oldest]
                    touched.pop(oldest, None)
                    seen.pop(oldest, None)
                    hits.discard(oldest)
                    evicted += 1
                    if self.spans.containsKey((oldest,)):
                        self.spans.removeKey((oldest,))
                arrivals[trace] = int(at) if clock is None else clock
                touched[trace], seen[trace] = [], set()
                if self.wait_ms > 0:
                    self.handle.registerTimer(arrivals[trace] + self.wait_ms)
            if trace not in touched:
                touched[trace] = pickle.loads(self.spans.getValue((trace,))[0])
                seen[trace] = {s for s, _ in touched[trace]}
            held = touched[trace]
            if 0 < self.max_spans <= len(held):
                dropped += 1
                continue
            if not str(span or "").strip("0") or span not in seen[trace]:
                seen[trace].add(span)
                held.append((span, plain(row)))
                if hit:
                    hits.add(trace)
        out = []
        for trace, held in touched.items():
            if trace in hits:
                out += [row for _, row in held]
                del arrivals[trace]
                if self.spans.containsKey((trace,)):
                    self.spans.removeKey((trace,))
            else:
                self.spans.updateValue((trace,), (pickle.dumps(held),))
        self.order.update((pickle.dumps(arrivals),))
        yield told(self.names, out, **{MAX_SPANS: dropped, NOT_SAMPLED: evicted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrivals, now = self._arrivals(), expiredTimerInfo.getExpiryTimeInMs()
        due = [t for t, at in arrivals.items() if at + self.wait_ms <= now]
        for trace in due:
            del arrivals[trace]
            self.spans.removeKey((trace,))
        if due:
            self.order.update((pickle.dumps(arrivals),))
        yield told(self.names, [], **{NOT_SAMPLED: len(due)})

    def close(self) -> None:
        pass


def capped_stream(spans: DataFrame, policies: Sequence[Policy], wait_s: float, max_traces: int, buckets: int = 64, max_spans: int = 0, time_col: str = "timestamp", clock: str = "arrival", late: str = "0 seconds") -> DataFrame:
    """The forwarded spans of a stream, with its columns, with at most about max_traces waiting traces. An evicted trace counts as not sampled."""
    if buckets < 1:
        raise ValueError("buckets must be positive")
    prepare(spans.sparkSession)
    ship(spans.sparkSession)
    payload = spans.schema
    each = -(-max_traces // buckets) if max_traces > 0 else 0
    marked = incoming(spans).withColumns({"span_match": matches(policies), "span_at": F.unix_millis(time_col), "bucket": F.pmod(F.xxhash64("trace_id"), F.lit(buckets))})
    kept = (marked.withWatermark(time_col, late) if clock == "event" else marked).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=CappedSampling(payload, int(wait_s * 1000), each, max_spans, clock != "event"), outputStructType=with_counts(payload), outputMode="Append", timeMode=CLOCKS[clock]
    )
    return observed(kept).where(is_span()).select(*[F.col(f"`{c}`") for c in spans.columns])
