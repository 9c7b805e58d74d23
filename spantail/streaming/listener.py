"""Counters of running samplers, kept by a listener and read as a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Names under which a sampler observes its stream: what comes in, and what became of it.
INPUT, OUTCOME = "spantail_input", "spantail_outcome"
#: Counters: spans that came and spans that left; spans and traces that safeguards dropped; traces that no span kept in time.
SPANS, SAMPLED, MAX_SPANS, MAX_TRACES, NOT_SAMPLED, LATE = "input_spans", "sampled_spans", "dropped_max_spans", "dropped_max_traces", "not_sampled_traces", "late_spans"
#: Column of a sampler's raw output that tells counts from spans, and the column of the count.
EVENT, COUNT = "__event", "__count"


def observed(rows: DataFrame) -> DataFrame:
    """The raw output of a sampler, with its counts observed."""
    count = lambda name: F.coalesce(F.sum(F.when(F.col(EVENT) == name, F.col(COUNT))), F.lit(0)).alias(name)
    return rows.observe(OUTCOME, F.count_if(F.col(EVENT).isNull()).alias(SAMPLED), *map(count, (MAX_SPANS, MAX_TRACES, NOT_SAMPLED)))


def incoming(rows: DataFrame) -> DataFrame:
    return rows.observe(INPUT, F.count(F.lit(1)).alias(SPANS))


def is_span() -> Column:
    return F.col(EVENT).isNull()


class Counters(StreamingQueryListener):
    """Adds up what each micro-batch observed: one reading a batch, per query and counter.

    late_spans are those behind the watermark of an event-time sampler, which never reach it.
    """

    def __init__(self) -> None:
        self.totals: dict[tuple[str, str], int] = {}
        self.readings: list[tuple[dt.datetime, str, str, int]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        at = dt.datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
        query = progress.name or str(progress.id)
        new: dict[str, int] = {}
        for name in (INPUT, OUTCOME):
            if (row := progress.observedMetrics.get(name)) is not None:
                new |= row.asDict()
        if new:
            new[LATE] = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        for name, n in new.items():
            total = self.totals[query, name] = self.totals.get((query, name), 0) + (n or 0)
            self.readings.append((at, query, name, total))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """ts, query, name and value of every reading, as plans.metrics takes them."""
        return spark.createDataFrame(self.readings, "ts timestamp, query string, name string, value long")
