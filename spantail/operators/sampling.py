"""Whole-trace sampling over bounded tables of spans.

A span is a row with trace_id, span_id, status_code and duration_ns; any other column is payload and
stays with it. Its order of arrival is given by columns that are unique together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantail.operators.policies import Policy, first_match, matches


def _zero(span_id: str = "span_id") -> Column:
    return F.coalesce(F.col(span_id), F.lit("")).rlike("^0*$")


def kept_traces(spans: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """The distinct ids of traces with a matching span. The filter comes before the exchange."""
    return spans.where(matches(policies)).select("trace_id").distinct()


def forwarded(spans: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """All spans of the traces that match: a left semi join, whose smaller side Spark may broadcast."""
    return spans.join(kept_traces(spans, policies), "trace_id", "left_semi")


def forwarded_window(spans: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """The same in one exchange, without reading the spans twice; each trace is in one task."""
    any_of = F.max(matches(policies)).over(Window.partitionBy("trace_id"))
    return spans.withColumn("__kept", any_of).where("__kept").drop("__kept")


def not_sampled(spans: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """The distinct ids of traces that no span keeps by their deadline."""
    return trace_ids(spans).join(kept_traces(spans, policies), "trace_id", "left_anti")


def trace_ids(spans: DataFrame) -> DataFrame:
    """The distinct trace ids."""
    return spans.select("trace_id").distinct()


def decisions(spans: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """trace_id, spans, policy (the first in order that matches, or null) and sampled of each trace."""
    out = spans.groupBy("trace_id").agg(F.count("*").alias("spans"), first_match(policies).alias("policy"))
    return out.withColumn("sampled", F.col("policy").isNotNull())


def drop_rate(spans: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """traces, sampled_traces, not_sampled_traces and dropped_percent, rounded to 6 places."""
    kept = F.count_if("sampled")
    return decisions(spans, policies).agg(
        F.count("*").alias("traces"),
        kept.alias("sampled_traces"),
        (F.count("*") - kept).alias("not_sampled_traces"),
        F.round(F.lit(100.0) * (F.count("*") - kept) / F.greatest(F.count("*"), F.lit(1)), 6).alias("dropped_percent"),
    )


def deduplicated(spans: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """The first span of each span_id within a trace; spans without an id all stay."""
    first = F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy(*arrival))
    return spans.withColumn("__n", F.when(_zero(), F.lit(1)).otherwise(first)).where("__n = 1").drop("__n")


def capped(spans: DataFrame, max_spans: int, arrival: Sequence[str]) -> DataFrame:
    """spans with `fate`: kept, duplicate, or dropped.

    A span is dropped if the trace holds max_spans distinct ones already, even if it repeats one of
    them; only then is it a duplicate. Zero or less: no cap. Spans are dealt by trace once, which serves
    both windows and whatever groups by trace after them.
    """
    spans = spans.repartition("trace_id")
    by_trace = Window.partitionBy("trace_id").orderBy(*arrival)
    fresh = F.when(_zero(), F.lit(1)).otherwise((F.row_number().over(Window.partitionBy("trace_id", "span_id").orderBy(*arrival)) == 1).cast("int"))
    held = F.coalesce(F.sum("__fresh").over(by_trace.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = F.col("__held") >= max_spans if max_spans > 0 else F.lit(False)
    marked = spans.withColumn("__fresh", fresh).withColumn("__held", held)
    return marked.withColumn("fate", F.when(full, "dropped").when(F.col("__fresh") == 0, "duplicate").otherwise("kept")).drop("__fresh", "__held")


def sampled(spans: DataFrame, policies: Sequence[Policy], max_spans: int, arrival: Sequence[str]) -> DataFrame:
    """Forwarded spans after the cap and deduplication, which may hide a span that would keep its trace."""
    return forwarded_window(capped(spans, max_spans, arrival).where("fate = 'kept'").drop("fate"), policies)


def counters(spans: DataFrame, policies: Sequence[Policy], max_spans: int, arrival: Sequence[str]) -> DataFrame:
    """One row: dropped_max_traces, dropped_max_spans, dropped (both), not_sampled_traces and sampled_spans."""
    marked = capped(spans, max_spans, arrival).withColumn("__match", matches(policies) & (F.col("fate") == "kept"))
    each = marked.groupBy("trace_id").agg(F.count_if(F.col("fate") == "kept").alias("kept"), F.count_if(F.col("fate") == "dropped").alias("dropped"), F.bool_or("__match").alias("match"))
    dropped = F.coalesce(F.sum("dropped"), F.lit(0))
    return each.agg(
        F.lit(0).cast("long").alias("dropped_max_traces"),
        dropped.alias("dropped_max_spans"),
        dropped.alias("dropped"),
        F.count_if(~F.col("match")).alias("not_sampled_traces"),
        F.coalesce(F.sum(F.when(F.col("match"), F.col("kept"))), F.lit(0)).alias("sampled_spans"),
    )


def buffered_span_counts(spans: DataFrame, policies: Sequence[Policy], ids: Sequence[str] | None = None, batch_col: str = "batch", until: int | None = None) -> DataFrame:
    """trace_id and spans of what waits after the batches up to `until`, without a wait: spans since the last batch that matched."""
    seen = spans if until is None else spans.where(F.col(batch_col) <= until)
    seen = seen if ids is None else seen.where(F.col("trace_id").isin(list(ids)))
    last = F.max(F.when(matches(policies), F.col(batch_col))).over(Window.partitionBy("trace_id"))
    waiting = seen.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(batch_col) > F.col("__last")))
    return waiting.groupBy("trace_id").agg(F.count("*").alias("spans"))


def last_traces(spans: DataFrame, max_traces: int, arrival: Sequence[str]) -> DataFrame:
    """The traces that stay buffered when none is ever kept: the max_traces whose first span came last.

    Each trace's first arrival is found by a grouped minimum; the top-k needs no full sort.
    """
    first = spans.groupBy("trace_id").agg(F.min(F.struct(*arrival)).alias("first"))
    return first.orderBy(F.desc("first")).limit(max_traces).select("trace_id")
