"""Batch-faithful replay: what a sampler that decides at the end of each batch would have done.

Traces meet only through the times of batches, as long as the number of traces isn't capped, so a
replay is one fold a trace. Batches are numbers in order; the clock of a batch is its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantail.operators.policies import Policy, matches


def episodes(spans: DataFrame, policies: Sequence[Policy], batch_col: str = "batch") -> DataFrame:
    """spans with episode and sampled. Without a wait, a trace is forwarded at the end of its first matching batch; later spans open the next episode."""
    one = spans.withColumn("__match", matches(policies).cast("int"))
    per_batch = one.groupBy("trace_id", batch_col).agg(F.max("__match").alias("keep"))
    before = Window.partitionBy("trace_id").orderBy(batch_col).rowsBetween(Window.unboundedPreceding, -1)
    numbered = per_batch.withColumn("episode", F.coalesce(F.sum("keep").over(before), F.lit(0)))
    kept = F.max("keep").over(Window.partitionBy("trace_id", "episode"))
    numbered = numbered.withColumn("sampled", kept == 1).drop("keep")
    return one.drop("__match").join(numbered, ["trace_id", batch_col])


def episode_totals(spans: DataFrame, policies: Sequence[Policy], batch_col: str = "batch") -> DataFrame:
    """trace_id, episode, spans, sampled: counts alone, from (trace, batch) rows, without joining spans back."""
    per_batch = spans.groupBy("trace_id", batch_col).agg(F.max(matches(policies).cast("int")).alias("keep"), F.count("*").alias("n"))
    before = Window.partitionBy("trace_id").orderBy(batch_col).rowsBetween(Window.unboundedPreceding, -1)
    numbered = per_batch.withColumn("episode", F.coalesce(F.sum("keep").over(before), F.lit(0)))
    return numbered.groupBy("trace_id", "episode").agg(F.sum("n").alias("spans"), (F.max("keep") == 1).alias("sampled"))


def due_batches(spans: DataFrame, wait: int, batch_col: str = "batch") -> DataFrame:
    """batch and due: the first batch of the whole input at or after batch + wait, or null.

    One row for each batch, of which there are as many as the clock has ticks, not as the input has spans:
    ten years of batches of a minute are 5.3 million rows of two numbers, which one task sorts.
    """
    batches = spans.select(F.col(batch_col).alias("batch")).distinct()
    both = batches.select(F.col("batch").alias("at"), F.col("batch"), F.lit(1).alias("asks")).unionAll(batches.select((F.col("batch") + wait).alias("at"), F.col("batch"), F.lit(2).alias("asks")))
    after = Window.orderBy(F.col("at"), F.col("asks").desc()).rowsBetween(0, Window.unboundedFollowing)
    next_batch = F.min(F.when(F.col("asks") == 1, F.col("batch"))).over(after)
    return both.withColumn("due", next_batch).where("asks = 2").select("batch", "due")


def decision_wait(spans: DataFrame, policies: Sequence[Policy], wait: int, batch_col: str = "batch") -> DataFrame:
    """trace_id, first_batch, last_batch, spans, outcome of each buffered trace: sampled, not_sampled or drained.

    wait is in units of the batch number; zero or less: none expires before the end. Before each batch
    b of a trace it expires if some batch of the input came at or after arrival + wait and before b;
    a trace that is due in b gets b's spans first and expires only if it still doesn't match.
    """
    per_batch = spans.groupBy("trace_id", F.col(batch_col).alias("batch")).agg(F.max(matches(policies).cast("int")).alias("keep"), F.count("*").alias("n"))
    if wait > 0:
        per_batch = per_batch.join(due_batches(spans, wait, batch_col), "batch")
    else:
        per_batch = per_batch.withColumn("due", F.lit(None).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("batch", "keep", "n", "due")))
    none = F.array().cast("array<struct<first_batch:bigint,last_batch:bigint,spans:bigint,outcome:string>>")
    state = F.struct(F.lit(None).cast("long").alias("arrival"), F.lit(None).cast("long").alias("due"), F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"), none.alias("out"))

    def closed(s, last, n, outcome):
        return F.concat(s["out"], F.array(F.struct(s["arrival"].alias("first_batch"), last.alias("last_batch"), n.alias("spans"), F.lit(outcome).alias("outcome"))))

    def step(s, b):
        expired = s["due"] < b["batch"]
        held = s["arrival"].isNotNull() & ~F.coalesce(expired, F.lit(False))
        at = F.struct(
            F.when(held, s["arrival"]).otherwise(b["batch"].cast("long")).alias("arrival"),
            F.when(held, s["due"]).otherwise(b["due"].cast("long")).alias("due"),
            b["batch"].cast("long").alias("last"),
            (F.when(held, s["n"]).otherwise(F.lit(0)) + b["n"]).cast("long").alias("n"),
            F.when(F.coalesce(expired, F.lit(False)), closed(s, s["last"], s["n"], "not_sampled")).otherwise(s["out"]).alias("out"),
        )
        return decided(at, b)

    def decided(at, b):
        empty = F.lit(None).cast("long")
        keep, late = b["keep"] == 1, F.coalesce(at["due"] <= b["batch"], F.lit(False))
        done = F.when(keep, closed(at, at["last"], at["n"], "sampled")).when(late, closed(at, at["last"], at["n"], "not_sampled")).otherwise(at["out"])
        over = keep | late
        return F.struct(F.when(~over, at["arrival"]).otherwise(empty).alias("arrival"), F.when(~over, at["due"]).otherwise(empty).alias("due"), F.when(~over, at["last"]).otherwise(empty).alias("last"), F.when(~over, at["n"]).otherwise(F.lit(0)).cast("long").alias("n"), done.alias("out"))

    def end(s):
        outcome = F.when(s["due"].isNotNull(), F.lit("not_sampled")).otherwise(F.lit("drained"))
        return F.when(s["arrival"].isNotNull(), F.concat(s["out"], F.array(F.struct(s["arrival"].alias("first_batch"), s["last"].alias("last_batch"), s["n"].alias("spans"), outcome.alias("outcome"))))).otherwise(s["out"])

    folded = per_batch.groupBy("trace_id").agg(rows.alias("rows")).select("trace_id", F.aggregate("rows", state, step, end).alias("out"))
    return folded.select("trace_id", F.inline("out"))
