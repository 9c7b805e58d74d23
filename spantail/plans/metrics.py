"""Queries over counters: a table of ts, name and value, a value growing until its process starts anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increases(counters: DataFrame, by: tuple[str, ...] = ("name",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """counters with `increase` since the reading before; after a reset the value itself, at the first reading 0."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy(*order))
    return counters.withColumn("increase", F.when(before.isNull(), 0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))


def rates(counters: DataFrame, by: tuple[str, ...] = ("name",), order: tuple[str, ...] = ("ts",), width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """by, window_start, increase and rate (a second, rounded to 9 places) for each window with a reading."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    each = increases(counters, by, order).groupBy(*by, window.alias("w")).agg(F.sum("increase").alias("increase"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return each.select(*by, F.col("w.start").alias("window_start"), "increase", F.round(F.col("increase") / seconds, 9).alias("rate"))


def ratio(part: Column, rest: Column) -> Column:
    """part of part and rest, rounded to 6 places; null if both are 0."""
    return F.round(F.try_divide(part.cast("double"), (part + rest).cast("double")), 6)


def alerts(readings: DataFrame, above: float, value_col: str = "rate") -> DataFrame:
    """Readings over a threshold."""
    return readings.where(F.col(value_col) > above)
