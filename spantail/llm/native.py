"""Matches of a pattern with their places, and texts put together again, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are summed up at a time.
BLOCK = 128


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, none of which may be empty.

    start and end (exclusive) are code points of the whole match; value is a group of it. The text
    between matches comes from split, so places are sums of lengths. Null texts have no matches.
    """
    gaps, found, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), F.arrays_zip(found.alias("whole"), values.alias("value")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["whole"]).alias("size"), m["value"].alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), once(sizes, _placed)).otherwise(none)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(sizes: Column) -> Column:
    """Matches with their places: summed up in blocks, as a list that grows is copied each time."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def within(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda s, m: F.struct((s["at"] + m["gap"] + m["size"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["size"]).alias("end"), m["value"].alias("value")))).alias("out")),
        )

    def joined(blocks: Column) -> Column:
        begin = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )
        moved = lambda b, at: F.transform(b["out"], lambda m: F.struct((m["start"] + at).alias("start"), (m["end"] + at).alias("end"), m["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, begin, moved))

    last = F.floor((F.size(sizes) - 1) / BLOCK).cast("int")
    return once(F.transform(F.sequence(F.lit(0), last), lambda b: within(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))), joined)


def replaced(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """text with each match of the pattern changed. Texts without a match stay as they are."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.concat_ws("", F.flatten(F.zip_with(gaps, F.transform(found, change), lambda gap, m: F.array(gap, F.coalesce(m, F.lit(""))))))
    return F.when(text.rlike(pattern), joined).otherwise(text)


def cut(text: Column, spans: Column, instead: str = "") -> Column:
    """text with its spans of code points, which are in order and apart, replaced."""
    begin = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    end = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    return F.when(F.size(spans) > 0, F.array_join(F.zip_with(begin, end, lambda a, b: F.substr(text, a + 1, b - a)), instead)).otherwise(text)


def merged(spans: Column) -> Column:
    """Spans in order, those that touch or overlap joined."""
    return F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
