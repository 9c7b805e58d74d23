"""Scalar functions of spans, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status codes on the wire.
STATUS_OK, STATUS_ERROR = 1, 2


def duration_ns(start: Column, end: Column) -> Column:
    """Nanoseconds from start to end; 0 where the end is earlier."""
    return F.greatest(end - start, F.lit(0).cast("long"))


def status_text(code: Column) -> Column:
    """ERROR, OK, or the empty string for any other code."""
    return F.when(code == STATUS_ERROR, "ERROR").when(code == STATUS_OK, "OK").otherwise("")


def timestamp_of_ns(ns: Column) -> Column:
    """The instant in microseconds, as far as Spark's timestamps go; keep the nanoseconds beside it."""
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000).cast("long")))


def hex_id(value: Column) -> Column:
    """Lower-case hex of a binary id; an id of zero bytes only is the empty string."""
    text = F.lower(F.hex(value))
    return F.when(text.rlike("^0*$"), "").otherwise(text)


def attribute_map(attributes: Column) -> Column:
    """array<struct<key, value: string>> as a map; of repeated keys the last counts, null is the empty map."""
    last = F.aggregate(
        attributes,
        F.create_map().cast("map<string,string>"),
        lambda m, a: F.map_concat(F.map_filter(m, lambda k, _: k != a["key"]), F.create_map(a["key"], F.coalesce(a["value"], F.lit("")))),
    )
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _shortest(value: Column) -> Column:
    """A finite double with the fewest digits that read back as it.

    Java before 19 may give one or more too many (9.990019999999999E20 for 9.99002E20), and two at least.
    """
    text = value.cast("string")
    tries = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.call_function("format_string", F.concat(F.lit("%."), p.cast("string"), F.lit("e")), value))
    fewer = F.filter(tries, lambda t: t.cast("double") == value)
    return F.when((F.length(text) > 16) | (F.abs(value) < 1e-300), F.coalesce(F.upper(F.get(fewer, F.lit(0))), text)).otherwise(text)


def number_text(value: Column) -> Column:
    """A double as JSON and ECMAScript write it: plain decimals from 1e-6 to below 1e21, beyond them an exponent."""
    odd = F.when(F.isnan(value), "NaN").when(value > 0, "+Inf").otherwise("-Inf")
    strange = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(strange, F.concat(F.lit("json: unsupported value: "), odd)).when(value.isNotNull(), _let(_shortest(value), lambda text: _ecma(value, text)))


def _ecma(value: Column, text: Column) -> Column:
    """A finite double whose digits are those of text, in Java's form."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa, power = F.regexp_extract(text, "^-?([0-9.]+)", 1), F.coalesce(F.regexp_extract(text, "E([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    every = F.concat(whole, F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise(""))
    parts = F.struct(sign.alias("sign"), every.alias("every"), (F.length(whole) + power).alias("point"))

    def known(d: Column) -> Column:
        lead = F.length(F.regexp_extract(d["every"], "^0*", 0))
        digits = F.regexp_replace(F.regexp_replace(d["every"], "^0+", ""), "0+$", "")
        return F.struct(d["sign"].alias("sign"), digits.alias("digits"), (d["point"] - lead).alias("point"), F.length(digits).alias("n"))

    def written(d: Column) -> Column:
        sign, digits, point, n = (d[k] for k in ("sign", "digits", "point", "n"))
        plain = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n))).otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        tail = F.substr(digits, F.lit(2))
        short = F.concat(F.substring(digits, 1, 1), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), F.when(point > 0, "e+").otherwise("e-"), F.abs(point - 1).cast("string"))
        return F.when(digits == "", F.concat(sign, F.lit("0"))).when((F.abs(value) < 1e-6) | (F.abs(value) >= 1e21), F.concat(sign, short)).otherwise(F.concat(sign, plain))

    return _let(_let(parts, known), written)


def json_string(text: Column) -> Column:
    """A JSON string literal, null for null; <, > and & are escaped too."""
    out = F.to_json(F.struct(text.alias("v")))
    out = F.substr(out, F.lit(6), F.length(out) - 6)
    for sign, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(sign), F.lit(escaped))
    return F.when(text.isNotNull(), out)


def attribute(attributes: Column, key: str) -> Column:
    """The value of a key, or the empty string."""
    return F.coalesce(F.try_element_at(attributes, F.lit(key)), F.lit(""))
