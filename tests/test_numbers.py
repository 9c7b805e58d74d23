"""Doubles as text against Python's repr, which has the fewest digits, too."""

import random
import struct

from spantail.functions import spans as fn
from spantail.plans.catalog import QUERIES


def ecma(x):
    sign, (digits, _, power) = "-" * (x < 0), repr(abs(x)).partition("e")
    whole, _, rest = digits.partition(".")
    every = whole + rest
    point = len(whole) + int(power or 0) - (len(every) - len(every.lstrip("0")))
    every = every.strip("0")
    if not every:
        return sign + "0"
    if 1e-6 <= abs(x) < 1e21:
        return sign + ("0." + "0" * -point + every if point <= 0 else every.ljust(point, "0") if point >= len(every) else every[:point] + "." + every[point:])
    return sign + every[0] + ("." + every[1:] if every[1:] else "") + ("e+" if point > 0 else "e-") + str(abs(point - 1))


def test_doubles(spark):
    """Large ones that Java before 19 writes with a digit too many, the least, and others of any bits."""
    r = random.Random(4)
    values = [n * 1e15 for n in range(295_001, 1_001_000, 997)] + [999_002e15, 2e23, 5e-324, 1e-322, 1e21, 1e-6, 1e-7, -0.5, 0.0, 100.0, 560.21, 2.0**-44, 1.7976931348623157e308]
    values += [round(r.uniform(-1000, 1000), r.randint(0, 12)) for _ in range(500)]
    assert [ecma(x) for x in (999_002e15, 1.5e21, 5e-324, 1e-6, -0.5)] == ["999002000000000000000", "1.5e+21", "5e-324", "0.000001", "-0.5"]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    bad = [(x, t) for x, t in df.select("x", fn.number_text(df.x)).collect() if t != ecma(x)]
    assert bad == []
    bits = [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64) & ~(0x7FF << 52) | r.randint(1, 2045) << 52))[0] for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in bits], "x double")
    assert all(float(t) == x and len(t) <= len(ecma(x)) + 1 for x, t in df.select("x", fn.number_text(df.x)).collect())


def test_attribute_text_of_large_ids(spark, tmp_path):
    ids = [1, 295_151, 599_999, 999_002, 999_999, 1_000_000, 5_999_999, 10**12]
    spark.createDataFrame([(i, "view", 0.5) for i in ids], "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {int(r.span_id): r.large for r in QUERIES["otlp_attribute_text"](spark, str(tmp_path)).collect()}
    assert got == {i: f"{i}{'0' * 15}" for i in ids}
