"""A capped replay in chunks against the machine itself, in one run over all."""

import random

import pytest
from pyspark.sql import functions as F

from spantail.config import PolicyConfig
from spantail.operators import exact
from spantail.operators.exact import Sampler, Span
from spantail.operators.policies import compiled

SCHEMA = "trace_id string, span_id string, status_code string, batch long, n long"


@pytest.fixture
def policies(spark):
    return compiled([PolicyConfig("status_code", keep="ERROR")])


def rows(seed, count, traces, batches):
    r = random.Random(seed)
    out = sorted((r.randrange(batches), i) for i in range(count))
    return [(f"t{r.randrange(traces)}", r.choice(["0", str(r.randrange(9)), str(i)]), "ERROR" if r.random() < 0.05 else "OK", b, i) for b, i in out]


def machine(data, wait, max_traces, max_spans):
    out, now = [], 0
    s = Sampler(lambda spans: out.extend((x.trace_id, x.span_id, now) for x in spans), wait, max_traces, max_spans)
    for now in sorted({r[3] for r in data}):
        s.consume([Span(t, i, c == "ERROR") for t, i, c, b, _ in data if b == now], now)
    return sorted(out)


@pytest.mark.parametrize("wait, max_traces, max_spans", [(0, 5, 0), (3, 5, 2), (6, 20, 3), (4, 0, 0), (0, 0, 3)])
@pytest.mark.parametrize("batches, rounds", [(40, 4), (40, 1), (2, 99)])
def test_chunks(spark, policies, monkeypatch, wait, max_traces, max_spans, batches, rounds):
    """Cuts inside batches, guesses that are wrong for several rounds, and a rest that runs as one."""
    monkeypatch.setattr(exact, "ROUNDS", rounds)
    data = rows(wait + max_traces, 600, 40, batches)
    expected = machine(data, wait, max_traces, max_spans)
    df = spark.createDataFrame(data, SCHEMA)
    got = exact.replayed(df, policies, ["n"], wait=wait, max_traces=max_traces, max_spans=max_spans, parts=6)
    assert expected and sorted(map(tuple, got.collect())) == expected


def test_no_table_is_refused(spark, policies):
    """Five million spans and some: every thousandth matches, and the last 1000 of a batch's 2500 traces still wait at its end."""
    n = F.col("id")
    df = spark.range(5_000_100).select(F.concat(F.lit("t"), F.call_function("div", n, F.lit(4))).alias("trace_id"), n.cast("string").alias("span_id"), F.when(n % 1000 == 999, "ERROR").otherwise("OK").alias("status_code"), F.call_function("div", n, F.lit(10_000)).alias("batch"), n.alias("n"))
    got = exact.replayed(df, policies, ["n"], max_traces=1000)
    assert got.agg(F.count("*"), F.sum(F.col("span_id").cast("long") % 1000)).first() == (4 * 2000, 2000 * (996 + 997 + 998 + 999))


def test_odd_spans(spark, policies):
    """No rows; spans without an id, which are never duplicates, and without a trace or a batch."""
    none = spark.createDataFrame([], SCHEMA)
    assert exact.replayed(none, policies, ["n"], wait=1, max_traces=2).collect() == []
    df = spark.createDataFrame([("a", None, "OK", 1, 1), ("a", None, "ERROR", 1, 2), (None, "1", "ERROR", 1, 3), ("b", "1", "ERROR", None, 4)], SCHEMA)
    got = exact.replayed(df, policies, ["n"], wait=1, max_traces=2, parts=3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", None, 1), ("a", None, 1), (None, "1", 1)], key=str)
