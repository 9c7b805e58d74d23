import itertools
import random

import pytest
from pyspark.sql import functions as F

from spantail.config import ConfigError, PolicyConfig
from spantail.operators import exact, replay, sampling
from spantail.operators import policies as policy_types
from spantail.operators.exact import Sampler, Span
from spantail.operators.policies import compiled

SCHEMA = "trace_id string, span_id string, status_code string, duration_ns long, batch long, n long"


def rows(seed, count=400):
    r = random.Random(seed)
    batches = sorted(r.randint(0, 40) for _ in range(count))
    return [(f"t{r.randint(0, 25)}", r.choice(["0", "1", "2", "3", "4", "5", "6", "7"]), r.choice(["OK"] * 14 + ["error"]), r.randint(0, 10) * 1_000_000, b, n) for n, b in enumerate(batches)]


@pytest.fixture(scope="module")
def policies(spark):
    return compiled([PolicyConfig("status_code", keep="ERROR"), PolicyConfig("latency", threshold_ms=10)])


def match(r):
    return r[2].upper() == "ERROR" or r[3] >= 10_000_000


@pytest.mark.parametrize("seed", range(2))
def test_forwarded(spark, policies, seed):
    data = rows(seed, 60)
    df = spark.createDataFrame(data, SCHEMA)
    kept = {r[0] for r in data if match(r)}
    expected = sorted(r for r in data if r[0] in kept)
    for f in (sampling.forwarded, sampling.forwarded_window):
        assert sorted(map(tuple, f(df, policies).select(*df.columns).collect())) == expected
    assert {r[0] for r in sampling.not_sampled(df, policies).collect()} == {r[0] for r in data} - kept
    one = sampling.drop_rate(df, policies).first()
    assert (one.traces, one.sampled_traces) == (len({r[0] for r in data}), len(kept))


def test_without_policies_all_is_dropped(spark):
    df = spark.createDataFrame(rows(1, 30), SCHEMA)
    assert sampling.forwarded(df, []).count() == 0
    assert sampling.drop_rate(df, []).first().dropped_percent == 100


@pytest.mark.parametrize("cap", [0, 2, 3])
def test_cap_and_deduplication(spark, policies, cap):
    data = rows(3, 150)
    df = spark.createDataFrame(data, SCHEMA)
    held, fate = {}, {}
    for r in data:
        t = held.setdefault(r[0], [])
        if 0 < cap <= len(t):
            fate[r[5]] = "dropped"
        elif r[1] != "0" and r[1] in t:
            fate[r[5]] = "duplicate"
        else:
            t.append(r[1])
            fate[r[5]] = "kept"
    got = {r.n: r.fate for r in sampling.capped(df, cap, ["n"]).collect()}
    assert got == fate
    kept = [r for r in data if fate[r[5]] == "kept"]
    traces = {r[0] for r in kept if match(r)}
    one = sampling.counters(df, policies, cap, ["n"]).first()
    assert one.dropped_max_spans == sum(f == "dropped" for f in fate.values())
    assert one.sampled_spans == sum(r[0] in traces for r in kept)
    assert one.not_sampled_traces == len({r[0] for r in data} - traces)


def simulate(data, wait, max_traces=0):
    out = []
    clock = 0
    s = Sampler(lambda spans: out.extend((x.trace_id, x.payload, clock) for x in spans), wait=wait, max_traces=max_traces)
    for clock, part in itertools.groupby(data, key=lambda r: r[4]):
        s.consume([Span(r[0], "0", match(r), r[5]) for r in part], clock)
    return out, s


def test_replay_without_wait(spark, policies):
    data = rows(5)
    df = spark.createDataFrame(data, SCHEMA)
    out, _ = simulate(data, 0)
    got = replay.episodes(df, policies).where("sampled").select("trace_id", "n").collect()
    assert sorted(map(tuple, got)) == sorted((t, n) for t, n, _ in out)
    totals = replay.episode_totals(df, policies).where("sampled").agg(F.sum("spans")).first()[0]
    assert totals == len(out)


@pytest.mark.parametrize("wait", [1, 3, 10])
def test_replay_with_wait(spark, policies, wait):
    data = rows(7)
    df = spark.createDataFrame(data, SCHEMA)
    out, s = simulate(data, wait)
    got = replay.decision_wait(df, policies, wait)
    assert got.where("outcome = 'sampled'").agg(F.sum("spans")).first()[0] == len(out)
    assert got.where("outcome = 'drained'").count() + got.where("outcome = 'not_sampled'").count() == s.not_sampled + len(s.traces)


def test_exact_replay(spark, policies):
    data = rows(9)
    df = spark.createDataFrame(data, SCHEMA).withColumn("span_id", F.lit("0"))
    out, _ = simulate(data, 4, max_traces=6)
    got = exact.replayed(df, policies, ["n"], wait=4, max_traces=6)
    assert sorted((r.trace_id, r.batch) for r in got.collect()) == sorted((t, b) for t, _, b in out)


def test_fifo_without_matches(spark):
    data = rows(11)
    df = spark.createDataFrame(data, SCHEMA)
    first = {}
    for r in data:
        first.setdefault(r[0], r[5])
    expected = sorted(sorted(first, key=first.get)[-5:])
    assert sorted(r[0] for r in sampling.last_traces(df, 5, ["n"]).collect()) == expected


def test_the_cap_needs_one_exchange(spark):
    df = spark.createDataFrame([("t", "1", "OK", 1, 0)], "trace_id string, span_id string, status_code string, duration_ns long, n int")
    rules = compiled([PolicyConfig("status_code", keep="ERROR")])
    for out in (sampling.capped(df, 2, ["n"]), sampling.sampled(df, rules, 2, ["n"]), sampling.counters(df, rules, 2, ["n"])):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_registered_policy(spark):
    def check(config):
        if not config.options.get("name"):
            raise ConfigError("name is needed")

    policy_types.register("named", lambda c: F.col("name") == c.options["name"], check)
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "trace_id string, name string")
    kept = sampling.kept_traces(df, compiled([PolicyConfig("named", options={"name": "y"})]))
    assert [r.trace_id for r in kept.collect()] == ["b"]
    for config in (PolicyConfig("named"), PolicyConfig("unheard of")):
        with pytest.raises(ConfigError):
            config.validate()
