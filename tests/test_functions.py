import pytest
from pyspark.sql import functions as F

from spantail.config import ConfigError, PolicyConfig, SamplerConfig, StoreConfig
from spantail.functions import spans as fn
from spantail.functions.naming import attr_column, qualified, quote_ident, quote_string
from spantail.operators.policies import compiled


@pytest.mark.parametrize("policy", [PolicyConfig(), PolicyConfig("status_code"), PolicyConfig("latency"), PolicyConfig("latency", threshold_ms=-1), PolicyConfig("probabilistic"), PolicyConfig("rate_limiting")])
def test_invalid_policies(policy):
    with pytest.raises(ConfigError):
        SamplerConfig((policy,)).validate()


def test_valid_settings():
    SamplerConfig((PolicyConfig("status_code", keep="ERROR"), PolicyConfig("latency", threshold_ms=200))).validate()
    SamplerConfig().validate()
    assert SamplerConfig().decision_wait_s == 5 and StoreConfig().table == "spans"
    with pytest.raises(ConfigError):
        StoreConfig().validate()
    with pytest.raises(ConfigError):
        StoreConfig(location="/x", batch_size=-1).validate()
    assert "hunter2" not in repr(StoreConfig(location="jdbc://u:hunter2@h"))


def test_names_and_quotes():
    assert attr_column("http.method") == "attr_http_method_7dd5fd96" and attr_column("") == "attr__cbf29ce4"
    assert attr_column("a.b") != attr_column("a-b")
    assert (quote_string("plain"), quote_string("o'reilly"), quote_string("a\\b")) == ("'plain'", "'o\\'reilly'", "'a\\\\b'")
    assert quote_ident("a`b") == "`a``b`" and qualified("", "t") == "`t`" and qualified("d", "t") == "`d`.`t`"


def test_scalars(spark):
    row = spark.range(1).select(
        fn.duration_ns(F.lit(5), F.lit(3)).alias("neg"),
        fn.status_text(F.lit(2)).alias("err"),
        fn.status_text(F.lit(7)).alias("other"),
        fn.hex_id(F.unhex(F.lit("00FF"))).alias("hex"),
        fn.hex_id(F.unhex(F.lit("0000"))).alias("zero"),
        fn.attribute(F.create_map(F.lit("a"), F.lit("x")), "b").alias("missing"),
        F.unix_micros(fn.timestamp_of_ns(F.lit(1_000_000_000_123_456_789).cast("long"))).alias("us"),
    ).first()
    assert tuple(row) == (0, "ERROR", "", "00ff", "", "", 1_000_000_000_123_456)


def test_attributes_last_wins(spark):
    df = spark.sql("SELECT array(named_struct('key','a','value','1'), named_struct('key','a','value','2'), named_struct('key','b','value',cast(null as string))) AS x UNION ALL SELECT null")
    got = sorted((sorted(r.m.items()) for r in df.select(fn.attribute_map(F.col("x")).alias("m")).collect()), key=len)
    assert got == [[], [("a", "2"), ("b", "")]]


def test_empty_policy_list_compiles():
    assert compiled(()) == []
