import datetime as dt

import pytest
from pyspark.sql import functions as F

from spantail.config import ConfigError, StoreConfig
from spantail.functions.naming import attr_column
from spantail.sources import otlp
from spantail.sources.store import BASE_SCHEMA, SpanStore

UTC = dt.timezone.utc
NS = 1_924_992_245_000_000_042
ROWS = [
    (dt.datetime.fromtimestamp(NS // 10**9, UTC), NS, "t-blue", "s-1", "read shelf", "OK", 7_000, {"shop": "lamps", "floor.no": "third"}),
    (dt.datetime.fromtimestamp(NS // 10**9 + 5, UTC), NS + 5 * 10**9, "t-red", "s-2", "weigh crate", "ERROR", 90_000_000, {"floor-no": "ground", "crate.size": "XL"}),
]


@pytest.fixture
def held(spark, tmp_path):
    return SpanStore(spark, StoreConfig(location=f"file://{tmp_path}", database="d"))


def test_grows_by_keys(spark, held):
    df = spark.createDataFrame(ROWS, BASE_SCHEMA)
    assert held.write(df.limit(0)) == 0 and held.stats.flush_attempts == 0
    assert held.write(df.where("trace_id = 't-blue'")) == 1
    assert held.keys() == ["floor.no", "shop"]
    assert held.write(df.where("trace_id = 't-red'")) == 1
    assert held.attr_columns() == sorted(map(attr_column, ("floor.no", "floor-no", "shop", "crate.size")))
    rows = held.read()
    assert rows.count() == 2 and rows.where(f"timestamp_ns = {NS}").count() == 1
    one = held.where_trace("t-blue").select(attr_column("floor.no"), held.attr("floor-no")).first()
    assert tuple(one) == ("third", "")
    assert [r.trace_id for r in held.where_attr("crate.size", "XL").collect()] == ["t-red"]
    assert held.where_attr("absent", "x").count() == 0
    assert held.between(F.lit(ROWS[0][0]), F.lit(ROWS[1][0])).count() == 1
    held.create_view("held_spans")
    assert spark.sql(f"SELECT count(*) FROM held_spans WHERE {attr_column('floor-no')} = ''").first()[0] == 1
    assert "CREATE TABLE IF NOT EXISTS `d`.`spans`" in held.describe()
    held.drop()
    assert held.read().count() == 0


def test_attached_to_a_catalog(spark, held):
    df = spark.createDataFrame(ROWS, BASE_SCHEMA)
    for rows in (df.where("trace_id = 't-blue'"), df):
        held.write(rows)
        name = held.attach()
    assert name == "`d`.`spans`"
    got = spark.sql(f"SELECT {attr_column('shop')} AS shop, attributes['crate.size'] AS size, count(*) AS n FROM d.spans GROUP BY 1, 2 ORDER BY n")
    assert sorted((r.shop, r["size"], r.n) for r in got.collect()) == [("", "XL", 1), ("lamps", None, 2)]
    spark.sql("DROP DATABASE d CASCADE")
    assert held.read().count() == 3


def test_settings_from_a_url():
    config = StoreConfig.of("s3a://u:secret@b/x?database=one&batch_size=7&flush_interval_s=0.5", database="two", table="")
    assert (config.location, config.database, config.table, config.batch_size, config.flush_interval_s) == ("s3a://u:secret@b/x", "two", "spans", 7, 0.5)
    assert "secret" not in repr(config)
    for url in ("?database=x", "f?nothing=1", "f?batch_size=a", "f?batch_size=-1"):
        with pytest.raises(ConfigError):
            StoreConfig.of(url)


def test_replayed_batch_is_stored_once(spark, held):
    df = spark.createDataFrame(ROWS, BASE_SCHEMA)
    sink = held.sink("one")
    sink(df, 7)
    sink(df, 7)
    sink(df, 8)
    held.sink("another")(df, 7)
    assert held.read().count() == 6
    with pytest.raises(ValueError):
        held.sink()(df, 0)


def test_stores_append_beside_each_other(spark, held):
    """Two objects of one store in one application, unnumbered batches."""
    df = spark.createDataFrame(ROWS, BASE_SCHEMA)
    other = SpanStore(spark, held.config)
    for store in (held, other, held):
        store.write(df)
    assert held.read().count() == 6


def test_a_key_beyond_the_columns_is_found(spark, tmp_path):
    df = spark.createDataFrame([(*ROWS[0][:7], {"a": "1", "b": "2"})], BASE_SCHEMA)
    for limit in (1, 5):
        held = SpanStore(spark, StoreConfig(location=f"file://{tmp_path}", max_attr_columns=limit))
        held.write(df)
    assert held.keys() == ["a", "b"]
    assert [held.where_attr(k, v).count() for k, v in (("a", "1"), ("b", "2"), ("b", ""), ("b", "1"), ("c", ""))] == [2, 2, 0, 0, 2]


def test_indexes(spark, held):
    """Few values are in a dictionary; where they are too many for one, there is a Bloom filter."""
    columns = ("trace_id", *map(attr_column, ("floor.no", "floor-no", "shop", "crate.size")))
    held.write(spark.createDataFrame(ROWS, BASE_SCHEMA))
    assert {r["column"]: r.filters + r.dictionaries for r in held.indexes().collect()} == dict.fromkeys(columns, 1)
    many = spark.range(120_000).select(F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("timestamp_ns"), F.sha2(F.col("id").cast("string"), 256).alias("trace_id"), F.lit("s").alias("span_id"), F.lit("n").alias("name"), F.lit("").alias("status_code"), F.lit(1).cast("long").alias("duration_ns"), F.create_map(F.lit("shop"), F.sha2(F.col("id").cast("string"), 224)).alias("attributes"))
    held.write(many.coalesce(1))
    found = {r["column"]: r.filters for r in held.indexes(files=1).collect()}
    assert found["trace_id"] > 0 and found[attr_column("shop")] > 0
    assert held.where_attr("shop", "absent").count() == 0


def test_null_attributes_and_column_limit(spark, tmp_path):
    held = SpanStore(spark, StoreConfig(location=f"file://{tmp_path}", max_attr_columns=1))
    df = spark.createDataFrame([(*ROWS[0][:7], None), ROWS[1]], BASE_SCHEMA)
    held.write(df)
    assert len(held.attr_columns()) == 1
    assert held.read().where("size(attributes) = 0").count() == 1
    assert held.where_attr("crate.size", "XL").count() == 1


def test_json_batches(spark, tmp_path):
    (tmp_path / "one.json").write_text(
        '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"checkout"}}]},"scopeSpans":[{"scope":{"name":"lib"},"spans":['
        '{"traceId":"0AFF","spanId":"0000","name":"op-0","kind":2,"status":{"code":2},"startTimeUnixNano":"0","endTimeUnixNano":"50000000","attributes":[{"key":"n","value":{"intValue":"5"}},{"key":"n","value":{"boolValue":true}},{"key":"d","value":{"doubleValue":2.0}}]},'
        '{"traceId":"0AFF","spanId":"01","name":"op-1","startTimeUnixNano":"9","endTimeUnixNano":"3"}]}]}]}\n'
    )
    flat = otlp.flatten(otlp.read(spark, str(tmp_path)))
    got = [(r.trace_id, r.span_id, r.name, r.status_code, r.duration_ns, r.attributes, r.resource.attributes[0].value.stringValue) for r in flat.collect()]
    assert got == [("0aff", "", "op-0", "ERROR", 50_000_000, {"n": "true", "d": "2"}, "checkout"), ("0aff", "01", "op-1", "", 0, {}, "checkout")]
    nested = otlp.nest(flat)
    assert nested.count() == 1
    again = sorted((r.trace_id, r.span_id, r.name, r.status_code, r.duration_ns, r.attributes, r.resource.attributes[0].value.stringValue) for r in otlp.flatten(nested).collect())
    assert again == sorted(got)
    raw = otlp.flatten(otlp.read(spark, str(tmp_path)), raw=True)
    kept = otlp.flatten(otlp.nest(raw), raw=True).where("span_id = ''").first().raw
    assert kept.traceId == "0AFF" and [a.value.intValue for a in kept.attributes][:1] == ["5"] and kept.kind == 2


def test_numbers_as_text(spark):
    from spantail.functions.spans import json_string, number_text

    given = {0.0: "0", 1.0: "1", -2.5: "-2.5", 0.0001: "0.0001", 12345678.5: "12345678.5", 1e20: "100000000000000000000", 1e21: "1e+21", 1.25e-7: "1.25e-7", 1e-6: "0.000001", -3.5e300: "-3.5e+300", 100.25: "100.25", 0.05: "0.05", float("inf"): "json: unsupported value: +Inf"}
    for value, text in given.items():
        assert spark.range(1).select(number_text(F.lit(value))).first()[0] == text
    assert spark.range(1).select(number_text(F.lit(-0.0))).first()[0] == "-0"
    assert spark.range(1).select(number_text(F.lit(float("nan"))), number_text(F.lit(None).cast("double"))).first()[:] == ("json: unsupported value: NaN", None)
    assert spark.range(1).select(json_string(F.lit('a"<b>&\n\\'))).first()[0] == '"a\\"\\u003cb\\u003e\\u0026\\n\\\\"'
