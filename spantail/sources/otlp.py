"""Nested traces in, flat spans out, and back.

A row holds resource_spans: resources with their scopes, with their spans. Flattening explodes the
three levels in order; nothing is shuffled. Files of JSON, one nested batch a line, are read as a table
or as a stream with the same schema.

Attributes become text: numbers as JSON writes them, bytes in base64, arrays and maps as compact JSON
with sorted keys. Values inside these are read to DEPTH levels; what lies deeper stays as on the wire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spantail.functions.spans import attribute_map, duration_ns, hex_id, json_string, number_text, status_text, timestamp_of_ns

#: Levels of arrays and maps inside each other.
DEPTH = 4


def _value_type(depth: int) -> str:
    inner = f"struct<values:array<{_value_type(depth - 1)}>>" if depth else "string"
    pairs = f"struct<values:array<struct<key:string,value:{_value_type(depth - 1)}>>>" if depth else "string"
    return f"struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,bytesValue:string,arrayValue:{inner},kvlistValue:{pairs}>"


_ATTRS = f"array<struct<key:string,value:{_value_type(DEPTH)}>>"
_SPAN = f"struct<traceId:string,spanId:string,name:string,kind:int,status:struct<code:int>,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRS}>"
_SCOPE, _RESOURCE = "struct<name:string,version:string>", f"struct<attributes:{_ATTRS}>"
#: Nested batches as JSON has them: ids in hex, 64-bit numbers as text.
JSON_SCHEMA = f"resourceSpans array<struct<resource:{_RESOURCE},schemaUrl:string,scopeSpans:array<struct<scope:{_SCOPE},schemaUrl:string,spans:array<{_SPAN}>>>>>"

#: Columns of flat spans.
FLAT = ("trace_id", "span_id", "name", "kind", "status_code", "start_unix_nano", "duration_ns", "timestamp", "attributes", "resource", "resource_url", "scope", "scope_url")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JSON_SCHEMA).json(path)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The stream of batches in a folder; a micro-batch takes at most so many files."""
    return spark.readStream.schema(JSON_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _json_of(value: Column, depth: int) -> Column:
    """A value inside an array or a map as JSON."""
    nested = _nested_json(value, depth)
    return F.coalesce(json_string(value["stringValue"]), value["intValue"], number_text(value["doubleValue"]), value["boolValue"].cast("string"), json_string(value["bytesValue"]), nested, F.lit("null"))


def _nested_json(value: Column, depth: int) -> Column:
    """Its array or map as JSON, null if it has neither."""
    if not depth:
        return F.coalesce(value["arrayValue"], value["kvlistValue"])
    items, pairs = value["arrayValue"]["values"], value["kvlistValue"]["values"]
    listed = F.concat(F.lit("["), F.array_join(F.transform(items, lambda v: _json_of(v, depth - 1)), ","), F.lit("]"))
    texts = attribute_map(F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), _json_of(p["value"], depth - 1).alias("value"))))
    sorted_pairs = F.transform(F.array_sort(F.map_entries(texts)), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]))
    mapped = F.concat(F.lit("{"), F.array_join(sorted_pairs, ","), F.lit("}"))
    return F.when(value["arrayValue"].isNotNull(), F.coalesce(listed, F.lit("[]"))).when(value["kvlistValue"].isNotNull(), mapped)


def text_of(value: Column) -> Column:
    """An attribute's value as text; the empty string if it has none."""
    return F.coalesce(value["stringValue"], value["intValue"], number_text(value["doubleValue"]), value["boolValue"].cast("string"), value["bytesValue"], _nested_json(value, DEPTH), F.lit(""))


def flatten(batches: DataFrame, raw: bool = False) -> DataFrame:
    """One row a span, in order of resources, scopes and spans, with the span as on the wire if `raw`. Null levels have no spans."""
    resources = batches.select(F.explode("resourceSpans").alias("r"))
    scopes = resources.select(F.col("r.resource").alias("resource"), F.col("r.schemaUrl").alias("resource_url"), F.explode("r.scopeSpans").alias("s"))
    spans = scopes.select("resource", "resource_url", F.col("s.scope").alias("scope"), F.col("s.schemaUrl").alias("scope_url"), F.explode("s.spans").alias("x"))
    start, end = F.col("x.startTimeUnixNano").cast("long"), F.col("x.endTimeUnixNano").cast("long")
    attributes = F.transform("x.attributes", lambda a: F.struct(a["key"].alias("key"), text_of(a["value"]).alias("value")))
    zero = lambda c: F.when(F.coalesce(c, F.lit("")).rlike("^0*$"), "").otherwise(F.lower(c))
    return spans.select(
        zero(F.col("x.traceId")).alias("trace_id"),
        zero(F.col("x.spanId")).alias("span_id"),
        F.col("x.name").alias("name"),
        F.col("x.kind").alias("kind"),
        status_text(F.coalesce("x.status.code", F.lit(0))).alias("status_code"),
        start.alias("start_unix_nano"),
        duration_ns(start, end).alias("duration_ns"),
        timestamp_of_ns(start).alias("timestamp"),
        attribute_map(attributes).alias("attributes"),
        "resource",
        "resource_url",
        "scope",
        "scope_url",
        *([F.col("x").alias("raw")] if raw else []),
    )


def _wire(spans: DataFrame) -> Column:
    """Flat spans as on the wire: as they came, if that was kept, else made of the flat columns, attributes as text."""
    if "raw" in spans.columns:
        return F.col("raw")
    given = lambda c, kind: F.col(c) if c in spans.columns else F.lit(None).cast(kind)
    value = lambda v: F.struct(v.alias("stringValue"))
    attributes = F.transform(F.map_entries(given("attributes", "map<string,string>")), lambda a: F.struct(a["key"].alias("key"), value(a["value"]).alias("value")))
    status = F.struct(F.when(F.col("status_code") == "ERROR", 2).when(F.col("status_code") == "OK", 1).otherwise(0).alias("code"))
    start = F.col("start_unix_nano")
    made = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), given("name", "string").alias("name"), given("kind", "int").alias("kind"), status.alias("status"), start.cast("string").alias("startTimeUnixNano"), (start + F.col("duration_ns")).cast("string").alias("endTimeUnixNano"), attributes.alias("attributes"))
    # JSON fills in the kinds of values that text hasn't got
    return F.from_json(F.to_json(made), _SPAN)


def nest(spans: DataFrame) -> DataFrame:
    """Flat spans as nested batches that flatten() reads: a row a trace, so that none outgrows one; spans in order of start and id.

    Resources and scopes come from the columns of that name, where there are any. One exchange.
    """
    given = lambda c, kind: (F.col(c) if c in spans.columns else F.lit(None).cast(kind)).alias(c)
    rows = spans.select("trace_id", given("resource", _RESOURCE), given("resource_url", "string"), given("scope", _SCOPE), given("scope_url", "string"), F.struct("start_unix_nano", "span_id", _wire(spans).alias("span")).alias("s"))
    key = lambda x: F.struct(x["start_unix_nano"], x["span_id"])
    order = lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)
    of_scope = rows.repartition("trace_id").groupBy("trace_id", "resource", "resource_url", "scope", "scope_url").agg(F.transform(F.array_sort(F.collect_list("s"), order), lambda x: x["span"]).alias("spans"))
    of_resource = of_scope.groupBy("trace_id", "resource", "resource_url").agg(F.collect_list(F.struct("scope", F.col("scope_url").alias("schemaUrl"), "spans")).alias("scopeSpans"))
    return of_resource.groupBy("trace_id").agg(F.collect_list(F.struct("resource", F.col("resource_url").alias("schemaUrl"), "scopeSpans")).alias("resourceSpans"))


def binary_ids(spans: DataFrame) -> DataFrame:
    """Spans with binary trace_id and span_id, with both in hex."""
    return spans.withColumn("trace_id", hex_id(F.col("trace_id"))).withColumn("span_id", hex_id(F.col("span_id")))
