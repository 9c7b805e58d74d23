"""The span store: an append-only Parquet table whose schema grows with the attribute keys it meets.

Base columns are fixed. Each attribute key gets a sparse column with a Bloom filter, so an equality
on it skips row groups; a key that a row lacks reads as the empty string. Files are sorted by time,
then trace, so that both prune by minimum and maximum. Keys are registered before the rows that use
them are written. Keys beyond the limit of columns stay in the map, and the store remembers which, so
that a lookup reads the map where the column isn't whole. Every batch is a folder of its own: one that
carries a number replaces an earlier try of that number by the same stream and no other, one without is
appended under a name that is never used again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spantail.config import StoreConfig
from spantail.functions.naming import attr_column, qualified, quote_ident, quote_string
from spantail.shared import hadoop

BASE_SCHEMA = "timestamp timestamp, timestamp_ns bigint, trace_id string, span_id string, name string, status_code string, duration_ns bigint, attributes map<string,string>"
BASE = ("timestamp", "timestamp_ns", "trace_id", "span_id", "name", "status_code", "duration_ns", "attributes")


def distinct_keys(rows: DataFrame) -> DataFrame:
    """key: the attribute keys of rows; partial aggregation leaves one row a key and task."""
    return rows.select(F.explode(F.map_keys("attributes")).alias("key")).distinct()


def new_keys(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The keys of rows that aren't in known.key."""
    return distinct_keys(rows).join(known.select("key"), "key", "left_anti")


def with_attribute_columns(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """rows with a sparse column for each key; a missing key is the empty string."""
    return rows.withColumns({attr_column(k): F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit("")) for k in keys})


@dataclass
class Stats:
    """Counts since the store was opened. Rebuffered rows are those of failed batches, which come again."""

    flush_attempts: int = 0
    flush_failures: int = 0
    rebuffered_rows: int = 0
    rows_written: int = 0
    batches_written: int = 0


@dataclass
class SpanStore:
    """A store in a folder that all executors reach."""

    spark: SparkSession
    config: StoreConfig
    stats: Stats = field(default_factory=Stats)

    def __post_init__(self) -> None:
        self.config.validate()
        self.root = self.config.location.rstrip("/") + (f"/{self.config.database}" if self.config.database else "") + f"/{self.config.table}"

    # Files of the registry are small JSON rows, read and written by Spark, so any file system will do.
    def _fs(self, path: str):
        return hadoop(self.spark, path)

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def ensure_base_schema(self) -> None:
        """Creates the table if it isn't there; as often as one likes."""
        if not self._exists(f"{self.root}/data"):
            self.spark.createDataFrame([], BASE_SCHEMA).write.mode("ignore").parquet(f"{self.root}/data/batch=base")

    def _registry(self, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema("key string").json(path) if self._exists(path) else self.spark.createDataFrame([], "key string")

    def keys(self) -> list[str]:
        """Registered attribute keys, in order."""
        return [r.key for r in self._registry("keys").distinct().orderBy("key").collect()]

    def add_attribute_columns(self, keys: Iterable[str]) -> list[str]:
        """Registers keys that aren't yet; returns those added. Names of equal columns can't differ in their key's hash."""
        added = sorted(set(keys) - set(self.keys()))
        if added:
            self.spark.createDataFrame([(k,) for k in added], "key string").coalesce(1).write.mode("append").json(f"{self.root}/keys")
        return added

    def _columns_for(self, rows: DataFrame) -> list[str]:
        """The keys of rows that get a column, after those that are new were registered as far as the limit goes. Only these come to the driver."""
        known, limit = self.keys(), self.config.max_attr_columns
        fresh = new_keys(rows, self._registry("keys"))
        if limit:
            fresh = fresh.orderBy("key").limit(max(0, limit - len(known)))
        self.add_attribute_columns(r.key for r in fresh.collect())
        if limit:
            beyond = new_keys(rows, self._registry("keys"))
            if not beyond.isEmpty():
                beyond.write.mode("append").json(f"{self.root}/beyond")
        return sorted(r.key for r in distinct_keys(rows).join(F.broadcast(self._registry("keys").distinct()), "key", "left_semi").collect())

    def write(self, rows: DataFrame, batch_id: int | str | None = None, max_records_per_file: int | None = None, stream: str = "") -> int:
        """Appends rows (columns of BASE) and returns their number; an empty batch writes nothing.

        A batch_id names the batch within its stream, so that a second try replaces the first.
        """
        rows = rows.select(*[F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes") if c == "attributes" else c for c in BASE])
        rows, n = rows.persist(), 0
        try:
            n = rows.count()
            if not n:
                return 0
            self.stats.flush_attempts += 1
            self.ensure_base_schema()
            keys = self._columns_for(rows)
            wide = with_attribute_columns(rows, keys)
            out = wide.repartitionByRange("timestamp", "trace_id").sortWithinPartitions("timestamp", "timestamp_ns", "trace_id").write
            out = out.option("compression", "zstd").option("maxRecordsPerFile", max_records_per_file or 0)
            for c in ("trace_id", *map(attr_column, keys)):
                out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
            name = f"s{stream}-{batch_id}" if batch_id is not None else f"u{uuid.uuid4().hex}"
            out.mode("overwrite").parquet(f"{self.root}/data/batch={name}")
            self.stats.rows_written += n
            self.stats.batches_written += 1
            return n
        except Exception:
            self.stats.flush_failures += 1
            self.stats.rebuffered_rows += n
            raise
        finally:
            rows.unpersist()

    def sink(self, stream: str | None = None) -> Callable[[DataFrame, int], int]:
        """For foreachBatch: a replayed micro-batch replaces its first try, and no batch of another stream.

        A stream is told by the id of its query, which its checkpoint holds, or by the name given here,
        which then must change with the checkpoint.
        """

        def put(df: DataFrame, batch_id: int) -> int:
            name = stream or df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            if not name:
                raise ValueError("the stream's query isn't known; give sink() a name")
            return self.write(df, batch_id, stream=name)

        return put

    def stream(self, rows: DataFrame, checkpoint: str, name: str | None = None) -> StreamingQuery:
        """Starts a query that appends a stream of rows every flush_interval_s, or as fast as it can if that is 0."""
        out = rows.writeStream.foreachBatch(self.sink(name)).option("checkpointLocation", checkpoint)
        seconds = self.config.flush_interval_s
        return (out.trigger(processingTime=f"{round(seconds * 1000)} milliseconds") if seconds else out).start()

    def read(self) -> DataFrame:
        """All rows; sparse columns of every registered key, the empty string where a file lacks one."""
        schema = BASE_SCHEMA + "".join(f", {quote_ident(attr_column(k))} string" for k in self.keys())
        if not self._exists(f"{self.root}/data"):
            return self.spark.createDataFrame([], schema)
        # batches are folders, which Spark lists in parallel; their number isn't a column of the table
        return self.spark.read.schema(schema).parquet(f"{self.root}/data").drop("batch")

    def attr_columns(self) -> list[str]:
        """Names of the sparse columns; a prefix test with its underscore, as `attributes` isn't one."""
        return sorted(c for c in self.read().columns if c.startswith("attr_"))

    def where_attr(self, key: str, value: str) -> DataFrame:
        """Rows whose attribute has the value, answered from the sparse column, whose filters skip files and row groups.

        Where the key was met beyond the limit of columns, rows without the column are looked up in the map.
        """
        rows, column = self.read(), attr_column(key)
        mapped = F.try_element_at("attributes", F.lit(key))
        if column not in rows.columns:
            return rows.where(F.coalesce(mapped, F.lit("")) == value)
        if not self._registry("beyond").where(F.col("key") == key).isEmpty():
            return rows.where(F.coalesce(column, mapped, F.lit("")) == value)
        if value == "":
            return rows.where(F.coalesce(column, F.lit("")) == "")
        return rows.where(F.col(column) == value)

    def indexes(self, files: int = 100) -> DataFrame:
        """column, row_groups, filters and dictionaries from the footers of the newest `files` files of the store.

        filters: row groups with a Bloom filter; dictionaries: those whose values are all in a dictionary,
        which Parquet reads instead, and for which it writes no filter. Columns with neither are left out.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, at = self._fs(f"{self.root}/data")
        found = []
        if fs.exists(at):
            each = fs.listFiles(at, True)
            while each.hasNext():
                f = each.next()
                if f.getPath().getName().endswith(".parquet"):
                    found.append((f.getModificationTime(), f.getPath()))
        counts: dict[str, list[int]] = {}
        wanted = {"trace_id", *map(attr_column, self.keys())}
        for _, path in sorted(found, key=lambda x: (x[0], x[1].toString()))[-files:]:
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
            try:
                for block in reader.getFooter().getBlocks():
                    for chunk in block.getColumns():
                        if (name := chunk.getPath().toDotString()) in wanted:
                            n, stats = counts.setdefault(name, [0, 0, 0]), chunk.getEncodingStats()
                            filtered = chunk.getBloomFilterOffset() >= 0
                            n[0] += 1
                            n[1] += filtered
                            n[2] += not filtered and stats is not None and stats.hasDictionaryPages() and not stats.hasNonDictionaryEncodedPages()
            finally:
                reader.close()
        return self.spark.createDataFrame([(c, *n) for c, n in sorted(counts.items()) if n[1] or n[2]], "column string, row_groups int, filters int, dictionaries int")

    def where_trace(self, trace_id: str) -> DataFrame:
        return self.read().where(F.col("trace_id") == trace_id)

    def between(self, begin: Column | str, end: Column | str) -> DataFrame:
        """Rows from begin to end, end exclusive; timestamps prune row groups."""
        at = lambda t: F.lit(t).cast("timestamp") if isinstance(t, str) else t
        return self.read().where((F.col("timestamp") >= at(begin)) & (F.col("timestamp") < at(end)))

    def attr(self, key: str) -> Column:
        """The sparse column of a key, the empty string where a row has none."""
        return F.coalesce(attr_column(key), F.lit("")).alias(attr_column(key))

    def create_view(self, name: str | None = None) -> str:
        """A temporary view for Spark SQL, whose sparse columns are never null."""
        name = name or self.config.table
        rows = self.read()
        rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c.startswith("attr_") else F.col(c) for c in rows.columns]).createOrReplaceTempView(name)
        return name

    def describe(self) -> str:
        """The table as SQL that makes it, for users who keep it in a catalog."""
        columns = BASE_SCHEMA + "".join(f", {quote_ident(attr_column(k))} string" for k in self.keys())
        return f"CREATE TABLE IF NOT EXISTS {qualified(self.config.database, self.config.table)} ({columns}) USING parquet OPTIONS (recursiveFileLookup 'true') LOCATION {quote_string(self.root + '/data')}"

    def attach(self) -> str:
        """Makes the store a table of the session's catalog, in a database that is made if it isn't there, and returns its name.

        Only the catalog's entry is replaced, so it can be called again once there are new columns.
        """
        self.ensure_base_schema()
        name = qualified(self.config.database, self.config.table)
        if self.config.database:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote_ident(self.config.database)}")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.spark.sql(self.describe())
        return name

    def drop(self) -> None:
        fs, at = self._fs(self.root)
        fs.delete(at, True)

    def close(self) -> None:
        """Nothing is held open."""

    def to_json(self) -> str:
        return json.dumps(self.stats.__dict__)
