"""What several corpus operators share: the shared folder, written tables, Arrow text slices."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantail.shared import hadoop, new_path, written
from spantail.ship import ship

#: Text bytes that one step in a Python worker holds at a time.
SLICE_BYTES = 4 << 20
#: Rows of a few numbers that may be broadcast: some 50 MB.
BROADCAST_ROWS = 1 << 20
#: Rows that one task may well hold, if they all have one key. Beyond them a key is hot if it has more than this part of all rows.
FEW_ROWS, HOT = 1 << 20, 1024


def drop(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def counted(side: DataFrame) -> DataFrame:
    """A written table of narrow rows as the smaller side of a join: broadcast if it is counted to be small, else shuffled."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def joined_hot(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows.join(side, key, how), where side is a written table of distinct keys with `n`, how many rows have each; n goes.

    A key of more than 1/HOT of the rows meets its row by broadcast: there are fewer than HOT of them,
    whatever the input. The others are joined by shuffles. Few rows need none of this.
    """
    total = side.agg(F.sum("n")).first()[0] or 0
    if total <= FEW_ROWS:
        return rows.join(side.drop("n"), key, how)
    is_hot = F.col("n") * HOT > total
    hot, cold = F.broadcast(side.where(is_hot).drop("n")), side.where(~is_hot).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key, how))


def others(columns: list[str], *made: str) -> list[str]:
    """Columns that don't have one of these names; Spark doesn't tell capitals apart."""
    return [c for c in columns if c.lower() not in made]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _freed() -> None:
    """Gives memory that earlier tasks of this worker used back to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def in_arrow(df: DataFrame, run, schema, encodes: bool = False) -> DataFrame:
    """df.mapInArrow with this package on the executors. Only functions that encode texts keep the pieces that their worker remembers."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes and "spantail.llm.tokens" in sys.modules:
            sys.modules["spantail.llm.tokens"].Encoder.forget()
        _freed()
        yield from run(batches)
        _freed()

    return df.mapInArrow(task, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of an Arrow text array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about `most` text bytes; a longer text is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
