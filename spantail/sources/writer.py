"""The batching writer, for sinks that get rows in small calls instead of micro-batches.

Micro-batches need none of it: they are serial, and a failed one is replayed. Where rows come in small
calls, the writer gathers them and sends the whole buffer once it holds a batch, or when its interval is
over; attribute keys are told before the rows that bring them; a failed batch stays in front of what
comes next. `flushes` says for a table of rows what such writers would have sent.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantail.config import BATCH_SIZE, StoreConfig
from spantail.sources.store import BASE_SCHEMA, SpanStore

Row = Mapping[str, Any]

#: Rows of a leftover and a write together, in batches; in rows where no batch size is set.
BUFFER_BATCHES, BUFFER_ROWS = 4, 10_000


class WriterClosed(RuntimeError):
    """Rows came after close()."""


class BufferFull(RuntimeError):
    """A leftover fills the buffer, and sending it again failed."""


def new_keys(rows: Iterable[Row], known: Iterable[str]) -> list[str]:
    """Attribute keys of rows that aren't known, once each, in the order met."""
    known = set(known)
    return [k for k in dict.fromkeys(k for r in rows for k in (r.get("attributes") or {})) if k not in known]


@dataclass
class WriterStats:
    """Flushes count if there was something to flush; rebuffered counts rows, rejected counts writes."""

    flush_attempts: int = 0
    flush_failures: int = 0
    rebuffered_rows: int = 0
    rejected_writes: int = 0


class BatchWriter:
    """Sends batches of rows to `put`, after new attribute keys went to `announce`.

    batch_size of zero or less: every write is sent. interval: seconds after which whatever waits is
    sent by a thread of the writer's own; zero or less: none. Safe for several threads; also a context.
    """

    def __init__(self, put: Callable[[Sequence[Row]], object], announce: Callable[[Sequence[str]], object] = lambda keys: None, batch_size: int = BATCH_SIZE, interval: float = 0):
        self.put, self.announce, self.batch_size = put, announce, batch_size
        self.limit = BUFFER_BATCHES * batch_size if batch_size > 0 else BUFFER_ROWS
        self.buffer: list[Row] = []
        self.leftover = 0
        self.known: set[str] = set()
        self.stats = WriterStats()
        self._one, self._over = threading.RLock(), threading.Event()
        if interval > 0:
            threading.Thread(target=self._tick, args=(interval,), daemon=True).start()

    @classmethod
    def into(cls, store: SpanStore) -> BatchWriter:
        """A writer into a store, which registers keys by itself, with the batch size and interval of its settings."""
        config: StoreConfig = store.config
        store.ensure_base_schema()
        return cls(lambda rows: store.write(store.spark.createDataFrame(list(rows), BASE_SCHEMA)), batch_size=config.batch_size, interval=config.flush_interval_s)

    def _tick(self, interval: float) -> None:
        while not self._over.wait(interval):
            self.flush()

    def write(self, rows: Sequence[Row]) -> None:
        """Takes rows; a failed flush keeps them and is counted, not raised."""
        with self._one:
            if not rows:
                return
            if self._over.is_set():
                raise WriterClosed
            if self._crowded(rows):
                self.flush()
                if self._crowded(rows):
                    self.stats.rejected_writes += 1
                    raise BufferFull
            self.buffer += rows
            if len(self.buffer) >= self.batch_size:
                self.flush()

    def _crowded(self, rows: Sequence[Row]) -> bool:
        return self.leftover > 0 and len(self.buffer) + len(rows) > self.limit

    def flush(self) -> Exception | None:
        """Sends the whole buffer; returns what went wrong."""
        with self._one:
            if not self.buffer:
                return None
            batch, self.buffer, self.leftover = self.buffer, [], 0
            self.stats.flush_attempts += 1
            try:
                if fresh := new_keys(batch, self.known):
                    self.announce(fresh)
                    self.known.update(fresh)
                self.put(batch)
            except Exception as e:
                self.stats.flush_failures += 1
                self.stats.rebuffered_rows += len(batch)
                self.buffer, self.leftover = batch + self.buffer, len(batch)
                return e
            return None

    def close(self) -> None:
        """Sends what is left, once; raises what went wrong."""
        with self._one:
            if self._over.is_set():
                return
            self._over.set()
            if error := self.flush():
                raise error

    def __enter__(self) -> BatchWriter:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


def flushes(rows: DataFrame, by: Sequence[str], order: Sequence[str], batch_size: int) -> DataFrame:
    """rows with `flush`: the number, from 0, of the batch in which a writer for each `by` sends the row, rows coming one by one."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("flush", F.floor(number / max(1, batch_size)))
