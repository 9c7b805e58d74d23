import datetime as dt
import time

import pytest

from spantail.config import StoreConfig
from spantail.sources.store import SpanStore
from spantail.sources.writer import BatchWriter, BufferFull, WriterClosed, new_keys


class Sink:
    """Takes batches, but for the first few."""

    def __init__(self, failures=0):
        self.failures, self.batches, self.told = failures, [], []

    def put(self, rows):
        if self.failures:
            self.failures -= 1
            raise OSError("store")
        self.batches.append(len(rows))

    def writer(self, size, interval=0):
        return BatchWriter(self.put, lambda keys: self.told.append(sorted(keys)), size, interval)


def rows(n, *keys):
    return [{"attributes": dict.fromkeys(keys, "x")} for _ in range(n)]


def test_flushes_the_whole_buffer():
    sink = Sink()
    w = sink.writer(3)
    w.write([])
    w.write(rows(2))
    assert sink.batches == []
    w.write(rows(2))
    assert sink.batches == [4]
    sink.writer(0).write(rows(1))
    assert sink.batches == [4, 1]


def test_new_keys_come_before_their_rows():
    sink = Sink()
    w = sink.writer(1)
    w.write(rows(1, "a", "b"))
    w.write(rows(1, "a", "c"))
    assert sink.told == [["a", "b"], ["c"]]
    assert new_keys([{"attributes": None}, {}], ()) == []


def test_close_drains_and_refuses():
    sink = Sink()
    with sink.writer(10) as w:
        w.write(rows(2))
    w.close()
    assert sink.batches == [2]
    with pytest.raises(WriterClosed):
        w.write(rows(1))


def test_interval_sends_what_waits():
    sink = Sink()
    w = sink.writer(10, 0.05)
    w.write(rows(3))
    for _ in range(100):
        if sink.batches:
            break
        time.sleep(0.05)
    assert sink.batches == [3] and w.stats.flush_attempts == 1
    w.close()


def test_failure_keeps_rows():
    sink = Sink(failures=1)
    w = sink.writer(2)
    w.write(rows(2))
    assert (w.stats.flush_failures, w.stats.rebuffered_rows, len(w.buffer)) == (1, 2, 2)
    w.write(rows(1))
    assert sink.batches == [3]


def test_full_buffer():
    sink = Sink(failures=9)
    w = sink.writer(2)
    w.write(rows(8))
    with pytest.raises(BufferFull):
        w.write(rows(3))
    assert w.stats.rejected_writes == 1 and len(w.buffer) == 8
    sink.failures = 0
    w.write(rows(1))
    assert sink.batches == [8]


def test_oversized_write_into_an_empty_buffer():
    sink = Sink()
    sink.writer(2).write(rows(20))
    assert sink.batches == [20]


def test_failed_drain_is_raised():
    w = Sink(failures=1).writer(10)
    w.write(rows(3))
    with pytest.raises(OSError):
        w.close()


def test_into_a_store(spark, tmp_path):
    store = SpanStore(spark, StoreConfig(location=f"file://{tmp_path}", batch_size=2, flush_interval_s=0))
    span = lambda n: {"timestamp": dt.datetime(2031, 5, 6, 7, 8, n), "timestamp_ns": n, "trace_id": f"t{n}", "span_id": "1", "name": "op", "status_code": "", "duration_ns": 1, "attributes": {"n": str(n)}}
    with BatchWriter.into(store) as w:
        for n in range(5):
            w.write([span(n)])
    assert w.stats.flush_attempts == 3 and store.stats.batches_written == 3
    assert [r.trace_id for r in store.where_attr("n", "4").collect()] == ["t4"] and store.read().count() == 5
