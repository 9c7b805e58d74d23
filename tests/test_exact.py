"""Scenarios of a capped sampler, one machine at a time."""

from spantail.operators.exact import Sampler, Span


class Sink:
    def __init__(self, failing=False):
        self.failing, self.got = failing, []

    def __call__(self, spans):
        if self.failing:
            raise RuntimeError("sink")
        self.got.append(list(spans))


def ok(trace, span="0"):
    return Span(trace, span, False)


def error(trace, span="0"):
    return Span(trace, span, True)


def test_keeps_an_error():
    sink = Sink()
    s = Sampler(sink)
    assert s.consume([error("1", "a"), error("1", "b")], 0) is None
    assert len(sink.got) == 1 and s.sampled_spans == 2


def test_cap_evicts_the_oldest():
    s = Sampler(Sink(), max_traces=1)
    s.consume([ok("1"), ok("2")], 0)
    assert (s.dropped, s.not_sampled, s.pending) == (0, 1, ["2"])


def test_cap_counts():
    sink = Sink(failing=True)
    s = Sampler(sink, max_traces=1)
    s.consume([error("1")], 0)
    s.consume([ok("2")], 0)
    assert s.dropped_max_traces == 1
    t = Sampler(Sink(), max_spans=2)
    t.consume([ok("1", str(i)) for i in range(1, 5)], 0)
    assert t.dropped_max_spans == 2 and t.dropped == 2


def test_duplicate_at_the_cap_is_dropped():
    s = Sampler(Sink(), max_spans=1)
    s.consume([ok("1", "a"), ok("1", "a")], 0)
    assert s.dropped_max_spans == 1


def test_buffered_counts():
    s = Sampler(Sink())
    s.consume([ok("A", "1"), ok("A", "2")], 0)
    assert s.buffered(["A", "B", "A"]) == {"A": 2}


def test_wait_and_shutdown():
    s = Sampler(Sink(), wait=1)
    s.consume([ok("1")], 0)
    s.expire(2)
    assert (s.not_sampled, s.traces) == (1, {})
    t = Sampler(Sink(), wait=3600)
    t.consume([ok("1")], 0)
    assert t.shutdown() is None and t.not_sampled == 1


def test_late_error_keeps_the_whole_trace():
    sink = Sink()
    s = Sampler(sink, wait=1)
    s.consume([ok("a", "1")], 0)
    s.consume([ok("b", "1")], 0.5)
    s.consume([error("a", "2")], 5)
    assert [len(x) for x in sink.got] == [2]


def test_due_trace_frees_its_place():
    sink = Sink()
    s = Sampler(sink, wait=1, max_traces=1)
    s.consume([ok("1")], 0)
    s.consume([error("2")], 2)
    assert (s.dropped, len(sink.got)) == (0, 1)


def test_held_traces():
    sink = Sink(failing=True)
    s = Sampler(sink, wait=1)
    assert s.consume([error("1"), error("2")], 0) is not None
    s.expire(2)
    assert s.not_sampled == 0 and s.buffered(["1", "2"]) == {"1": 1, "2": 1}
    sink.failing = False
    s.consume([error("1", "9")], 3)
    assert len(sink.got) == 1
    assert s.shutdown() is None and len(sink.got) == 2


def test_failed_shutdown_drops_nothing():
    sink = Sink(failing=True)
    s = Sampler(sink)
    s.consume([error("1"), ok("2")], 0)
    assert s.shutdown() is not None and s.not_sampled == 0
    sink.failing = False
    assert s.shutdown() is None and s.not_sampled == 1


def test_retry_holds_no_duplicate():
    sink = Sink(failing=True)
    s = Sampler(sink, max_spans=1)
    s.consume([error("1", "a")], 0)
    sink.failing = False
    s.consume([error("1", "a")], 1)
    assert [len(x) for x in sink.got] == [1]


def test_evicts_oldest_not_newest_and_past_held():
    sink = Sink()
    s = Sampler(sink, max_traces=2)
    s.consume([ok("1")], 0)
    s.consume([ok("2")], 1)
    s.consume([error("3")], 2)
    assert s.not_sampled == 1 and s.pending == ["2"] and len(sink.got) == 1
    sink = Sink(failing=True)
    t = Sampler(sink, max_traces=3)
    t.consume([error("1"), error("2"), ok("3")], 0)
    sink.failing = False
    t.consume([error("4")], 1)
    assert t.not_sampled == 1 and sorted(t.traces) == ["1", "2"] and len(sink.got) == 1


def test_batch_of_many_new_traces_evicts_before_deciding():
    sink = Sink()
    s = Sampler(sink, max_traces=1)
    s.consume([error("1"), ok("2")], 0)
    assert sink.got == [] and s.not_sampled == 1
