"""Settings of the sampler and of the span store, with the checks a user meets before a job starts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import parse_qsl

#: Defaults of the sampler and of the store.
DECISION_WAIT_S, MAX_TRACES, MAX_SPANS_PER_TRACE = 5.0, 50_000, 10_000
BATCH_SIZE, FLUSH_INTERVAL_S, TABLE = 10_000, 5.0, "spans"
#: Sparse columns of a store, unless it is told otherwise: keys that come once a request mustn't widen it without end.
MAX_ATTR_COLUMNS = 1000


class ConfigError(ValueError):
    """Settings that no job may start with."""


@dataclass(frozen=True)
class PolicyConfig:
    """One policy: status_code with `keep`, latency with `threshold_ms`, or one that was registered, with its `options`."""

    type: str = ""
    keep: str = ""
    threshold_ms: int = 0
    options: Mapping[str, Any] = field(default_factory=dict)

    def validate(self) -> None:
        if not self.type:
            raise ConfigError("a policy needs a type")
        if self.type not in CHECKS:
            raise ConfigError(f"unknown policy type {self.type!r}")
        CHECKS[self.type](self)


def _has_keep(config: PolicyConfig) -> None:
    if not config.keep:
        raise ConfigError("status_code: keep is needed")


def _has_threshold(config: PolicyConfig) -> None:
    if config.threshold_ms <= 0:
        raise ConfigError("latency: threshold_ms must be positive")


#: What each policy type asks of its settings; operators.policies.register adds to it.
CHECKS: dict[str, Callable[[PolicyConfig], None]] = {"status_code": _has_keep, "latency": _has_threshold}


@dataclass(frozen=True)
class SamplerConfig:
    """Waits and caps that are zero or negative are off. No policies: every trace is dropped."""

    policies: tuple[PolicyConfig, ...] = ()
    decision_wait_s: float = DECISION_WAIT_S
    max_traces: int = MAX_TRACES
    max_spans_per_trace: int = MAX_SPANS_PER_TRACE

    def validate(self) -> None:
        for policy in self.policies:
            policy.validate()


@dataclass(frozen=True)
class StoreConfig:
    """Where spans are stored. location may hold a password and isn't shown.

    batch_size: rows that a writer gathers; flush_interval_s: seconds after which it sends fewer, and
    between the micro-batches of a stream; max_attr_columns: sparse columns, without a limit if 0.
    """

    location: str = field(default="", repr=False)
    database: str = ""
    table: str = TABLE
    batch_size: int = BATCH_SIZE
    flush_interval_s: float = FLUSH_INTERVAL_S
    max_attr_columns: int = MAX_ATTR_COLUMNS

    @classmethod
    def of(cls, url: str, **given: Any) -> StoreConfig:
        """Settings from a URL, location?database=...&table=...&batch_size=...; what is given beside it wins."""
        location, _, query = url.partition("?")
        kinds = {"database": str, "table": str, "batch_size": int, "flush_interval_s": float, "max_attr_columns": int}
        told = dict(parse_qsl(query))
        if unknown := told.keys() - kinds.keys():
            raise ConfigError(f"unknown settings {sorted(unknown)}")
        try:
            config = cls(**{"location": location} | {k: kinds[k](v) for k, v in told.items()} | {k: v for k, v in given.items() if v})
        except ValueError as e:
            raise ConfigError(str(e)) from None
        config.validate()
        return config

    def validate(self) -> None:
        if not self.location:
            raise ConfigError("a location is needed")
        if self.batch_size < 0 or self.flush_interval_s < 0 or self.max_attr_columns < 0:
            raise ConfigError("batch_size, flush_interval_s and max_attr_columns must not be negative")
