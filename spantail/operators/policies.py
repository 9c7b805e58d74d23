"""Sampling policies as columns over a span; a trace matches if any of its spans does."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spantail.config import CHECKS, PolicyConfig

Policy = tuple[str, Column]


def status_code(keep: str) -> Column:
    return F.lower("status_code") == keep.lower()


def latency(threshold_ns: int) -> Column:
    """A single span's duration, threshold included; not the time from end to end of a trace."""
    return F.col("duration_ns") >= threshold_ns


#: Policy types by name.
POLICIES: dict[str, Callable[[PolicyConfig], Column]] = {
    "status_code": lambda c: status_code(c.keep),
    "latency": lambda c: latency(c.threshold_ms * 1_000_000),
}


def register(name: str, build: Callable[[PolicyConfig], Column], check: Callable[[PolicyConfig], None] | None = None) -> None:
    """Offers one more policy type: build makes the condition over a span, check raises ConfigError for settings it can't use."""
    POLICIES[name] = build
    CHECKS[name] = check or (lambda config: None)


def compiled(configs: Iterable[PolicyConfig]) -> list[Policy]:
    """(name, condition) in order."""
    out = []
    for config in configs:
        config.validate()
        out.append((config.type, POLICIES[config.type](config)))
    return out


def matches(policies: Iterable[Policy]) -> Column:
    """Whether a span matches any policy; without policies none does."""
    any_of = F.lit(False)
    for _, condition in policies:
        any_of = any_of | F.coalesce(condition, F.lit(False))
    return any_of


def first_match(policies: Iterable[Policy]) -> Column:
    """As an aggregate over a trace: the first policy in order that any span matches, or null."""
    chosen = F.when(F.lit(False), F.lit(""))
    for name, condition in policies:
        chosen = chosen.when(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(name))
    return chosen
