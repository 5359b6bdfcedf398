"""The ordered health state."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# States in ascending severity, and the severity each one is reported with.
OK, PENDING, UNKNOWN, WARNING, CRITICAL = range(5)
STATE_NAMES = ("ok", "pending", "unknown", "warning", "critical")
SEVERITIES = ("ok", "info", "err", "warning", "crit")


def _pick(names: tuple[str, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), rank.cast("int") + F.lit(1))


def state_name(rank: Column) -> Column:
    return _pick(STATE_NAMES, rank)


def severity(rank: Column) -> Column:
    return _pick(SEVERITIES, rank)


def state_rank(name: Column) -> Column:
    """Inverse of :func:`state_name`; use it to sort, the names do not sort by severity."""
    return F.nullif(
        F.array_position(F.array(*[F.lit(n) for n in STATE_NAMES]), name).cast("int"), F.lit(0)
    ) - F.lit(1)


def verdict(rank: int | Column, reason: Column) -> Column:
    """A classified state: ``struct<rank int, reason string>``."""
    rank = F.lit(rank) if isinstance(rank, int) else rank
    return F.struct(rank.cast("int").alias("rank"), reason.alias("reason"))


def tagged_reason(rank: Column, reason: Column) -> Column:
    """``[STATE] reason``."""
    return F.concat(F.lit("["), F.upper(state_name(rank)), F.lit("] "), reason)
