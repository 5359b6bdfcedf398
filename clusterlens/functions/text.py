"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How times appear in reasons, and how an absent time is written there.
TIME_TEXT_PATTERN = "yyyy-MM-dd HH:mm:ss Z z"
RFC3339_PATTERN = "yyyy-MM-dd'T'HH:mm:ssXXX"
ZERO_TIME_TEXT = "0001-01-01 00:00:00 +0000 UTC"


def text(value: Column) -> Column:
    """NULL -> '' (a missing text field reads as empty)."""
    return F.coalesce(value, F.lit(""))


def nullable(value: Column) -> Column:
    """'' -> NULL."""
    return F.nullif(value, F.lit(""))


def snake_case(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "(?<=[a-z0-9])(?=[A-Z])", "_"))


def strip_stop(value: Column) -> Column:
    """Trim white space (any Unicode), then drop one trailing full stop."""
    return F.regexp_replace(F.regexp_replace(text(value), r"(?U)^\s+|\s+$", ""), r"\.$", "")


def reason_and_message(reason: Column, message: Column) -> Column:
    """``reason: message``, or just the reason if the message is blank."""
    detail = strip_stop(message)
    return F.concat(text(reason), F.when(detail != "", F.concat(F.lit(": "), detail)).otherwise(""))


def time_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, TIME_TEXT_PATTERN), F.lit(ZERO_TIME_TEXT))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, RFC3339_PATTERN)


def utf8_tail(value: Column, size: int) -> Column:
    """Last ``size`` bytes without splitting a character, then without its first, cut line.

    Values of at most ``size`` bytes are returned unchanged.
    """
    cut = F.substring(F.encode(value, "UTF-8"), -size, size)
    # At most three continuation bytes (10xxxxxx, first hex digit 8-B) can lead the cut.
    torn = F.length(F.regexp_extract(F.hex(F.substring(cut, 1, 3)), "^((?:[89AB][0-9A-F])*)", 1)) / 2
    tail = F.decode(F.substring(cut, torn.cast("int") + F.lit(1), F.lit(size)), "UTF-8")
    # locate() is 0 without a newline, and substring from position 1 is the whole text.
    lines = F.substring(tail, F.locate("\n", tail) + F.lit(1), F.length(tail))
    return F.when(F.octet_length(value) <= size, value).otherwise(lines)


def host_of(instance: Column) -> Column:
    """Host part of ``host:port`` / ``[v6]:port``; text without a colon is the host itself.

    Anything else with a colon is not an address and gives NULL.
    """
    pattern = r"^(?:\[([^\[\]]*)\]|([^:\[\]]*)):[^:\[\]]*$"
    split = F.concat(F.regexp_extract(instance, pattern, 1), F.regexp_extract(instance, pattern, 2))
    return F.when(~F.contains(instance, F.lit(":")), instance).when(instance.rlike(pattern), split)


def label_replace(source: Column, pattern: str, group: int = 1, otherwise: Column | None = None) -> Column:
    """Capture ``group`` of a fully anchored match of ``pattern``; no match keeps ``otherwise``."""
    anchored = f"^(?:{pattern})$"
    # The anchoring group does not capture, so group numbers stay those of ``pattern``.
    return F.when(source.rlike(anchored), F.regexp_extract(source, anchored, group)).otherwise(
        otherwise if otherwise is not None else F.lit(None)
    )


def url_path(kind: Column, uuid: Column) -> Column:
    """Relative link to one object of a kind."""
    return F.concat(F.lit("/"), F.translate(kind, "_", ""), F.lit("?id="), uuid)
