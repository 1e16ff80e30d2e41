"""Expressions on stream names, event ids and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import LINK_TYPE, SYSTEM_PREFIX


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return text.isNull() | (F.trim(text, F.lit(" \t\r\n\f\u000b")) == "")


def is_system_name(name: Column) -> Column:
    return name.startswith(SYSTEM_PREFIX)


def is_link(kind: Column) -> Column:
    return kind == LINK_TYPE


def event_id(stream: Column, version: Column) -> Column:
    return F.concat_ws("@", stream, version.cast("string"))


def reference_version(text: Column) -> Column:
    """The version of `name@version`, read after the last `@`; null if it is not a whole number that fits."""
    tail = F.substring_index(text, "@", -1)
    return F.when(text.contains("@") & tail.rlike(r"^\d+$"), tail.try_cast("int"))


def reference_stream(text: Column) -> Column:
    """The name of `name@version`: everything before the last `@`, or null without one. The name may hold `@` itself."""
    tail = F.substring_index(text, "@", -1)
    return F.when(text.contains("@"), F.substring(text, F.lit(1), F.length(text) - F.length(tail) - 1))


def matches_pattern(name: Column, pattern: str | None) -> Column:
    """A trailing `*` means a prefix, anything else equality; null matches nothing. `_` and `%` have no special meaning."""
    if pattern is None:
        return F.lit(False)
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern
