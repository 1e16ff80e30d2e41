"""Expressions on texts, bytes and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_bytes(text: Column) -> Column:
    """UTF-8; null gives no bytes."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def to_text(data: Column) -> Column:
    """Bytes read as UTF-8, malformed ones replaced; null stays null."""
    return data.cast("string")


def stream_number(name: Column) -> Column:
    """A 64-bit number for a stream name. Streams are keyed by name; the number is for compact storage only."""
    return F.xxhash64(name)


def digest(text: Column) -> Column:
    """MD5 of the UTF-8 bytes as hexadecimal text."""
    return F.md5(text)


def bucket(name: Column, buckets: int) -> Column:
    """A bucket from 0 for partitioned layouts."""
    return F.pmod(F.hash(name), F.lit(buckets))
