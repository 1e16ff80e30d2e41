"""Strict JSON reading as column expressions.

A text counts as a JSON object only if the whole text is one valid object. Spark's path functions stop reading as soon
as they found the key and so accept truncated texts; here the text is parsed whole into a VARIANT. Wrapping it in a list
also rejects what follows the object. Of a repeated key the last value counts; Spark has a session setting for that, which
is off as it comes and is switched on here.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"
WHITE = " \t\r\n"


def json_object(text: Column) -> Column:
    """VARIANT holding a list of the one object that text is, or null if text is anything else (null and empty included)."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(REPEATED_KEYS) != "true":
        spark.conf.set(REPEATED_KEYS, "true")
    looks = F.substring(F.ltrim(text, F.lit(WHITE)), 1, 1) == "{"
    return F.when(looks, F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))


def _only_one(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$[1]", "variant").isNull()


def is_object(parsed: Column) -> Column:
    """Whether json_object() found exactly one object."""
    return parsed.isNotNull() & _only_one(parsed)


def top_level(parsed: Column, key: str, kind: str = "string") -> Column:
    """The value of a top-level key of json_object()'s result; null if absent, JSON null or of another kind."""
    return F.when(_only_one(parsed), F.try_variant_get(parsed, f"$[0].{key}", kind))


def may_hold_key(text: Column, key: str) -> Column:
    """A cheap test that never fails for a text with this key: the key is there as it is or written with escapes."""
    return text.contains(key) | text.contains("\\")
