"""The stream catalog: views of it, and its rebuilding from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.names import matches_pattern
from tidelog.operators.changefeed import catalog_changes, state_of
from tidelog.operators.retention import current_versions, one_per_name
from tidelog.schema import NO_VERSION


def streams_metadata(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """Every stream of the catalog with its current version (-1 without events), without the state; one row per name."""
    catalog = one_per_name(catalog)
    versions = current_versions(log).withColumnRenamed("stream", "name")
    return catalog.drop("state").join(versions, "name", "left").withColumn("version", F.coalesce("version", F.lit(NO_VERSION)))


def stream_metadata(catalog: DataFrame, log: DataFrame, name: str) -> DataFrame:
    """One stream's row of streams_metadata(); empty if it's unknown. Both sides are filtered before the join."""
    return streams_metadata(catalog.filter(F.col("name") == name), log.filter(F.col("stream") == name))


def stream_version(log: DataFrame, name: str) -> DataFrame:
    """One row: the current version of a stream, -1 if it has no event."""
    return log.filter(F.col("stream") == name).agg(F.coalesce(F.max("version"), F.lit(NO_VERSION)).alias("version"))


def matching_streams(catalog: DataFrame, pattern: str | None) -> DataFrame:
    """name of the catalog's streams that match: `abc*` by prefix, else equality."""
    return catalog.filter(matches_pattern(F.col("name"), pattern)).select("name")


def replay(log: DataFrame) -> DataFrame:
    """name, created, max_age, max_count, state, permissions, metadata of the streams that the `_streams` events leave: first creation wins, deletes end it."""
    state = state_of(catalog_changes(log))
    return state.select(F.col("key").alias("name"), "created", "max_age", "max_count", F.coalesce("state", F.lit(0)).alias("state"), "permissions", "metadata")


def has_permission(catalog: DataFrame, user: str, permission: int) -> DataFrame:
    """name of the streams that give user this permission."""
    return catalog.filter(F.try_element_at("permissions", F.lit(user)) == permission).select("name")


def metadata_value(catalog: DataFrame, key: str) -> DataFrame:
    """name and one metadata value (null without the key)."""
    return catalog.select("name", F.try_element_at("metadata", F.lit(key)).alias("value"))
