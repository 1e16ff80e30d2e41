"""Reads of the log: whole, by position, by stream, several streams merged, by event, and of the index columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.names import is_blank, matches_pattern
from tidelog.operators.catalog import matching_streams
from tidelog.operators.links import resolve
from tidelog.operators.retention import max_age, retained
from tidelog.schema import INDEX_FLUSHED
from tidelog.session import small_side


def from_all(log: DataFrame, backward: bool = False) -> DataFrame:
    """Every row, system rows and links as they are, by position. The order is a range-partitioned sort."""
    return log.orderBy(F.desc("position") if backward else F.asc("position"))


def at_position(log: DataFrame, position: int) -> DataFrame:
    """The row at a position; an error if there is none."""
    row = log.filter(F.col("position") == position)
    if row.isEmpty():
        raise ValueError(f"no event at position {position}")
    return row


def from_stream(log: DataFrame, catalog: DataFrame, stream: str, now_ms: int, version: int = 0, on_missing: str = "error") -> DataFrame:
    """A stream from a version on, by version: max-count, then max-age, both by the stream itself, then links resolved.

    Stream and lowest version reach the Parquet scan; the current version is one aggregate over the stream's own rows.
    """
    if version < 0:
        raise ValueError("version must not be negative")
    own = log.filter(F.col("stream") == stream)
    kept = retained(own, catalog.filter(F.col("name") == stream), now_ms, few=True).filter(F.col("version") >= version)
    return resolve(kept, log, on_missing).orderBy(F.coalesce("link_version", "version"))


def zip_streams(log: DataFrame, catalog: DataFrame, streams: list[str], now_ms: int, on_missing: str = "error") -> DataFrame:
    """Several streams merged by position. Blank names are dropped, repeated ones count once; max-age only, no max-count."""
    names = sorted({s for s in streams if s and s.strip()})
    rows = log.filter(F.col("stream").isin(names)) if names else log.limit(0)
    return resolve(max_age(rows, catalog.filter(F.col("name").isin(names)), now_ms, few=True), log, on_missing).orderBy("position")


def zip_prefix(log: DataFrame, catalog: DataFrame, pattern: str | None, now_ms: int, on_missing: str = "error") -> DataFrame:
    """Like zip_streams() for the catalog's streams that match; the prefix also filters the scan itself."""
    names = matching_streams(catalog, pattern).withColumnRenamed("name", "stream").distinct()
    rows = log.filter(matches_pattern(F.col("stream"), pattern)).join(small_side(names, "names"), "stream", "left_semi").select(*log.columns)
    return resolve(max_age(rows, catalog, now_ms), log, on_missing).orderBy("position")


def from_streams(log: DataFrame, catalog: DataFrame, streams: list[str], now_ms: int, on_missing: str = "error") -> DataFrame:
    """Several streams side by side in one DataFrame keyed by `source_stream`, with both limits and links resolved."""
    names = sorted({s for s in streams if s and s.strip()})
    kept = retained(log.filter(F.col("stream").isin(names)), catalog.filter(F.col("name").isin(names)), now_ms, few=True)
    return resolve(kept, log, on_missing).withColumn("source_stream", F.coalesce("link_stream", "stream"))


def streams_mapped(log: DataFrame, catalog: DataFrame, streams: list[str], now_ms: int) -> dict[str, DataFrame]:
    """Name to the stream's own lazy read."""
    return {s: from_stream(log, catalog, s, now_ms) for s in sorted({s for s in streams if s and s.strip()})}


def get_event(log: DataFrame, stream: str, version: int, on_missing: str = "error") -> DataFrame:
    """One event by stream and version, without retention, a link resolved; errors for a negative version and if absent."""
    if version < 0:
        raise ValueError("version must not be negative")
    row = log.filter((F.col("stream") == stream) & (F.col("version") == version))
    if row.isEmpty():
        raise KeyError(f"{stream}@{version}")
    return resolve(row, log, on_missing)


def keys(log: DataFrame) -> DataFrame:
    """stream, version, position of every event: the index columns alone are read."""
    return log.select("stream", "version", "position")


def index_range(log: DataFrame, stream: str, start: int = 0, end: int = 2**31 - 1, backward: bool = False) -> DataFrame:
    """Index rows of a stream with start <= version < end."""
    if start < 0:
        raise ValueError("start must not be negative")
    rows = keys(log).filter((F.col("stream") == stream) & (F.col("version") >= start) & (F.col("version") < end))
    return rows.orderBy(F.desc("version") if backward else F.asc("version"))


def index_get(log: DataFrame, stream: str, version: int) -> DataFrame:
    return keys(log).filter((F.col("stream") == stream) & (F.col("version") == version))


def index_tail(log: DataFrame) -> DataFrame:
    """Index rows after the last index-flush event (all rows if there is none)."""
    last = log.filter(F.col("type") == INDEX_FLUSHED).agg(F.max("position").alias("p")).first()["p"]
    return keys(log if last is None else log.filter(F.col("position") > last))


def fetch(index: DataFrame, log: DataFrame) -> DataFrame:
    """The log rows that index rows point at, by position."""
    return log.join(index.select("position"), "position", "left_semi").select(*log.columns)


def log_size(log: DataFrame) -> DataFrame:
    """One row: n_events, n_keys (distinct stream and version) and the greatest position (-1 if empty)."""
    k = F.when(F.col("stream").isNotNull() & F.col("version").isNotNull(), F.struct("stream", "version"))
    return log.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(k).alias("n_keys"), F.coalesce(F.max("position"), F.lit(-1)).alias("head"))


def named(log: DataFrame) -> DataFrame:
    """Rows with a stream and a type that aren't blank."""
    return log.filter(~is_blank(F.col("stream")) & ~is_blank(F.col("type")))
