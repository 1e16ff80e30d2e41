"""Appending: validation, versions, expected versions, streams created on the way, index flushes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.names import is_blank, is_system_name
from tidelog.operators.chunking import number_rows
from tidelog.operators.retention import current_versions
from tidelog.schema import INDEX_FLUSHED, INDEX_STREAM, NO_VERSION, STREAM_CREATED, STREAMS_STREAM
from tidelog.session import join_by_key

#: Entries of an index flush, and the fewest that may be set.
FLUSH_ENTRIES = 1_000_000
LEAST_FLUSH_ENTRIES = 1_000


def invalid_rows(batch: DataFrame, system: bool = False) -> DataFrame:
    """The rows that can't be appended, with the reason: blank stream or type, or (unless system) a reserved stream name."""
    reason = F.when(is_blank(F.col("stream")), "blank stream").when(is_blank(F.col("type")), "blank type")
    if not system:
        reason = reason.when(is_system_name(F.col("stream")), "reserved stream name")
    return batch.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def validated(batch: DataFrame, system: bool = False) -> DataFrame:
    """The batch, with an error at the first row that can't be appended: one pass, no extra job."""
    reason = F.when(is_blank(F.col("stream")), F.lit("blank stream")).when(is_blank(F.col("type")), F.lit("blank type"))
    if not system:
        reason = reason.when(is_system_name(F.col("stream")), F.lit("reserved stream name"))
    return batch.withColumn("stream", F.when(reason.isNotNull(), F.raise_error(reason).cast("string")).otherwise(F.col("stream")))


def append_versions(log: DataFrame, batch: DataFrame, ordinal: str = "ordinal", prior: DataFrame | None = None, head: int | None = None) -> DataFrame:
    """The batch with version (continuing each stream densely) and position (continuing the log), in order of ordinal.

    Versions and positions are numbered by offset chunking, so a batch that goes to one stream is still spread. prior
    (stream, version) and head (the greatest position) are what the log holds, if that is known; else it is scanned.
    """
    if head is None:
        head = log.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("p")).first()["p"]
    numbered = number_rows(batch.withColumn("__one", F.lit("all")), "__one", [ordinal]).withColumn("position", F.col("row_no") + F.lit(head)).drop("row_no", "__one")
    numbered = number_rows(numbered, "stream", ["position"])
    known = (current_versions(log) if prior is None else prior).select("stream", F.col("version").alias("__current"))
    versions = join_by_key(numbered, known, ["stream"], "left")
    return versions.withColumn("version", (F.coalesce("__current", F.lit(NO_VERSION)) + F.col("row_no")).cast("int")).drop("__current", "row_no")


def version_conflicts(log: DataFrame, expected: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """stream, expected, current of the expectations (stream, expected) that don't hold; negative ones always do."""
    current = (current_versions(log) if prior is None else prior).select("stream", F.col("version").alias("current"))
    checked = expected.filter(F.col("expected") >= 0).join(current, "stream", "left").withColumn("current", F.coalesce("current", F.lit(NO_VERSION)))
    return checked.filter(F.col("expected") != F.col("current")).select("stream", "expected", "current")


def implicit_creates(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """stream: those of a batch that the catalog doesn't hold; each gets a creation event before its first event."""
    return batch.filter(F.col("stream").isNotNull()).select("stream").distinct().join(catalog.select(F.col("name").alias("stream")), "stream", "left_anti")


def _map(values: dict | None, kind: str) -> Column:
    pairs = [F.lit(x) for pair in sorted((values or {}).items()) for x in pair]
    return F.create_map(*pairs).cast(kind) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).cast(kind)


def creation_events(streams: DataFrame, now_ms: int, max_count: int = -1, max_age: int = -1, permissions: dict[str, int] | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """The `_streams` events that create streams (column stream)."""
    limits = [F.lit(max_age).alias("maxAge"), F.lit(max_count).alias("maxCount"), F.lit(0).alias("state")]
    maps = [_map(permissions, "map<string,int>").alias("permissions"), _map(metadata, "map<string,string>").alias("metadata")]
    body = F.to_json(F.struct(F.col("stream").alias("name"), F.xxhash64("stream").alias("hash"), F.lit(now_ms).alias("created"), *limits, *maps))
    return streams.select(F.lit(STREAMS_STREAM).alias("stream"), F.lit(STREAM_CREATED).alias("type"), body.alias("data"), F.lit(None).cast("string").alias("metadata"))


def flush_batches(log: DataFrame, entries: int = FLUSH_ENTRIES) -> DataFrame:
    """flush_no, n_entries, log_position of every full index flush: the log in position order cut after each `entries` rows."""
    if entries < LEAST_FLUSH_ENTRIES:
        raise ValueError(f"a flush has at least {LEAST_FLUSH_ENTRIES} entries")
    numbered = number_rows(log.select("position", F.lit("all").alias("one")), "one", ["position"])
    batches = numbered.groupBy(F.floor((F.col("row_no") - 1) / entries).alias("flush_no")).agg(F.count(F.lit(1)).alias("n_entries"), F.max("position").alias("log_position"))
    return batches.filter(F.col("n_entries") == entries)


def flush_events(flushes: DataFrame) -> DataFrame:
    """The `_index` events that report flushes (flush_batches()); the flush is the write of the batch, so it takes 0 ms."""
    body = F.to_json(F.struct(F.col("log_position").alias("logPosition"), F.lit(0).alias("timeTaken"), F.col("n_entries").alias("entries")))
    return flushes.select(F.lit(INDEX_STREAM).alias("stream"), F.lit(INDEX_FLUSHED).alias("type"), body.alias("data"), F.lit(None).cast("string").alias("metadata"), F.col("flush_no").alias("ordinal"))
