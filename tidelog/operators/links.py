"""Links: rows that point at another event, their creation and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.names import event_id, is_link, reference_stream, reference_version
from tidelog.schema import LINK_TYPE
from tidelog.session import written


def link_to(events: DataFrame, stream: str) -> DataFrame:
    """Links to events in a stream: stream, type, data, metadata (none), and ordinal if events have it. A link to a link points at what that one points at."""
    data = F.when(is_link(F.col("type")), F.col("data")).otherwise(event_id(F.col("stream"), F.col("version")))
    return events.select(F.lit(stream).alias("stream"), F.lit(LINK_TYPE).alias("type"), data.alias("data"), F.lit(None).cast("string").alias("metadata"), *_order(events))


def emit(events: DataFrame, stream: str) -> DataFrame:
    """Copies of events for another stream: they get their version and time when they are appended."""
    return events.select(F.lit(stream).alias("stream"), "type", "data", "metadata", *_order(events))


def _order(events: DataFrame) -> list[str]:
    """The column that tells the order of events, if they have it; it is kept."""
    return [c for c in ("ordinal",) if c in events.columns]


def resolve(rows: DataFrame, log: DataFrame, on_missing: str = "error") -> DataFrame:
    """Replace link rows by the events they point at, through chains of any length; other rows stay.

    The result has the log's columns (of the target) and link_stream, link_version (of the row asked for, null if that
    is no link). Targets are found by an equi-join on (stream, version), hop by hop until no link is left. A missing target
    is an error, or its row is dropped (on_missing="drop"). So is a circle: every link remembers where it was after 1, 2,
    4, 8... hops, and one that comes there again goes round.
    """
    columns = log.columns
    plain = rows.filter(~F.coalesce(is_link(F.col("type")), F.lit(False)))
    out = plain.select(*columns, F.lit(None).cast("string").alias("link_stream"), F.lit(None).cast("int").alias("link_version"))
    start = [F.col("stream").alias("__at_s"), F.col("version").alias("__at_v")]
    todo = rows.filter(is_link(F.col("type"))).select(F.col("stream").alias("link_stream"), F.col("version").alias("link_version"), "data", *start)
    if todo.isEmpty():
        return out  # the common case: no join at all
    targets = log.filter(F.col("stream").isNotNull() & F.col("version").isNotNull())
    hops = 0
    while True:
        hops += 1
        asked = todo.select("link_stream", "link_version", "__at_s", "__at_v", reference_stream(F.col("data")).alias("__s"), reference_version(F.col("data")).alias("__v"))
        how = "inner" if on_missing == "drop" else "left"
        met = asked.join(targets, (F.col("__s") == F.col("stream")) & (F.col("__v") == F.col("version")), how)
        if on_missing == "error":
            text = F.concat(F.lit("no event "), F.coalesce(F.concat_ws("@", "__s", "__v"), F.lit("")))
            met = met.withColumn("stream", F.when(F.col("stream").isNull(), F.raise_error(text).cast("string")).otherwise(F.col("stream")))
        round_ = F.coalesce(is_link(F.col("type")) & (F.col("stream") == F.col("__at_s")) & (F.col("version") == F.col("__at_v")), F.lit(False))
        if on_missing == "drop":
            met = met.filter(~round_)
        else:
            text = F.concat(F.lit("links go round at "), F.concat_ws("@", "stream", "version"))
            met = met.withColumn("stream", F.when(round_, F.raise_error(text).cast("string")).otherwise(F.col("stream")))
        at = start if hops & (hops - 1) == 0 else [F.col("__at_s"), F.col("__at_v")]
        # a hop is computed once, and the next one starts from what was written
        met = written(met.select(*columns, "link_stream", "link_version", *at), "links")
        ends = met.filter(~F.coalesce(is_link(F.col("type")), F.lit(False)))
        out = out.unionByName(ends.drop("__at_s", "__at_v"))
        todo = met.filter(is_link(F.col("type"))).select("link_stream", "link_version", "data", "__at_s", "__at_v")
        if todo.isEmpty():
            return out
