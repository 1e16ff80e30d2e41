"""References to records that do not exist: co-partitioned merge of references and parents.

One scan takes out what refers (links, causes, index flushes) and what changes the catalog. References and parent keys are
then hash-partitioned by the same key, sorted by it and merged in one linear pass (Spark's sort-merge join, asked for by
hint); a target that very many references name is joined apart (join_by_key()). What a parent offers is an interval: it can
be referred to from its smallest position on, and until the change that ended its stream. So a reference is

* missing: no parent has the key (also when the text can't be read as a key);
* deleted: the parent's interval has an end: its stream existed at some time and does not at the end;
* late: the parent's interval begins after the referring event;
* fine otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.json import is_object, json_object, may_hold_key, top_level
from tidelog.functions.names import is_system_name, reference_stream, reference_version
from tidelog.operators.changefeed import lifetimes
from tidelog.schema import INDEX_FLUSHED, LINK_TYPE, STREAM_CREATED, STREAM_DELETED, STREAM_UPDATED, STREAMS_STREAM
from tidelog.session import is_small, join_by_key, sized, written

CHANGES = {STREAM_CREATED: "created", STREAM_UPDATED: "updated", STREAM_DELETED: "deleted"}


def extracted(log: DataFrame) -> DataFrame:
    """kind, stream, version, position, timestamp, text: what refers to something and what changes the catalog, in one scan.

    link: the data of rows of the link type (null and empty too: unreadable). cause: top-level `cause` of user events with
    JSON object data. flush: top-level `logPosition` of index-flush events. created, updated, deleted: the stream that a
    change in `_streams` names. Null or absent values give no row, nor do rows with a null stream or version.
    """
    kind, data = F.col("type"), F.col("data")
    link = F.coalesce(kind == LINK_TYPE, F.lit(False))
    flush = F.coalesce(kind == INDEX_FLUSHED, F.lit(False))
    change = F.coalesce((F.col("stream") == STREAMS_STREAM) & kind.isin(*CHANGES), F.lit(False))
    cause = ~link & ~is_system_name(F.col("stream")) & F.coalesce(may_hold_key(data, "cause"), F.lit(False))
    rows = log.filter(F.col("stream").isNotNull() & F.col("version").isNotNull()).filter(link | flush | change | cause)
    rows = rows.select("stream", "version", "position", "timestamp", "type", link.alias("link"), flush.alias("flush"), change.alias("change"), cause.alias("cause"), data.alias("raw"), json_object(F.when(~link, data)).alias("v"))
    v, row = F.col("v"), lambda on, kind, text: F.when(on, F.struct(kind.alias("kind"), text.alias("text")))
    name = F.when(F.col("type") == STREAM_DELETED, top_level(v, "stream")).otherwise(top_level(v, "name"))
    operation = F.coalesce(*[F.when(F.col("type") == t, F.lit(o)) for t, o in CHANGES.items()])
    found = F.array(
        row(F.col("link"), F.lit("link"), F.coalesce("raw", F.lit(""))),
        row(F.col("cause"), F.lit("cause"), top_level(v, "cause")),
        row(F.col("flush"), F.lit("flush"), top_level(v, "logPosition")),
        row(F.col("change") & is_object(v), operation, name),
    )
    some = F.filter(found, lambda x: x.isNotNull() & x["text"].isNotNull())
    return rows.select("stream", "version", "position", "timestamp", F.explode(some).alias("f")).select("f.kind", "stream", "version", "position", "timestamp", "f.text")


def references(extract: DataFrame) -> DataFrame:
    """kind, stream, version, position, timestamp, text: one row per referring event and kind, that of the smallest position."""
    first = F.min(F.struct("position", "timestamp", "text")).alias("r")
    return extract.filter(F.col("kind").isin("link", "cause", "flush")).groupBy("stream", "version", "kind").agg(first).select("kind", "stream", "version", "r.position", "r.timestamp", "r.text")


def ended_streams(extract: DataFrame) -> DataFrame:
    """target_stream, target_end (the change that ended it) of the streams that existed and don't at the end; written once."""
    body = F.struct(F.col("kind").alias("op"), F.col("text").alias("key"))
    changes = extract.filter(F.col("kind").isin(*CHANGES.values())).groupBy(F.col("version").alias("seq")).agg(F.min_by(body, F.coalesce("position", F.lit(2**63 - 1))).alias("b")).select("seq", "b.*")
    gone = lifetimes(changes).filter(F.col("valid_to").isNotNull())
    return sized(gone.select(F.col("key").alias("target_stream"), F.col("valid_to").alias("target_end")), "ended")


def _status(refs: DataFrame) -> DataFrame:
    """Judge references that know their target's interval: target_start, target_end."""
    status = (
        F.when(F.col("target_start").isNull(), "missing")
        .when(F.col("target_end").isNotNull(), "deleted")
        .when(F.col("target_start") > F.col("position"), "late")
        .otherwise("fine")
    )
    return refs.select("kind", "stream", "version", "position", "timestamp", "target_stream", "target_version", "target_start", "target_end", status.alias("status"))


def judged_names(refs: DataFrame, log: DataFrame, ended: DataFrame) -> DataFrame:
    """Links and causes with their target, its interval and status. refs and ended are cut already."""
    refs = refs.filter(F.col("kind") != "flush").withColumn("target_stream", reference_stream(F.col("text"))).withColumn("target_version", reference_version(F.col("text")))
    known = join_by_key(refs, ended, ["target_stream"], "left")
    parents = (
        log.filter(F.col("stream").isNotNull() & F.col("version").isNotNull())
        .select(F.col("stream").alias("target_stream"), F.col("version").alias("target_version"), "position")
        .groupBy("target_stream", "target_version")
        .agg(F.min("position").alias("target_start"))
    )
    return _status(join_by_key(known, parents, ["target_stream", "target_version"], "left", merge=True))


def judged_flushes(refs: DataFrame, log: DataFrame) -> DataFrame:
    """Flush references: missing if no row has the position, late if it exceeds the event's own.

    The log's positions are filtered by the positions asked for before anything is shuffled.
    """
    refs = refs.filter(F.col("kind") == "flush").withColumn("target", F.when(F.col("text").rlike(r"^-?\d+$"), F.col("text")).try_cast("long"))
    asked = sized(refs.select("target").filter(F.col("target").isNotNull()).distinct(), "asked")
    small = is_small(asked)
    there = log.select(F.col("position").alias("target")).join(F.broadcast(asked) if small else asked, "target", "left_semi").distinct().withColumn("target_start", F.col("target"))
    # what is there is a part of what was asked for, so it is small if that is
    met = refs.join(F.broadcast(there), "target", "left") if small else join_by_key(refs, there, ["target"], "left")
    return _status(met.withColumns({"target_stream": F.lit(None).cast("string"), "target_version": F.lit(None).cast("int"), "target_end": F.lit(None).cast("int")}))


def judged_references(log: DataFrame) -> DataFrame:
    """Every reference of the log with its status; an event has at most one row per kind."""
    extract = written(extracted(log), "extract")
    refs = written(references(extract), "references")
    return judged_names(refs, log, ended_streams(extract)).unionByName(judged_flushes(refs, log))


def broken_references(log: DataFrame) -> DataFrame:
    """stream, version of the events with a reference that is missing, deleted or late."""
    return judged_references(log).filter(F.col("status") != "fine").select("stream", "version").distinct()


def reference_report(log: DataFrame) -> DataFrame:
    """References per kind, day (UTC, of the referring event; null without timestamp) and status."""
    day = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd")
    return judged_references(log).groupBy("kind", day.alias("day"), "status").agg(F.count(F.lit(1)).alias("n_references"))
