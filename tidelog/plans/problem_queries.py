"""The queries of the training-data problems that need no language data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import changefeed, chunking, features, incremental, references
from tidelog.session import scratch_path
from tidelog.sources.tables import table

# ---- 1: a few keys hold most rows


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The streams with at least 1 % of all rows of event_log or index_entry."""
    log = chunking.heavy_keys(table(spark, d, "event_log"), "stream", "version", "position")
    index = chunking.heavy_keys(table(spark, d, "index_entry"), "stream", "version", "position")
    pick = lambda df, name: df.select(F.lit(name).alias("table_name"), F.col("key").alias("stream_key"))
    return pick(log, "event_log").unionByName(pick(index, "index_entry"))


def p1_stream_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and ordered results of every stream of event_log."""
    return chunking.key_summary(table(spark, d, "event_log"), "stream", "version", "position").withColumnRenamed("key", "stream")


def p1_index_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and ordered results of every stream of index_entry."""
    return chunking.key_summary(table(spark, d, "index_entry"), "stream", "version", "position").withColumnRenamed("key", "stream")


_SUMMARY = """
WITH r AS (SELECT CAST(stream AS VARCHAR) AS stream, version, position,
                  row_number() OVER (PARTITION BY stream ORDER BY position NULLS FIRST, version NULLS FIRST) AS row_no
           FROM {table} WHERE stream IS NOT NULL),
w AS (SELECT *, last_value(version IGNORE NULLS) OVER e AS pv, last_value(position IGNORE NULLS) OVER e AS pp FROM r
      WINDOW e AS (PARTITION BY stream ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT stream, count(*) AS n_rows, count(version) AS n_versions, min(version) AS min_version, max(version) AS max_version,
       arg_min(version, row_no) FILTER (version IS NOT NULL) AS first_version,
       arg_max(version, row_no) FILTER (version IS NOT NULL) AS last_version,
       min(position) AS first_position, max(position) AS last_position,
       CAST(count(*) FILTER (version < pv) AS BIGINT) AS n_backward, max(position - pp) AS max_gap
FROM w GROUP BY stream"""

# ---- 2: only new or changed records


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The entries added or changed since the last successful run of their segment."""
    commits = incremental.Commits(spark, scratch_path(spark, "entry-runs"))
    incremental.run_segments(table(spark, d, "index_entry"), commits, incremental.segment_marks(table(spark, d, "reader_run")))
    return commits.output(incremental.CHANGED, "/changed").select("stream", "version")


def p2_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two committed runs over index_entry: up to a moment, and from there to the end, with the number of the commit."""
    entries = table(spark, d, "index_entry")
    commits = incremental.Commits(spark, scratch_path(spark, "entry-runs"))
    marks = incremental.segment_marks(table(spark, d, "reader_run"))
    span = entries.agg(F.min("written_at").alias("a"), F.max("written_at").alias("b")).first()
    for limit in (span["a"] + (span["b"] - span["a"]) // 2 if span["a"] else None, None):
        incremental.run_segments(entries, commits, marks, limit)
    return commits.output(incremental.CHANGED, "/changed").select("stream", "version", "position", "old_position", "commit_no")


def p2_marks(spark: SparkSession, d: str) -> DataFrame:
    """The watermark of every segment that a successful run has read."""
    return incremental.segment_marks(table(spark, d, "reader_run")).select("segment_no", F.unix_micros(F.col("mark").cast("timestamp")).alias("mark_us"))


def p2_incremental_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two committed runs over event_log by position (the first up to half the greatest position) with counts per stream."""
    log = table(spark, d, "event_log")
    commits = incremental.Commits(spark, scratch_path(spark, "runs"))
    count = lambda new: new.filter(F.col("stream").isNotNull()).groupBy("stream").agg(F.count(F.lit(1)).alias("n_rows"), F.max("position").alias("last_position"))
    half = log.agg((F.max("position") / 2).cast("long").alias("h")).first()["h"]
    for limit in (half, None):
        incremental.run_once(lambda: log, commits, count, "position", limit)
    return commits.output("stream string, n_rows long, last_position long").select("stream", "n_rows", "last_position", F.col("commit_no").cast("int").alias("commit_no"))


# ---- 3: inserts, updates, deletes


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The streams that exist at the end and the version of the last change that took effect on each."""
    files = changefeed.change_files(changefeed.catalog_changes(table(spark, d, "event_log")))
    return changefeed.current_state(files, ()).select(F.col("key").alias("name"), F.col("last_seq").alias("last_version"))


def p3_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog rebuilt from the change feed, with its fields."""
    files = changefeed.change_files(changefeed.catalog_changes(table(spark, d, "event_log")))
    rows = changefeed.current_state(files)
    return rows.select(F.col("key").alias("name"), "first_seq", "last_seq", "hash", "created", "max_age", "max_count")


CHANGES_SQL = """
WITH raw AS (SELECT version AS seq, type, data FROM event_log WHERE stream = '_streams' AND version IS NOT NULL
             AND type IN ('_STREAM_CREATED', '_STREAM_UPDATED', '_STREAM_DELETED') AND json_valid(data)),
c AS (SELECT DISTINCT seq, type, CASE WHEN type = '_STREAM_DELETED' THEN data->>'$.stream' ELSE data->>'$.name' END AS name,
             CAST(data->>'$.hash' AS BIGINT) AS hash, CAST(data->>'$.created' AS BIGINT) AS created,
             CAST(data->>'$.maxAge' AS BIGINT) AS max_age, CAST(data->>'$.maxCount' AS INTEGER) AS max_count
      FROM raw WHERE json_type(data) = 'OBJECT'),
n AS (SELECT * FROM c WHERE name IS NOT NULL),
d AS (SELECT name, max(seq) AS gone FROM n WHERE type = '_STREAM_DELETED' GROUP BY name),
s AS (SELECT n.* FROM n LEFT JOIN d USING (name) WHERE type <> '_STREAM_DELETED' AND (gone IS NULL OR seq > gone)),
f AS (SELECT name, min(seq) AS first_seq FROM s WHERE type = '_STREAM_CREATED' GROUP BY name),
l AS (SELECT s.*, first_seq FROM s JOIN f USING (name) WHERE seq = first_seq OR (seq > first_seq AND type = '_STREAM_UPDATED'))
"""

# ---- 5: feature table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The (stream, type) cells with a count of at least 5."""
    return features.frequent_cells(table(spark, d, "event_log"), table(spark, d, "event_kind"))


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per user stream with count, total and last timestamp of every kind as columns."""
    return features.feature_table(table(spark, d, "event_log"), table(spark, d, "event_kind"))


def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    """The merged cells before they are expanded."""
    c = features.cells(features.encoded_events(table(spark, d, "event_log"), table(spark, d, "event_kind")))
    return c.select("stream", "kind_no", "n", F.col("total").cast("double").alias("total"), "latest")


_CELLS = """
WITH k AS (SELECT e.stream, e.version, kind_no, timestamp,
             CAST(CASE WHEN json_valid(data) AND json_type(data) = 'OBJECT' AND data->>'$.amount' IS NOT NULL
                  THEN TRY_CAST(trim(data->>'$.amount') AS DECIMAL(28,6)) END AS DECIMAL(28,6)) AS amount,
             row_number() OVER (PARTITION BY e.stream, e.version ORDER BY position, kind_no NULLS FIRST, timestamp NULLS FIRST) AS r
           FROM event_log e LEFT JOIN event_kind k ON e.type = k.type
           WHERE e.stream IS NOT NULL AND e.version IS NOT NULL AND NOT starts_with(e.stream, '_')),
c AS (SELECT stream, kind_no, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, max(timestamp) AS latest
      FROM k WHERE r = 1 AND kind_no IS NOT NULL GROUP BY stream, kind_no)
"""

# ---- 6: references that lead nowhere


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The events with a reference to something missing, deleted or later."""
    return references.broken_references(table(spark, d, "event_log"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """References by kind, day and status."""
    return references.reference_report(table(spark, d, "event_log"))


_REFERENCES = """
, g AS (SELECT name FROM n GROUP BY name HAVING max(seq) FILTER (type = '_STREAM_DELETED') > max(seq) FILTER (type = '_STREAM_CREATED')),
p AS (SELECT stream, version, min(position) AS pos FROM event_log WHERE stream IS NOT NULL AND version IS NOT NULL GROUP BY 1, 2),
e AS (SELECT stream, version, type, data, position, timestamp,
             row_number() OVER (PARTITION BY stream, version ORDER BY position, timestamp NULLS FIRST) AS r
      FROM event_log WHERE stream IS NOT NULL AND version IS NOT NULL),
o AS (SELECT *, CASE WHEN json_valid(data) AND json_type(data) = 'OBJECT' THEN data END AS obj FROM e WHERE r = 1),
t AS (SELECT 'link' AS kind, stream, version, position, timestamp, coalesce(data, '') AS txt FROM o WHERE type = '_>'
      UNION ALL SELECT 'cause', stream, version, position, timestamp, obj->>'$.cause' FROM o
      WHERE NOT starts_with(stream, '_') AND coalesce(type, '') <> '_>' AND obj->>'$.cause' IS NOT NULL),
q AS (SELECT *, regexp_extract(txt, '(?s)^(.*)@([0-9]{1,18})$', 1) AS ts,
             TRY_CAST(nullif(regexp_extract(txt, '(?s)^(.*)@([0-9]{1,18})$', 2), '') AS INTEGER) AS tv FROM t),
j AS (SELECT q.kind, q.stream, q.version, q.timestamp, CASE WHEN p.pos IS NULL THEN 'missing' WHEN g.name IS NOT NULL THEN 'deleted'
             WHEN p.pos > q.position THEN 'late' ELSE 'fine' END AS status
      FROM q LEFT JOIN p ON p.stream = q.ts AND p.version = q.tv LEFT JOIN g ON g.name = q.ts
      UNION ALL
      SELECT 'flush', o.stream, o.version, o.timestamp, CASE WHEN o.lp NOT IN (SELECT position FROM event_log) THEN 'missing'
             WHEN o.lp > o.position THEN 'late' ELSE 'fine' END
      FROM (SELECT *, TRY_CAST(obj->>'$.logPosition' AS BIGINT) AS lp FROM o WHERE type = '_INDEX_FLUSHED') o WHERE o.lp IS NOT NULL)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_stream_summary, p1_index_summary, p2_found, p2_two_runs, p2_marks, p2_incremental_runs, p3_found, p3_catalog, p5_found, p5_features, p5_cells, p6_found, p6_report)}

ORACLE = {
    "p1_found": """
SELECT 'event_log' AS table_name, stream AS stream_key FROM event_log WHERE stream IS NOT NULL GROUP BY stream
HAVING count(*) * 100 >= (SELECT count(*) FROM event_log)
UNION ALL SELECT 'index_entry', CAST(stream AS VARCHAR) FROM index_entry WHERE stream IS NOT NULL GROUP BY stream
HAVING count(*) * 100 >= (SELECT count(*) FROM index_entry)""",
    "p1_stream_summary": _SUMMARY.format(table="event_log"),
    "p1_index_summary": _SUMMARY.format(table="index_entry"),
    "p2_found": """
WITH l AS (SELECT run_id, segment_no, arg_max(lower(trim(status)), report_no) AS st, arg_max(read_until, report_no) AS ru FROM reader_run GROUP BY 1, 2),
m AS (SELECT segment_no, max(ru) AS mark FROM l WHERE st = 'ok' GROUP BY 1),
s AS (SELECT stream, version, arg_max(position, written_at) AS now, arg_max(position, written_at) FILTER (written_at <= mark) AS old
      FROM index_entry LEFT JOIN m USING (segment_no) WHERE stream IS NOT NULL AND version IS NOT NULL GROUP BY 1, 2)
SELECT stream, version FROM s WHERE old IS NULL OR old IS DISTINCT FROM now""",
    "p2_two_runs": """
WITH l AS (SELECT run_id, segment_no, arg_max(lower(trim(status)), report_no) AS st, arg_max(read_until, report_no) AS ru FROM reader_run GROUP BY 1, 2),
m AS (SELECT segment_no, max(ru) AS mark FROM l WHERE st = 'ok' GROUP BY 1),
h AS (SELECT make_timestamp((epoch_us(min(written_at)) + epoch_us(max(written_at))) // 2) AS half FROM index_entry),
e AS (SELECT i.*, mark, half, greatest(mark, half) AS later FROM index_entry i LEFT JOIN m USING (segment_no), h WHERE stream IS NOT NULL AND version IS NOT NULL),
s AS (SELECT stream, version, arg_max(position, (written_at, position)) FILTER (written_at <= half) AS at_half, arg_max(position, (written_at, position)) AS now,
             arg_max(position, (written_at, position)) FILTER (written_at <= mark) AS old, arg_max(position, (written_at, position)) FILTER (written_at <= later) AS held,
             coalesce(bool_or(written_at > coalesce(mark, written_at - INTERVAL 1 DAY) AND written_at <= half), false) AS new1, coalesce(bool_or(written_at > later), false) AS new2 FROM e GROUP BY 1, 2)
SELECT stream, version, at_half AS position, old AS old_position, 1 AS commit_no FROM s WHERE new1 AND (old IS NULL OR old IS DISTINCT FROM at_half)
UNION ALL SELECT stream, version, now, held, 2 FROM s WHERE new2 AND (held IS NULL OR held IS DISTINCT FROM now)""",
    "p2_marks": """
WITH l AS (SELECT run_id, segment_no, arg_max(lower(trim(status)), report_no) AS st, arg_max(read_until, report_no) AS ru FROM reader_run GROUP BY 1, 2)
SELECT segment_no, epoch_us(max(ru)) AS mark_us FROM l WHERE st = 'ok' GROUP BY 1""",
    "p2_incremental_runs": """
WITH h AS (SELECT CAST(floor(max(position) / 2) AS BIGINT) AS half FROM event_log)
SELECT stream, count(*) AS n_rows, max(position) AS last_position, CAST(CASE WHEN position <= half THEN 1 ELSE 2 END AS INTEGER) AS commit_no
FROM event_log, h WHERE stream IS NOT NULL GROUP BY stream, CAST(CASE WHEN position <= half THEN 1 ELSE 2 END AS INTEGER)""",
    "p3_found": CHANGES_SQL + "SELECT name, max(seq) AS last_version FROM l GROUP BY name",
    "p3_catalog": CHANGES_SQL
    + """SELECT name, min(first_seq) AS first_seq, max(seq) AS last_seq, arg_max(hash, seq) AS hash, arg_max(created, seq) AS created,
arg_max(max_age, seq) AS max_age, arg_max(max_count, seq) AS max_count FROM l GROUP BY name""",
    "p5_found": _CELLS + "SELECT stream, type FROM c JOIN event_kind USING (kind_no) WHERE n >= 5",
    "p5_cells": _CELLS + "SELECT stream, kind_no, n, total, latest FROM c",
    "p6_found": CHANGES_SQL + _REFERENCES + "SELECT DISTINCT stream, version FROM j WHERE status <> 'fine'",
    "p6_report": CHANGES_SQL
    + _REFERENCES
    + "SELECT kind, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS day, status, count(*) AS n_references FROM j GROUP BY 1, 2, 3",
}
_WIDE = ", ".join(f"coalesce(max(n) FILTER (kind_no = {k}), 0) AS n_{k}, max(total) FILTER (kind_no = {k}) AS total_{k}, max(latest) FILTER (kind_no = {k}) AS latest_{k}" for k in range(1, 241))
ORACLE["p5_features"] = (
    _CELLS
    + f", u AS (SELECT DISTINCT stream FROM event_log WHERE stream IS NOT NULL AND version IS NOT NULL AND NOT starts_with(stream, '_')) SELECT stream, {_WIDE} FROM u LEFT JOIN c USING (stream) GROUP BY stream"
)
