"""Queries over the event log's own operators, with their SQL. The log is made from `events` (see sources.adapters) unless
a query names another table; queries over event_log take its dirty rows as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.json import json_object, top_level
from tidelog.functions import text
from tidelog.functions.names import event_id, is_blank, is_link, is_system_name, reference_stream, reference_version
from tidelog.operators import appending, catalog, chunking, links, maintenance, reads, retention
from tidelog.plans import projections as P
from tidelog.plans.problem_queries import CHANGES_SQL
from tidelog.schema import INDEX_FLUSHED, LOG
from tidelog.session import scratch_path, written
from tidelog.sources import adapters
from tidelog.sources.store import EventStore
from tidelog.sources.tables import table
from tidelog.streaming import subscriptions

NOW = adapters.EVENTS_NOW
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_LOG = """
WITH log AS (SELECT event_id AS position, 'user-' || user_id AS stream, event_type AS type,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS version,
             epoch_us(ts) // 1000 AS timestamp, props AS data FROM events),
cat AS (SELECT 'user-' || user_id AS name, min(epoch_us(ts) // 1000) AS created,
        CAST(CASE WHEN user_id % 5 = 0 THEN 172800 ELSE -1 END AS BIGINT) AS max_age, CAST(CASE WHEN user_id % 3 = 0 THEN 10 ELSE -1 END AS INTEGER) AS max_count
        FROM events GROUP BY user_id),
cur AS (SELECT stream, max(version) AS current FROM log GROUP BY stream),
lim AS (SELECT log.*, c.max_age, c.max_count, current FROM log JOIN cat c ON c.name = log.stream JOIN cur USING (stream)),
aged AS (SELECT * FROM lim WHERE max_age <= 0 OR (1706659200000 - timestamp) // 1000 <= max_age),
kept AS (SELECT * FROM aged WHERE max_count <= 0 OR version > current - max_count),
tl AS (SELECT 'type-' || type AS link_stream, CAST(row_number() OVER (PARTITION BY type ORDER BY position) - 1 AS INTEGER) AS link_version,
       position AS link_position, stream || '@' || version AS ref FROM log)
"""
_ROW = "position, stream, type, version, timestamp, data"
_COLUMNS = _ROW.split(", ")
#: The types of `events`.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None):
    """Register a query under its function's name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, d: str) -> DataFrame:
    return adapters.events_log(spark, d)


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return adapters.events_log(spark, d), adapters.events_catalog(spark, d)


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """The log with a link stream per type after it."""
    log = _log(spark, d)
    return log.unionByName(adapters.type_links(log).withColumn("position", F.col("position") + 1_000_000_000))


# ---- sources and scans


@query("SELECT position, stream, type, version, timestamp, data FROM event_log")
def from_all(spark, d):
    return reads.from_all(table(spark, d, "event_log")).select(*_COLUMNS)


@query("SELECT position, stream, type, version, timestamp, data FROM event_log")
def log_backward(spark, d):
    return reads.from_all(table(spark, d, "event_log"), backward=True).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM log WHERE position = 17")
def log_get(spark, d):
    return reads.at_position(_log(spark, d), 17).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM kept WHERE stream = 'user-0'")
def from_stream(spark, d):
    return reads.from_stream(*_both(spark, d), "user-0", NOW).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM kept WHERE stream = 'user-1' AND version >= 7")
def from_stream_version(spark, d):
    return reads.from_stream(*_both(spark, d), "user-1", NOW, 7).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM aged WHERE stream IN ('user-0', 'user-1', 'user-5')")
def zip_streams(spark, d):
    return reads.zip_streams(*_both(spark, d), ["user-0", "user-1", "user-5", "user-1", " ", ""], NOW).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM aged WHERE starts_with(stream, 'user-1')")
def zip_prefix(spark, d):
    return reads.zip_prefix(*_both(spark, d), "user-1*", NOW).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM aged")
def zip_all(spark, d):
    return reads.zip_prefix(*_both(spark, d), "*", NOW).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM aged WHERE stream = 'user-1'")
def zip_exact_name(spark, d):
    return reads.zip_prefix(*_both(spark, d), "user-1", NOW).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM kept WHERE stream IN ('user-0', 'user-1', 'user-3')")
def streams_parallel(spark, d):
    return reads.from_streams(*_both(spark, d), ["user-0", "user-1", "user-3"], NOW).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM kept WHERE stream IN ('user-0', 'user-3')")
def streams_mapped(spark, d):
    mapped = reads.streams_mapped(*_both(spark, d), ["user-0", "user-3"], NOW)
    return chunking.union_all([df.select(*_COLUMNS) for df in mapped.values()])


@query(_LOG + f"SELECT {_ROW} FROM log WHERE stream = 'user-2' AND version = 3")
def get_event(spark, d):
    return reads.get_event(_log(spark, d), "user-2", 3).select(*_COLUMNS)


@query("SELECT stream, version, position FROM event_log")
def keys(spark, d):
    return reads.keys(table(spark, d, "event_log"))


@query("SELECT stream, version, position FROM event_log WHERE stream = 'ledger-189' AND version >= 20 AND version < 90")
def index_range(spark, d):
    return reads.index_range(table(spark, d, "event_log"), "ledger-189", 20, 90)


@query("SELECT stream, version, position FROM event_log WHERE stream = '_streams' AND version < 40")
def index_range_backward(spark, d):
    return reads.index_range(table(spark, d, "event_log"), "_streams", 0, 40, backward=True)


@query("SELECT stream, version, position FROM event_log WHERE stream = '_streams' AND version = 5")
def index_get(spark, d):
    return reads.index_get(table(spark, d, "event_log"), "_streams", 5)


@query("SELECT stream, version, position FROM event_log WHERE position > (SELECT max(position) FROM event_log WHERE type = '_INDEX_FLUSHED')")
def index_tail(spark, d):
    return reads.index_tail(table(spark, d, "event_log"))


@query("SELECT position, stream, type, version, timestamp, data FROM event_log WHERE position IN (SELECT position FROM index_entry)")
def index_fetch(spark, d):
    return reads.fetch(table(spark, d, "index_entry"), table(spark, d, "event_log")).select(*_COLUMNS)


# ---- catalog


@query(_LOG + "SELECT name, created, max_age, max_count, current AS version FROM cat JOIN cur ON cur.stream = cat.name")
def streams_metadata(spark, d):
    log, cat = _both(spark, d)
    return catalog.streams_metadata(cat, log).select("name", "created", "max_age", "max_count", "version")


@query(_LOG + "SELECT name, created, max_age, max_count, current AS version FROM cat JOIN cur ON cur.stream = cat.name WHERE name = 'user-3'")
def stream_metadata(spark, d):
    log, cat = _both(spark, d)
    return catalog.stream_metadata(cat, log, "user-3").select("name", "created", "max_age", "max_count", "version")


@query("SELECT CAST(coalesce(max(version), -1) AS INTEGER) AS version FROM event_log WHERE stream = '_streams'")
def stream_version(spark, d):
    return catalog.stream_version(table(spark, d, "event_log"), "_streams")


@query("SELECT CAST(-1 AS INTEGER) AS version")
def missing_version(spark, d):
    return catalog.stream_version(table(spark, d, "event_log"), "no such stream")


@query("SELECT stream, max(version) AS version FROM event_log WHERE stream IS NOT NULL GROUP BY stream")
def stream_versions(spark, d):
    return retention.current_versions(table(spark, d, "event_log"))


@query("SELECT DISTINCT name FROM stream_catalog WHERE starts_with(name, 'ledger')")
def matching_streams(spark, d):
    return catalog.matching_streams(table(spark, d, "stream_catalog"), "ledger*").distinct()


@query("SELECT name FROM stream_catalog WHERE permissions['team-1'] = 1")
def permissions(spark, d):
    return catalog.has_permission(table(spark, d, "stream_catalog"), "team-1", 1)


@query(CHANGES_SQL + "SELECT name, arg_max(created, seq) AS created, arg_max(max_age, seq) AS max_age, arg_max(max_count, seq) AS max_count FROM l GROUP BY name")
def catalog_replay(spark, d):
    """The catalog that the `_streams` events of event_log leave: first creation wins, a delete ends it."""
    return catalog.replay(table(spark, d, "event_log")).select("name", "created", "max_age", "max_count")


# ---- retention


@query(_LOG + f"SELECT {_ROW} FROM lim WHERE max_count <= 0 OR version > current - max_count")
def retention_max_count(spark, d):
    return retention.max_count(*_both(spark, d)).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM aged")
def retention_max_age(spark, d):
    return retention.max_age(*_both(spark, d), NOW).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM kept")
def retention_both(spark, d):
    return retention.retained(*_both(spark, d), NOW).select(*_COLUMNS)


@query(_LOG + f"SELECT {_ROW} FROM kept WHERE NOT starts_with(stream, 'user-2')")
def scavenge(spark, d):
    log, cat = _both(spark, d)
    gone = cat.filter(F.col("name").startswith("user-2")).select("name")
    return retention.scavenge(log, cat, gone, NOW).select(*_COLUMNS)


# ---- links


@query(_LOG + "SELECT link_stream AS stream, link_version AS version, ref AS data FROM tl")
def link_create(spark, d):
    """Links made by link_to(), one stream per type, and the versions they get when they are appended."""
    log = _log(spark, d)
    made = chunking.union_all([links.link_to(log.filter(F.col("type") == k).withColumn("ordinal", F.col("position")), f"type-{k}") for k in EVENT_TYPES])
    return appending.append_versions(log.limit(0), made).select("stream", "version", "data")


@query(_LOG + f"SELECT link_stream, link_version, {_ROW} FROM tl JOIN log ON ref = stream || '@' || version")
def link_resolve(spark, d):
    log = _linked(spark, d)
    return links.resolve(log.filter(is_link(F.col("type"))), log).select("link_stream", "link_version", *_COLUMNS)


@query(_LOG + f"SELECT 'chain-' || link_stream AS link_stream, link_version, {_ROW} FROM tl JOIN log ON ref = stream || '@' || version")
def link_chain(spark, d):
    """Links to links: a stream of links to each link stream, followed to the events."""
    log = _linked(spark, d)
    first = log.filter(is_link(F.col("type")))
    second = first.withColumn("data", event_id(F.col("stream"), F.col("version"))).withColumn("stream", F.concat(F.lit("chain-"), "stream")).withColumn("position", F.col("position") + 1_000_000_000)
    return links.resolve(second, log.unionByName(second)).select("link_stream", "link_version", *_COLUMNS)


@query(_LOG + f"""SELECT t.link_stream, t.link_version, {", ".join("l." + c for c in _COLUMNS)} FROM
(SELECT tl.*, max(link_version) OVER (PARTITION BY link_stream) AS top FROM tl) t JOIN log l ON ref = l.stream || '@' || l.version
WHERE link_version > top - 5""")
def link_retention(spark, d):
    """Retention goes by the link's own stream; what it points at may be expired."""
    log = _linked(spark, d)
    rows = log.filter(is_link(F.col("type")))
    limits = rows.select(F.col("stream").alias("name")).distinct().select("name", F.lit(5).alias("max_count"), F.lit(-1).cast("long").alias("max_age"))
    return links.resolve(retention.retained(rows, limits, NOW), log).select("link_stream", "link_version", *_COLUMNS)


@query("""
WITH l AS (SELECT DISTINCT stream, version, data, regexp_extract(data, '(?s)^(.*)@([0-9]{1,9})$', 1) AS ts, TRY_CAST(nullif(regexp_extract(data, '(?s)^(.*)@([0-9]{1,9})$', 2), '') AS INTEGER) AS tv
           FROM event_log WHERE type = '_>' AND stream IS NOT NULL AND version IS NOT NULL)
SELECT stream, version, ts AS target_stream, tv AS target_version FROM l WHERE tv IS NOT NULL""")
def link_targets(spark, d):
    """The readable targets of all links of event_log; the version follows the last @."""
    rows = table(spark, d, "event_log").filter(is_link(F.col("type")) & F.col("stream").isNotNull() & F.col("version").isNotNull())
    out = rows.select("stream", "version", "data").distinct().select("stream", "version", reference_stream(F.col("data")).alias("target_stream"), reference_version(F.col("data")).alias("target_version"))
    return out.filter(F.col("target_version").isNotNull())


@query(_LOG + "SELECT 'copies' AS stream, type, data FROM log WHERE stream = 'user-4'")
def emit(spark, d):
    return links.emit(_log(spark, d).filter(F.col("stream") == "user-4"), "copies").select("stream", "type", "data")


# ---- appending


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored half of the log (even positions, versions anew) and the other half as a batch."""
    log = _log(spark, d)
    even = log.filter(F.col("position") % 2 == 0).drop("version")
    batch = log.filter(F.col("position") % 2 == 1).select(F.col("position").alias("ordinal"), "stream", "type", "data")
    return adapters.with_versions(even, ["position"]), batch


@query("""
WITH x AS (SELECT event_id, 'user-' || user_id AS stream, user_id, event_type AS type FROM events),
o AS (SELECT user_id, max(r) AS current FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM x WHERE event_id % 2 = 0) GROUP BY user_id)
SELECT stream, type, CAST(coalesce(current, -1) + row_number() OVER (PARTITION BY x.user_id ORDER BY event_id) AS INTEGER) AS version,
       (SELECT max(event_id) FROM x WHERE event_id % 2 = 0) + row_number() OVER (ORDER BY event_id) AS position
FROM x LEFT JOIN o ON o.user_id = x.user_id WHERE event_id % 2 = 1""")
def append_versions(spark, d):
    log, batch = _halves(spark, d)
    return appending.append_versions(log, appending.validated(batch)).select("stream", "type", "version", "position")


@query(_LOG + "SELECT stream, CAST(9 AS INTEGER) AS expected, current FROM cur WHERE current <> 9 UNION ALL SELECT 'nobody', 9, -1")
def expected_version_conflicts(spark, d):
    log = _log(spark, d)
    names = log.select("stream").distinct()
    nobody = spark.createDataFrame([("nobody",)], "stream string")
    unchecked = names.select("stream", F.lit(-5).alias("expected"))
    return appending.version_conflicts(log, names.unionByName(nobody).select("stream", F.lit(9).alias("expected")).unionByName(unchecked))


@query("SELECT DISTINCT stream FROM event_log WHERE stream IS NOT NULL AND stream NOT IN (SELECT name FROM stream_catalog)")
def implicit_create(spark, d):
    return appending.implicit_creates(table(spark, d, "stream_catalog"), table(spark, d, "event_log"))


@query("""
SELECT position, CASE WHEN stream IS NULL OR trim(stream) = '' THEN 'blank stream' WHEN type IS NULL OR trim(type) = '' THEN 'blank type' ELSE 'reserved stream name' END AS reason
FROM event_log WHERE stream IS NULL OR trim(stream) = '' OR type IS NULL OR trim(type) = '' OR starts_with(stream, '_')""")
def invalid_appends(spark, d):
    return appending.invalid_rows(table(spark, d, "event_log")).select("position", "reason")


@query("""
WITH n AS (SELECT position, (row_number() OVER (ORDER BY position) - 1) // 1000 AS flush_no FROM event_log)
SELECT flush_no, count(*) AS n_entries, max(position) AS log_position FROM n GROUP BY flush_no HAVING count(*) = 1000""")
def flush_batches(spark, d):
    return appending.flush_batches(table(spark, d, "event_log"), 1000)


# ---- aggregates and projections


@query("SELECT count(*) AS n_events, (SELECT count(*) FROM (SELECT DISTINCT stream, version FROM event_log WHERE stream IS NOT NULL AND version IS NOT NULL)) AS n_keys, max(position) AS head FROM event_log")
def log_size(spark, d):
    return reads.log_size(table(spark, d, "event_log"))


@query("SELECT max(position) AS head FROM event_log")
def log_position(spark, d):
    return reads.log_size(table(spark, d, "event_log")).select("head")


def _value() -> F.Column:
    return top_level(json_object(F.col("data")), "k", "long")


@query(_LOG + """SELECT count(*) FILTER (type = 'click') AS clicks, count(*) FILTER (type = 'view') AS views, CAST(sum(CAST(data->>'$.k' AS BIGINT)) FILTER (type = 'purchase') AS BIGINT) AS spent,
max(timestamp) AS latest FROM log WHERE stream IN ('user-0', 'user-1')""")
def projection_counts(spark, d):
    """One state over two merged streams."""
    events = _log(spark, d).filter(F.col("stream").isin("user-0", "user-1"))
    handlers = {"click": {"clicks": P.count()}, "view": {"views": P.count()}, "purchase": {"spent": P.total(_value())}, P.ANY: {"latest": P.greatest(F.col("timestamp"))}}
    return P.Projection(events).when(handlers).single()


@query(_LOG + "SELECT stream, count(*) FILTER (type = 'click') AS clicks, arg_max(type, position) AS last_type, count(*) AS n FROM log GROUP BY stream")
def projection_foreach(spark, d):
    """A state of its own for every stream."""
    return P.Projection(_log(spark, d)).when({"click": {"clicks": P.count()}, P.ANY: {"last_type": P.latest(F.col("type")), "n": P.count()}}).per_stream()


@query(_LOG + "SELECT stream, count(*) AS n FROM log WHERE version % 2 = 0 GROUP BY stream")
def projection_filter(spark, d):
    return P.Projection(_log(spark, d)).when({P.ANY: {"n": P.count()}}).filter(F.col("version") % 2 == 0).per_stream()


@query(_LOG + "SELECT stream, count(*) AS every, count(*) FILTER (type = 'view') AS views FROM log GROUP BY stream")
def projection_any(spark, d):
    """The handler for all types gets every event once, beside the typed one."""
    return P.Projection(_log(spark, d)).when({P.ANY: {"every": P.count()}, "view": {"views": P.count()}}).per_stream()


@query(_LOG + """, s AS (SELECT stream, version, type, CAST(type <> lag(type) OVER (PARTITION BY stream ORDER BY version) AS INTEGER) AS turn FROM log)
SELECT stream, coalesce(CAST(sum(turn) AS BIGINT), 0) AS turns, arg_max(type, version) AS last_type FROM s GROUP BY stream""")
def projection_ordered_fold(spark, d):
    """A fold that depends on order: how often the type changes along a stream."""

    def turn(state: dict, event: dict) -> dict:
        changed = state["last"] is not None and state["last"] != event["type"]
        return {"last": event["type"], "turns": state["turns"] + int(changed)}

    folded = P.fold_per_stream(_log(spark, d), {"last": None, "turns": 0}, {P.ANY: turn})
    state = F.from_json("state", "last string, turns long")
    return folded.select("stream", state["turns"].alias("turns"), state["last"].alias("last_type"))


@query("""
WITH o AS (SELECT 'customer-' || o_custkey AS stream, o_orderstatus AS type, o_orderdate, o_orderkey FROM orders)
SELECT stream, count(*) AS n_orders, count(*) FILTER (type = 'F') AS finished, arg_max(type, (o_orderdate, o_orderkey)) AS last_type FROM o GROUP BY stream""")
def projection_orders(spark, d):
    """Orders as events of their customers."""
    return P.Projection(adapters.orders_log(spark, d)).when({P.ANY: {"n_orders": P.count(), "last_type": P.latest(F.col("type"))}, "F": {"finished": P.count()}}).per_stream()


@query("""
SELECT 'order-' || l_orderkey AS stream, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS DOUBLE) AS returned, max(l_extendedprice) AS dearest FROM lineitem GROUP BY l_orderkey""")
def projection_lineitem(spark, d):
    """Order lines as events of their order, with typed payload."""
    handlers = {P.ANY: {"n": P.count(), "dearest": P.greatest(F.col("l_extendedprice"))}, "R": {"returned": P.total(F.col("l_quantity"))}}
    return P.Projection(adapters.lineitem_log(spark, d)).when(handlers).per_stream()


# ---- maintenance


@query(_LOG + """, n AS (SELECT stream, version, (row_number() OVER (ORDER BY stream, version) - 1) // 200 AS block FROM log)
SELECT block, arg_min(stream, (stream, version)) AS first_stream, arg_min(version, (stream, version)) AS first_version,
       arg_max(stream, (stream, version)) AS last_stream, arg_max(version, (stream, version)) AS last_version, count(*) AS n_entries FROM n GROUP BY block""")
def segment_zone_map(spark, d):
    """Blocks of 200 entries of the sorted index with their least and greatest key."""
    index = reads.keys(_log(spark, d))
    before = chunking.ordered_offsets(index.groupBy("stream").agg(F.count(F.lit(1)).alias("n")), "stream", "n")
    numbered = chunking.number_rows(index, "stream", ["version"]).join(before, "stream")
    return maintenance.zone_map(numbered.withColumn("row_no", F.col("before") + F.col("row_no")), 200)


@query("SELECT stream, version, min(position) AS position FROM event_log WHERE stream IS NOT NULL AND version IS NOT NULL GROUP BY stream, version")
def index_compaction(spark, d):
    """Two overlapping index segments merged to unique entries."""
    index = reads.keys(table(spark, d, "event_log").filter(F.col("stream").isNotNull() & F.col("version").isNotNull()))
    half = index.agg((F.max("position") / 2).cast("long").alias("h")).first()["h"] or 0
    return maintenance.compact(index.filter(F.col("position") <= half), index.filter(F.col("position") > half))


@query("SELECT stream, version, position FROM event_log WHERE stream = 'ledger-189' UNION ALL SELECT stream, version, position FROM event_log WHERE stream = '_index'")
def index_concat(spark, d):
    index = reads.keys(table(spark, d, "event_log"))
    return maintenance.concat(index.filter(F.col("stream") == "ledger-189"), index.filter(F.col("stream") == "_index"))


@query("""
WITH k AS (SELECT DISTINCT stream FROM event_log WHERE stream IS NOT NULL), a AS (SELECT DISTINCT name FROM stream_catalog UNION SELECT DISTINCT 'no ' || name FROM stream_catalog UNION SELECT DISTINCT stream || '?' FROM k)
SELECT count(*) AS n_asked, count(*) FILTER (name IN (SELECT stream FROM k)) AS n_held, CAST(0 AS BIGINT) AS n_false_no, true AS within FROM a""")
def bloom_membership(spark, d):
    """Names asked of a sketch of the log's streams, half of them not there: how many it holds, the false no (never), and
    whether the false yes are at most twice the rate it is made for (and five more, as there may be few)."""
    keys = table(spark, d, "event_log").select("stream").filter(F.col("stream").isNotNull()).distinct()
    names = table(spark, d, "stream_catalog").select(F.col("name").alias("stream"))
    asked = names.union(names.select(F.concat(F.lit("no "), "stream"))).union(keys.select(F.concat("stream", F.lit("?")))).distinct()
    bits, hashes = maintenance.bloom_shape(keys.count())
    words = written(maintenance.bloom_words(keys, "stream", bits, hashes), "bloom")
    found = maintenance.bloom_contains(words, asked, "stream", bits, hashes).join(keys.withColumn("held", F.lit(True)), "stream", "left")
    held = F.coalesce("held", F.lit(False))
    counts = found.agg(F.count(F.lit(1)).alias("n_asked"), F.count_if(held).alias("n_held"), F.count_if(held & ~F.col("maybe")).alias("n_false_no"), F.count_if(~held & F.col("maybe")).alias("n"))
    most = 5 + 2 * maintenance.BLOOM_ERROR * (F.col("n_asked") - F.col("n_held"))
    return counts.select("n_asked", "n_held", "n_false_no", (F.col("n") <= most).alias("within"))


@query(_LOG + "SELECT stream || '@' || version || ' ' || type || ' ' || coalesce(data, '') AS line FROM log WHERE stream = 'user-3'")
def dump_stream(spark, d):
    return maintenance.dump_stream(_log(spark, d).filter(F.col("stream") == "user-3"))


@query(_LOG + "SELECT position || ' | ' || stream || '@' || version || ' ' || type || ' ' || coalesce(data, '') AS line FROM log")
def dump_log(spark, d):
    return maintenance.dump_log(_log(spark, d))


@query(_LOG + "SELECT position || ' | ' || stream || '@' || version AS line FROM log")
def dump_index(spark, d):
    return maintenance.dump_index(reads.keys(_log(spark, d)))


# ---- subscriptions


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """event_log as a stream of files; a pattern, since the table may be one file or a folder of them."""
    return subscriptions.log_stream(spark, f"{d}/event_log.parque[t]", LOG)


@query("SELECT position, stream, type, version, timestamp, data FROM event_log")
def subscribe_all(spark, d):
    return subscriptions.drained(_stream(spark, d), "subscribe").select(*_COLUMNS)


@query("SELECT position, stream, type, version, timestamp, data FROM event_log WHERE position >= 1000000")
def subscribe_from_position(spark, d):
    return subscriptions.drained(subscriptions.log_stream(spark, f"{d}/event_log.parque[t]", LOG, 1_000_000), "subscribe").select(*_COLUMNS)


@query("SELECT position, stream, type, version, timestamp, data FROM event_log WHERE stream IN ('ledger-189', '_index')")
def subscribe_set(spark, d):
    return subscriptions.drained(subscriptions.of_streams(_stream(spark, d), ["ledger-189", "_index"]), "subscribe").select(*_COLUMNS)


@query("SELECT position, stream, type, version, timestamp, data FROM event_log WHERE starts_with(stream, 'account-')")
def subscribe_prefix(spark, d):
    return subscriptions.drained(subscriptions.of_pattern(_stream(spark, d), "account-*"), "subscribe").select(*_COLUMNS)


@query("""
WITH r AS (SELECT stream, version, position * 3 // (SELECT max(position) + 1 FROM event_log) AS batch FROM event_log WHERE stream IS NOT NULL AND version IS NOT NULL),
m AS (SELECT stream, batch, max(version) AS top FROM r GROUP BY 1, 2)
SELECT DISTINCT r.stream, r.version, r.batch FROM r WHERE version > coalesce((SELECT max(top) FROM m WHERE m.stream = r.stream AND m.batch < r.batch), -1)""")
def subscribe_high_water_batches(spark, d):
    """event_log as three files that come one after the other: each version once, and none below those of earlier batches."""
    path = scratch_path(spark, "high-water")
    log = table(spark, d, "event_log")
    top = log.agg(F.max("position").alias("p")).first()["p"]
    batch = F.expr(f"position * 3 div {(top or 0) + 1}")
    for n in range(3):
        log.filter(batch == n).select(*[f.name for f in LOG]).coalesce(1).write.mode("append").parquet(f"{path}/log")
    subscriptions.above_high_water(subscriptions.log_stream(spark, f"{path}/log", LOG, files_per_batch=1), path).awaitTermination()
    return subscriptions.high_water_output(spark, path).select("stream", "version", batch.cast("long").alias("batch"))


@query("SELECT DISTINCT stream, version FROM event_log WHERE starts_with(stream, 'account-') AND version IS NOT NULL")
def subscribe_high_water(spark, d):
    """Every version once, although rows are stored and delivered again (all present files are one batch)."""
    path = scratch_path(spark, "high-water")
    subscriptions.above_high_water(subscriptions.of_pattern(_stream(spark, d), "account-*"), path).awaitTermination()
    return subscriptions.high_water_output(spark, path).select("stream", "version")


@query(_LOG + f"""SELECT NULL AS link_stream, CAST(NULL AS INTEGER) AS link_version, {_ROW} FROM log
UNION ALL SELECT link_stream, link_version, {_ROW} FROM tl JOIN log ON ref = stream || '@' || version""")
def subscribe_links(spark, d):
    """Following the whole log, a link stream per type in it, with links resolved as they come."""
    path = scratch_path(spark, "subscribe")
    _linked(spark, d).write.parquet(f"{path}/log")
    log = spark.read.schema(LOG).parquet(f"{path}/log")
    return subscriptions.resolved(subscriptions.log_stream(spark, f"{path}/log", LOG), log, path, "error").select("link_stream", "link_version", *_COLUMNS)


@query("SELECT stream, count(*) AS n FROM event_log WHERE stream IN ('ledger-189', '_index') AND version IS NOT NULL GROUP BY stream")
def push_batches(spark, d):
    """Pushing to a callback that counts per stream and batch."""
    path = scratch_path(spark, "push")

    def count(batch: DataFrame, number: int) -> None:
        batch.filter(F.col("version").isNotNull()).groupBy("stream").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    subscriptions.push(subscriptions.of_streams(_stream(spark, d), ["ledger-189", "_index"]), count, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("stream").agg(F.sum("n").alias("n"))


# ---- scalar functions and predicates


@query("""SELECT position, CASE WHEN stream IS NULL OR version IS NULL THEN NULL ELSE stream || '@' || version END AS event_id, md5(data) AS digest,
CAST(octet_length(encode(coalesce(data, ''))) AS INTEGER) AS n_bytes, stream IS NULL OR trim(stream) = '' AS blank FROM event_log""")
def scalar_functions(spark, d):
    rows = table(spark, d, "event_log")
    known = F.col("stream").isNotNull() & F.col("version").isNotNull()
    return rows.select(
        "position",
        F.when(known, event_id(F.col("stream"), F.col("version"))).alias("event_id"),
        text.digest(F.col("data")).alias("digest"),
        F.octet_length(text.to_bytes(F.col("data"))).alias("n_bytes"),
        is_blank(F.col("stream")).alias("blank"),
    )


@query("SELECT position, type = '_>' AS link, starts_with(stream, '_') AS system_stream, starts_with(type, '_') AS system_type FROM event_log")
def system_predicates(spark, d):
    rows = table(spark, d, "event_log")
    return rows.select("position", is_link(F.col("type")).alias("link"), is_system_name(F.col("stream")).alias("system_stream"), is_system_name(F.col("type")).alias("system_type"))


@query("""SELECT position, CAST(data->>'$.logPosition' AS BIGINT) AS log_position, CAST(data->>'$.entries' AS INTEGER) AS entries FROM event_log WHERE type = '_INDEX_FLUSHED' AND json_valid(data)""")
def json_fields(spark, d):
    """Fields of a typed payload."""
    rows = table(spark, d, "event_log").filter(F.col("type") == "_INDEX_FLUSHED").select("position", json_object(F.col("data")).alias("v"))
    return rows.filter(F.col("v").isNotNull()).select("position", top_level(F.col("v"), "logPosition", "long").alias("log_position"), top_level(F.col("v"), "entries", "int").alias("entries"))


@query("SELECT name, metadata['owner'] AS value FROM stream_catalog")
def metadata_lookup(spark, d):
    return catalog.metadata_value(table(spark, d, "stream_catalog"), "owner")


@query("""
WITH n AS (SELECT position, (row_number() OVER (ORDER BY position) - 1) // 1000 AS flush_no FROM event_log)
SELECT '_index' AS stream, '_INDEX_FLUSHED' AS type, '{"logPosition":' || max(position) || ',"timeTaken":0,"entries":' || count(*) || '}' AS data FROM n GROUP BY flush_no HAVING count(*) = 1000""")
def flush_events(spark, d):
    return appending.flush_events(appending.flush_batches(table(spark, d, "event_log"), 1000)).select("stream", "type", "data")


@query("SELECT '_streams' AS stream, '_STREAM_CREATED' AS type, s AS name FROM (SELECT DISTINCT stream AS s FROM event_log WHERE stream IS NOT NULL AND stream NOT IN (SELECT name FROM stream_catalog))")
def creation_events(spark, d):
    new = appending.implicit_creates(table(spark, d, "stream_catalog"), table(spark, d, "event_log"))
    return appending.creation_events(new, NOW).select("stream", "type", top_level(json_object(F.col("data")), "name").alias("name"))


@query("SELECT position, stream, type, version, timestamp, data FROM event_log WHERE stream IS NOT NULL AND trim(stream) <> '' AND type IS NOT NULL AND trim(type) <> ''")
def named_events(spark, d):
    return reads.named(table(spark, d, "event_log")).select(*_COLUMNS)


@query("SELECT count(DISTINCT stream) AS n_names, count(DISTINCT stream) AS n_numbers, CAST(16 AS BIGINT) AS n_buckets, true AS even FROM event_log")
def hash_functions(spark, d):
    """Numbers and buckets of stream names: a number of its own for each, and no bucket with twice its share."""
    names = table(spark, d, "event_log").filter(F.col("stream").isNotNull()).select("stream").distinct()
    rows = names.select(text.stream_number(F.col("stream")).alias("n"), text.bucket(F.col("stream"), 16).alias("b"))
    per = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n_names"), F.count_distinct("n").alias("n_numbers"))
    even = F.max("n_names") * 16 <= 2 * F.sum("n_names") + 160
    return per.agg(F.sum("n_names").alias("n_names"), F.sum("n_numbers").alias("n_numbers"), F.count(F.lit(1)).alias("n_buckets"), even.alias("even"))


# ---- the older catalog, with repeated names

_CATALOG = """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created DESC NULLS LAST, CASE WHEN max_count > 0 THEN max_count ELSE 9223372036854775807 END,
           CASE WHEN max_age > 0 THEN max_age ELSE 9223372036854775807 END) AS r FROM stream_catalog) WHERE r = 1),
cur AS (SELECT stream, max(version) AS current FROM event_log WHERE stream IS NOT NULL GROUP BY stream)
"""


@query(_CATALOG + "SELECT name, created, max_count, coalesce(max_age, -1) AS max_age, CAST(coalesce(current, -1) AS INTEGER) AS version FROM c LEFT JOIN cur ON cur.stream = c.name")
def catalog_metadata(spark, d):
    """The older catalog, one row per name, with current versions of the log."""
    rows = catalog.streams_metadata(table(spark, d, "stream_catalog"), table(spark, d, "event_log"))
    return rows.select("name", "created", "max_count", F.coalesce("max_age", F.lit(-1)).alias("max_age"), "version")


@query(_CATALOG + """SELECT position, e.stream, version FROM event_log e LEFT JOIN c ON c.name = e.stream LEFT JOIN cur ON cur.stream = e.stream
WHERE (c.max_count IS NULL OR c.max_count <= 0 OR version > current - c.max_count) AND (c.max_age IS NULL OR c.max_age <= 0 OR (1767225600000 - timestamp) // 1000 <= c.max_age)""")
def retention_catalog(spark, d):
    """event_log under the limits of the older catalog, whose names repeat, at 2026-01-01."""
    return retention.retained(table(spark, d, "event_log"), table(spark, d, "stream_catalog"), 1_767_225_600_000).select("position", "stream", "version")


# ---- a stored log


def _stored(spark: SparkSession, d: str) -> EventStore:
    """A new store with the events of the table, appended in two batches, the later half by position last."""
    store = EventStore(spark, scratch_path(spark, "store"), clock=lambda: NOW, flush_entries=1000)
    log = _log(spark, d)
    half = log.agg((F.max("position") / 2).cast("long").alias("h")).first()["h"] or 0
    for part in (log.filter(F.col("position") <= half), log.filter(F.col("position") > half)):
        store.append(part.select("stream", "type", "data", "metadata", "position"))
    return store


@query(_LOG + "SELECT stream, version, type, data FROM log")
def store_append_read(spark, d):
    """What two appends have stored, with the versions the store gave."""
    return _stored(spark, d).from_all().filter(~is_system_name(F.col("stream"))).select("stream", "version", "type", "data")


@query(_LOG + "SELECT stream AS name, CAST(current AS INTEGER) AS version, 1706659200000 AS created FROM cur")
def store_reopen(spark, d):
    """The catalog and the current versions that a store finds when it is opened again."""
    again = EventStore(spark, _stored(spark, d).path)
    rows = again.catalog.join(again.versions().withColumnRenamed("stream", "name"), "name")
    return rows.select("name", "version", "created")


@query("""
WITH n AS (SELECT count(*) + count(DISTINCT user_id) AS n FROM events)
SELECT 1000 * k - 1 AS log_position, 1000 AS entries FROM n, range(1, 1000000) t(k) WHERE k <= n // 1000""")
def store_flushes(spark, d):
    """The index flushes that a store reports of itself, after one append of everything (the creation of each stream included)."""
    store = EventStore(spark, scratch_path(spark, "store"), clock=lambda: NOW, flush_entries=1000)
    store.append(_log(spark, d).select("stream", "type", "data", "metadata", "position"))
    v = json_object(F.col("data"))
    return store.log.filter(F.col("type") == INDEX_FLUSHED).select(top_level(v, "logPosition", "long").alias("log_position"), top_level(v, "entries", "int").alias("entries"))


@query(_LOG + "SELECT 'user-3' AS name, 5 AS max_count, CAST(99 AS BIGINT) AS max_age, 2 AS ann, 'sales' AS owner, CAST(count(*) - 1 AS INTEGER) AS version FROM log WHERE stream = 'user-3'")
def store_create_stream(spark, d):
    """A stream created with limits, permissions and metadata, then updated and appended to; what the catalog says of it."""
    store = EventStore(spark, scratch_path(spark, "store"), clock=lambda: NOW)
    store.create_stream("user-3", max_count=5, permissions={"ann": 2}, metadata={"owner": "sales"})
    store.update_stream("user-3", max_age=99)
    store.append(_log(spark, d).filter(F.col("stream") == "user-3").select("stream", "type", "data", "metadata", "position"))
    one = store.stream_metadata("user-3")
    return one.select("name", "max_count", "max_age", F.try_element_at("permissions", F.lit("ann")).alias("ann"), F.try_element_at("metadata", F.lit("owner")).alias("owner"), "version")


@query(_LOG + """SELECT 'copies' AS stream, CAST(row_number() OVER (ORDER BY position) - 1 AS INTEGER) AS version, type, data FROM log WHERE stream IN ('user-1', 'user-2') AND type = 'purchase'
UNION ALL SELECT 'links', CAST(row_number() OVER (ORDER BY position) - 1 AS INTEGER), '_>', stream || '@' || version FROM log WHERE stream IN ('user-1', 'user-2') AND type <> 'purchase'""")
def projection_emit(spark, d):
    """A projection whose handlers copy purchases to one stream of the store and link all other events in another."""
    store = EventStore(spark, scratch_path(spark, "store"), clock=lambda: NOW)
    store.append(_log(spark, d).filter(F.col("stream").isin("user-1", "user-2")).select("stream", "type", "data", "metadata", "position"))

    def handle(state: dict, event: dict, out: P.Outbox) -> dict:
        if event["type"] == "purchase":
            out.emit("copies", event)
        else:
            out.link_to("links", event)
        return {"n": state["n"] + 1}

    store.project(["user-1", "user-2"], {"n": 0}, {P.ANY: handle})
    return store.log.filter(F.col("stream").isin("copies", "links")).select("stream", "version", "type", "data")


@query(_LOG + "SELECT type, count(*) AS n FROM log WHERE stream IN ('user-1', 'user-2') GROUP BY type")
def store_subscription(spark, d):
    """Events of two streams of a store pushed to a callback that counts them."""
    store, path = _stored(spark, d), scratch_path(spark, "push")

    def count(batch: DataFrame, number: int) -> None:
        batch.groupBy("type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    store.subscribe(["user-1", "user-2"], count, f"{path}/checkpoint").awaitTermination()
    store.close()
    return spark.read.parquet(f"{path}/out").groupBy("type").agg(F.sum("n").alias("n"))


@query(_LOG + "SELECT type, count(*) AS n, max(position) AS last FROM log GROUP BY type")
def projection_registry(spark, d):
    """A projection run by its name, its state written and read again."""
    registry, path = P.Registry(), scratch_path(spark, "state")
    registry.add("by type", lambda log: log.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last")))
    (name,) = registry.names()
    for _ in range(2):  # the second run replaces the first
        P.persist(registry.run(name, _log(spark, d)), path)
    return spark.read.parquet(path)


@query(_LOG + "SELECT CAST(sum(length(type)) AS BIGINT) AS letters, arg_max(type, position) AS last FROM log")
def projection_fold_all(spark, d):
    """One state over the whole log in position order, folded by ranges and merged."""
    add = lambda state, event: {"letters": state["letters"] + len(event["type"]), "last": event["type"]}
    both = lambda a, b: {"letters": a["letters"] + b["letters"], "last": b["last"] or a["last"]}
    state = P.fold_all(_log(spark, d), {"letters": 0, "last": None}, {P.ANY: add}, both)
    return spark.createDataFrame([(state["letters"], state["last"])], "letters long, last string")
