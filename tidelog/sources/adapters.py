"""Event logs made from other tables: the canonical LOG schema over events, orders and lineitem.

A log is materialised once per session and state of the source's files, clustered by stream and version, so that later reads push
stream and version filters into the Parquet scan instead of deriving names and versions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.chunking import number_rows
from tidelog.schema import LINK_TYPE, NO_LIMIT
from tidelog.session import hadoop, scratch_path
from tidelog.sources.tables import file_stamps, table

#: The moment that retention is measured at in queries over `events`: 2024-01-31T00:00:00Z, after all of them.
EVENTS_NOW = 1_706_659_200_000
_MADE: dict[tuple, str] = {}


def _ms(column: str) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def _once(spark: SparkSession, kind: str, d: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, kind, d, file_stamps(spark, f"{d}/{kind.partition('-')[0]}.parquet"))
    if key not in _MADE or not _there(spark, _MADE[key]):
        path = scratch_path(spark, kind)
        make().write.parquet(path)
        _MADE[key] = path
    return spark.read.parquet(_MADE[key])


def _there(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop(spark, path)
    return fs.exists(at)


def with_versions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Dense versions from 0 per stream in the order given, numbered without bringing a stream together in one task."""
    numbered = number_rows(rows, "stream", order)
    return numbered.withColumn("version", (F.col("row_no") - 1).cast("int")).drop("row_no")


def clustered(log: DataFrame) -> DataFrame:
    return log.repartitionByRange("stream", "version").sortWithinPartitions("stream", "version")


def events_log(spark: SparkSession, d: str) -> DataFrame:
    """stream user-<id>, position event_id, version by position, timestamp ms, data props."""

    def make() -> DataFrame:
        e = table(spark, d, "events")
        rows = e.select(F.col("event_id").alias("position"), F.concat(F.lit("user-"), F.col("user_id")).alias("stream"), F.col("event_type").alias("type"), _ms("ts").alias("timestamp"), F.col("props").alias("data"))
        log = with_versions(rows, ["position"]).withColumn("metadata", F.lit(None).cast("string"))
        return clustered(log.select("position", "stream", "type", "version", "timestamp", "data", "metadata"))

    return _once(spark, "events-log", d, make)


def events_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A catalog for events_log: max_count 10 for every third user, max_age two days for every fifth."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.min(_ms("ts")).alias("created"))
    return e.select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("name"),
        "created",
        F.when(F.col("user_id") % 5 == 0, 172_800).otherwise(NO_LIMIT).cast("long").alias("max_age"),
        F.when(F.col("user_id") % 3 == 0, 10).otherwise(NO_LIMIT).cast("int").alias("max_count"),
        F.lit(0).alias("state"),
        F.create_map(F.lit("reader"), F.lit(1)).alias("permissions"),
        F.create_map(F.lit("source"), F.lit("events")).alias("metadata"),
    )


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    """stream customer-<key>, position by (date, order), type order status, data as JSON."""

    def make() -> DataFrame:
        o = table(spark, d, "orders").select("*", F.lit("all").alias("one"), _ms("o_orderdate").alias("timestamp"))
        o = number_rows(o, "one", ["timestamp", "o_orderkey"]).withColumn("position", F.col("row_no") - 1).drop("row_no", "one")
        rows = o.select("position", F.concat(F.lit("customer-"), F.col("o_custkey")).alias("stream"), F.col("o_orderstatus").alias("type"), "timestamp", F.to_json(F.struct("o_orderkey", "o_orderpriority")).alias("data"))
        return clustered(with_versions(rows, ["position"]).withColumn("metadata", F.lit(None).cast("string")).select("position", "stream", "type", "version", "timestamp", "data", "metadata"))

    return _once(spark, "orders-log", d, make)


def lineitem_log(spark: SparkSession, d: str) -> DataFrame:
    """stream order-<key>, position by the six columns that identify a row, type return flag; quantity and price stay typed."""

    def make() -> DataFrame:
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
        l = table(spark, d, "lineitem").select(*order, "l_returnflag", "l_quantity", F.lit("all").alias("one"))  # noqa: E741
        l = number_rows(l, "one", order).withColumn("position", F.col("row_no") - 1).drop("row_no", "one")  # noqa: E741
        rows = l.select("position", F.concat(F.lit("order-"), F.col("l_orderkey")).alias("stream"), F.col("l_returnflag").alias("type"), _ms("l_shipdate").alias("timestamp"), "l_quantity", "l_extendedprice")
        return clustered(with_versions(rows, ["position"]))

    return _once(spark, "lineitem-log", d, make)


def type_links(log: DataFrame) -> DataFrame:
    """One link stream per event type, type-<type>, with a link to every event of it."""
    rows = log.select("position", F.concat(F.lit("type-"), F.col("type")).alias("stream"), F.lit(LINK_TYPE).alias("type"), "timestamp", F.concat_ws("@", "stream", "version").alias("data"))
    linked = with_versions(rows, ["position"]).withColumn("metadata", F.lit(None).cast("string"))
    return linked.select("position", "stream", "type", "version", "timestamp", "data", "metadata")
