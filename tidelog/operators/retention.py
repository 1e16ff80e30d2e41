"""Retention views: the newest max_count events of a stream, and events no older than max_age seconds.

The limits are one small relation (stream, lowest version kept, age), joined to the log once. It holds only streams that
have a limit; if it is small it is broadcast and the log isn't shuffled at all, else the join is left to AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import small_side

VERSION_LIMIT = "__from_version"
AGE_LIMIT = "__max_age"


def current_versions(log: DataFrame) -> DataFrame:
    """stream, version: the greatest version of each stream (partly aggregated before the shuffle)."""
    return log.filter(F.col("stream").isNotNull()).groupBy("stream").agg(F.max("version").alias("version"))


def within_age(age: Column, now_ms: int) -> Column:
    """Whether an event is young enough: null, 0 and negative ages keep all; whole seconds, so up to age + 999 ms."""
    return age.isNull() | (age <= 0) | (F.expr(f"({now_ms} - timestamp) div 1000") <= age)


def one_per_name(catalog: DataFrame) -> DataFrame:
    """Of the rows of a repeated name the latest created counts; of those the one with the least max_count, then max_age
    (no limit being the greatest). Null creation times come last."""
    rank = F.struct(
        F.col("created").isNotNull().alias("a"), F.coalesce("created", F.lit(0)).alias("b"),
        *[-F.when(F.col(c) > 0, F.col(c)).otherwise(2**63 - 1).cast("long") for c in ("max_count", "max_age")],
    )
    rest = [c for c in catalog.columns if c != "name"]
    return catalog.groupBy("name").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("name", "r.*")


def limits(log: DataFrame, catalog: DataFrame, count: bool, age: bool) -> DataFrame:
    """stream, first version kept (null: all), max age (null: any) of the streams that have a limit."""
    created = F.col("created") if "created" in catalog.columns else F.lit(None).cast("long").alias("created")
    cat = one_per_name(catalog.select("name", created, "max_count", "max_age")).withColumnRenamed("name", "stream")
    has_count = F.coalesce(F.col("max_count") > 0, F.lit(False)) if count else F.lit(False)
    has_age = F.coalesce(F.col("max_age") > 0, F.lit(False)) if age else F.lit(False)
    cat = cat.filter(has_count | has_age)
    if count:
        cat = cat.join(current_versions(log).withColumnRenamed("version", "current"), "stream", "left")
        first = F.when(has_count, F.col("current") - F.col("max_count") + 1)
    else:
        first = F.lit(None).cast("int")
    return cat.select("stream", first.alias(VERSION_LIMIT), F.when(has_age, F.col("max_age")).alias(AGE_LIMIT))


def retained(log: DataFrame, catalog: DataFrame, now_ms: int, count: bool = True, age: bool = True, few: bool = False) -> DataFrame:
    """The log's rows that both limits of their stream keep. Streams without a catalog row have no limit.

    few: the catalog is filtered by a list of names, so its one row per name is broadcast unseen and nothing runs before
    the read itself.
    """
    limit = limits(log, catalog, count, age)
    joined = log.join(F.broadcast(limit) if few else small_side(limit, "limits"), "stream", "left")
    keep = (F.col(VERSION_LIMIT).isNull() | (F.col("version") >= F.col(VERSION_LIMIT))) & within_age(F.col(AGE_LIMIT), now_ms)
    return joined.filter(keep).select(*log.columns)


def max_count(log: DataFrame, catalog: DataFrame) -> DataFrame:
    return retained(log, catalog, 0, age=False)


def max_age(log: DataFrame, catalog: DataFrame, now_ms: int, few: bool = False) -> DataFrame:
    return retained(log, catalog, now_ms, count=False, few=few)


def scavenge(log: DataFrame, catalog: DataFrame, deleted: DataFrame, now_ms: int) -> DataFrame:
    """What a rewrite keeps: streams that aren't deleted (column `name`), then the read-side limits."""
    gone = deleted.select(F.col("name").alias("stream")).distinct()
    return retained(log.join(small_side(gone, "deleted"), "stream", "left_anti"), catalog, now_ms)
