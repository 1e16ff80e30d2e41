"""Applying a change feed: files of inserts and of equality deletes, with sequence numbers.

As in merge-on-read tables, changes are never applied one after the other. Each batch of changes is appended as files:
inserts (created and updated, each with the sequence number of its change) apart from deletes (key and sequence number),
both made visible by one commit. The reader takes the files of all commits and drops every row that a delete with the
same key and a later sequence number covers, by an anti-join; what is left of a key is its present life: the first
creation in it and the updates after that.

A delete makes its key absent whether or not it existed, so the greatest delete of a key covers all the others, and the
delete side has one row per key after a map-side aggregate. Order of arrival, repeats and re-delivery don't matter. Joins
go through join_by_key(), so a key with any share of the changes doesn't concentrate.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.functions.json import is_object, json_object, top_level
from tidelog.operators.incremental import Commits
from tidelog.schema import STREAM_CREATED, STREAM_DELETED, STREAM_UPDATED, STREAMS_STREAM
from tidelog.session import join_by_key, scratch_path, written

#: Fields of a catalog change: name in the JSON text, column, type.
FIELDS = (("hash", "hash", "long"), ("created", "created", "long"), ("maxAge", "max_age", "long"), ("maxCount", "max_count", "int"), ("state", "state", "int"), ("permissions", "permissions", "map<string,int>"), ("metadata", "metadata", "map<string,string>"))


class ChangeFiles:
    """Committed change files of one table below a path: inserts (seq, op, key, fields) and equality deletes (key, seq)."""

    def __init__(self, spark: SparkSession, path: str):
        self.commits = Commits(spark, path)
        self.spark = spark

    def append(self, changes: DataFrame) -> ChangeFiles:
        """Append one batch (seq, op `created`, `updated` or `deleted`, key, fields) in any order; other operations are passed over.

        One write makes the files of both kinds, one commit file makes them visible. The batch's number is that of the commit.
        """
        kind = F.when(F.col("op").isin("created", "updated"), "insert").when(F.col("op") == "deleted", "delete")
        rows = changes.withColumn("kind", kind).filter(F.col("kind").isNotNull())
        number, folder = self.commits.next_folder()
        rows.write.partitionBy("kind").parquet(folder)
        self.commits.publish(number, {"number": number, "folder": folder, "schema": rows.drop("kind").schema.json()})
        return self

    def _rows(self, kind: str) -> DataFrame:
        """The rows of one kind; of rows with the same sequence number in several batches the first batch's counts."""
        made = self.commits.all()
        if not made:
            return self.spark.createDataFrame([], "seq int, op string, key string")
        schema = StructType.fromJson(json.loads(made[-1]["schema"]))
        folders = [f"{c['folder']}/kind={kind}" for c in made]
        present = [f for f in folders if self.commits.exists(f)]
        if not present:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*present)
        if len(made) == 1:
            return rows
        body = F.struct(*schema.names)
        return rows.groupBy("seq").agg(F.min_by(body, self.commits.number_of_file()).alias("b")).select("b.*")

    def inserts(self) -> DataFrame:
        return self._rows("insert")

    def deletes(self) -> DataFrame:
        """key, seq: the greatest delete of each key."""
        return self._rows("delete").groupBy("key").agg(F.max("seq").alias("seq"))


def catalog_changes(log: DataFrame) -> DataFrame:
    """The readable changes in the `_streams` stream of an event log: key, seq, op and the fields that a change sets.

    Rows count once per version (copies of one version are equal; of unequal ones the readable one stored first counts).
    Left out: a null version, other types, data that is no JSON object (null, empty, truncated, lists), and objects
    without the text `name` (deleted: `stream`).
    """
    kind = {STREAM_CREATED: "created", STREAM_UPDATED: "updated", STREAM_DELETED: "deleted"}
    rows = log.filter((F.col("stream") == STREAMS_STREAM) & F.col("version").isNotNull() & F.col("type").isin(*kind)).select(
        F.col("version").alias("seq"), "position", "type", json_object(F.col("data")).alias("v")
    )
    op = F.coalesce(*[F.when(F.col("type") == t, F.lit(o)) for t, o in kind.items()])
    key = F.when(F.col("type") == STREAM_DELETED, top_level(F.col("v"), "stream")).otherwise(top_level(F.col("v"), "name"))
    rows = rows.filter(is_object(F.col("v"))).select("seq", "position", op.alias("op"), key.alias("key"), *[top_level(F.col("v"), j, t).alias(c) for j, c, t in FIELDS])
    rows = rows.filter(F.col("key").isNotNull())
    body = F.struct("op", "key", *[c for _, c, _ in FIELDS])
    return rows.groupBy("seq").agg(F.min_by(body, F.coalesce("position", F.lit(2**63 - 1))).alias("b")).select("seq", "b.*")


def change_files(changes: DataFrame, path: str | None = None) -> ChangeFiles:
    """The files of one batch, in a new place of the shared folder unless a path is given."""
    spark = changes.sparkSession
    return ChangeFiles(spark, path or scratch_path(spark, "changes")).append(changes)


def surviving(files: ChangeFiles) -> DataFrame:
    """Inserts that no later delete of their key covers; written once."""
    later = F.col("r.seq") > F.col("l.seq")
    return written(join_by_key(files.inserts(), files.deletes(), ["key"], "left_anti", later), "surviving")


def current_state(files: ChangeFiles, fields: tuple[str, ...] = tuple(c for _, c, _ in FIELDS)) -> DataFrame:
    """The keys that exist at the end: key, first_seq (their creation), last_seq (last change that took effect), fields.

    Of a key's surviving rows the first creation takes effect; later creations don't, and updates only after it. A field
    has the value that the last change setting it gave. Hot keys are combined before the shuffle (aggregates only).
    """
    rows = surviving(files)
    first = rows.filter(F.col("op") == "created").groupBy("key").agg(F.min("seq").alias("first_seq"))
    # an update before the creation must not count, so the creation is joined back
    return _folded(join_by_key(rows.select("key", "seq", "op", *fields), first, ["key"], "inner"), fields)


def state_of(changes: DataFrame, fields: tuple[str, ...] = tuple(c for _, c, _ in FIELDS)) -> DataFrame:
    """The same as current_state(), lazily and without files: for a catalog, whose keys have few changes each."""
    rows = changes.filter(F.col("op").isin("created", "updated")).alias("l")
    gone = changes.filter(F.col("op") == "deleted").groupBy("key").agg(F.max("seq").alias("seq")).alias("r")
    rows = rows.join(gone, (F.col("l.key") == F.col("r.key")) & (F.col("r.seq") > F.col("l.seq")), "left_anti")
    first = rows.filter(F.col("op") == "created").groupBy("key").agg(F.min("seq").alias("first_seq"))
    return _folded(rows.select("key", "seq", "op", *fields).join(first, "key"), fields)


def _folded(live: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    created = F.col("op") == "created"
    live = live.filter((created & (F.col("seq") == F.col("first_seq"))) | (~created & (F.col("seq") > F.col("first_seq"))))
    return live.groupBy("key").agg(
        F.min("first_seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields],
    )


def lifetimes(changes: DataFrame) -> DataFrame:
    """Validity of each key that existed at some time: key, valid_from (first creation), valid_to (null: exists at the end).

    The first creation of a key always takes effect. A key exists at the end if a creation follows its last delete.
    """
    per = changes.groupBy("key").agg(
        F.min(F.when(F.col("op") == "created", F.col("seq"))).alias("valid_from"),
        F.max(F.when(F.col("op") == "created", F.col("seq"))).alias("last_created"),
        F.max(F.when(F.col("op") == "deleted", F.col("seq"))).alias("last_deleted"),
    )
    gone = F.col("last_deleted") > F.col("last_created")
    return per.filter(F.col("valid_from").isNotNull()).select("key", "valid_from", F.when(gone, F.col("last_deleted")).alias("valid_to"))
