"""A stored event log: one Parquet folder per store, written in batches, read as DataFrames.

Layout: `<path>/log` holds the events. Appends are whole batches by one writer: each is validated, numbered after the
present versions and positions, and added by one Spark write, whose commit makes it visible at once. System events (stream
creation, updates, deletes, index flushes) go through the same path, so the catalog is a query over the log.

`<path>/index` holds flushed versions: the current version of every stream up to a position, each in a folder that a commit
file names. What an append must know of the past is that table and the log's rows behind its position, which the file
statistics of `position` pick out; so the log isn't scanned for it. When a full flush of entries has been appended, an
`_INDEX_FLUSHED` event says so and the table is written anew. The table is only a cache: if a writer dies before its
commit, the rows behind the older position are read instead.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.json import json_object, top_level
from tidelog.operators import appending, catalog, links, maintenance, reads, retention
from tidelog.operators.incremental import Commits
from tidelog.plans import projections
from tidelog.schema import INDEX_FLUSHED, LOG, STREAM_DELETED, STREAM_UPDATED, STREAMS_STREAM
from tidelog.session import hadoop, small_side, written
from tidelog.streaming import subscriptions

COLUMNS = ["stream", "type", "data", "metadata"]


class EventStore:
    """Reads, appends, links, catalog and subscriptions of one stored log. clock gives epoch milliseconds."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], int] = lambda: int(time.time() * 1000), flush_entries: int = appending.FLUSH_ENTRIES):
        if flush_entries < appending.LEAST_FLUSH_ENTRIES:
            raise ValueError(f"a flush has at least {appending.LEAST_FLUSH_ENTRIES} entries")
        self.spark, self.path, self.clock, self.flush_entries = spark, path.rstrip("/"), clock, flush_entries
        self._versions: DataFrame | None = None
        self._queries: list[StreamingQuery] = []
        self._index = Commits(spark, f"{self.path}/index")
        fs, at = hadoop(spark, f"{self.path}/log")
        if not fs.exists(at):
            spark.createDataFrame([], LOG).write.mode("append").parquet(f"{self.path}/log")

    @property
    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    @property
    def catalog(self) -> DataFrame:
        return catalog.replay(self.log)

    # ---- what an append must know

    def _tail(self) -> tuple[DataFrame, DataFrame | None, int]:
        """The log's rows behind the flushed versions, these versions (None: nothing is flushed), and their position."""
        last = self._index.last()
        if last is None:
            return self.log, None, -1
        flushed = self.spark.read.schema("stream string, version int").parquet(last["folder"])
        return self.log.filter(F.col("position") > last["position"]), flushed, last["position"]

    def _known_versions(self, streams: DataFrame | None = None) -> DataFrame:
        """stream, version: current versions, of some streams (column stream) or all."""
        tail, flushed, _ = self._tail()
        rows = tail.select("stream", "version")
        if flushed is not None:
            rows = rows.unionByName(flushed)
        if streams is not None:
            rows = rows.join(small_side(streams.select("stream").distinct(), "streams"), "stream", "left_semi")
        return retention.current_versions(rows)

    # ---- writing

    def _write(self, batch: DataFrame) -> None:
        """Add rows (COLUMNS and ordinal, their order) in one write."""
        tail, _, flushed = self._tail()
        head = tail.agg(F.coalesce(F.max("position"), F.lit(flushed)).alias("p")).first()["p"]
        batch = batch.select(*COLUMNS, "ordinal")
        done = appending.append_versions(self.log, batch, prior=self._known_versions(batch), head=head).withColumn("timestamp", F.lit(self.clock()))
        done.select(*[F.col(f.name).cast(f.dataType) for f in LOG]).sortWithinPartitions("stream", "version").write.mode("append").parquet(f"{self.path}/log")

    def _flush(self) -> None:
        """Report every full flush of entries since the last one, and write the versions up to it."""
        tail, versions, flushed = self._tail()
        told = tail.filter(F.col("type") == INDEX_FLUSHED).agg(F.max(top_level(json_object(F.col("data")), "logPosition", "long")).alias("p")).first()["p"]
        start = max(flushed, -1 if told is None else told)
        pending = tail.filter(F.col("position") > start)
        if pending.count() >= self.flush_entries:
            new = written(appending.flush_batches(pending, self.flush_entries), "flushes")
            start = new.agg(F.max("log_position").alias("p")).first()["p"]
            self._write(written(appending.flush_events(new), "append"))
        if start > flushed:
            rows = tail.filter(F.col("position") <= start).select("stream", "version")
            rows = rows if versions is None else rows.unionByName(versions)
            number, folder = self._index.next_folder()
            retention.current_versions(rows).write.parquet(folder)
            self._index.publish(number, {"number": number, "folder": folder, "position": start})

    def append(self, events: DataFrame, expected: dict[str, int] | None = None, system: bool = False) -> None:
        """Append events (stream, type, data, metadata) in their order; time and version are the store's.

        The order is the column `ordinal` or else `position` if there is one, else that of the DataFrame's partitions.
        expected: the current version that each stream must have (negative: unchecked); a conflict appends nothing.
        Streams that don't exist are created first.
        """
        order = next((F.col(c).cast("long") for c in ("ordinal", "position") if c in events.columns), F.monotonically_increasing_id())
        events = written(events.select(*COLUMNS, order.alias("ordinal")), "append")
        bad = appending.invalid_rows(events, system).limit(1).collect()
        if bad:
            raise ValueError(bad[0]["reason"])
        if expected:
            wanted = self.spark.createDataFrame(list(expected.items()), "stream string, expected int")
            conflict = appending.version_conflicts(self.log, wanted, self._known_versions(wanted)).limit(1).collect()
            if conflict:
                raise ValueError(f"{conflict[0]['stream']} is at version {conflict[0]['current']}, not {conflict[0]['expected']}")
        new = appending.creation_events(appending.implicit_creates(self.catalog, events), self.clock())
        first = events.agg(F.min("ordinal").alias("o")).first()["o"] or 0
        before = new.withColumn("ordinal", F.lit(first) - 1 - F.monotonically_increasing_id())
        self._write(written(before.select(*COLUMNS, "ordinal").unionByName(events), "append"))
        self._flush()

    def _write_system(self, rows: DataFrame) -> None:
        self._write(written(rows.select(*COLUMNS, F.monotonically_increasing_id().alias("ordinal")), "append"))
        self._flush()

    def _one(self, kind: str, body: Column) -> None:
        """Append one event to the stream of catalog changes."""
        self._write_system(self.spark.range(1).select(F.lit(STREAMS_STREAM).alias("stream"), F.lit(kind).alias("type"), body.alias("data"), F.lit(None).cast("string").alias("metadata")))

    def create_stream(self, name: str, max_count: int = -1, max_age: int = -1, permissions: dict[str, int] | None = None, metadata: dict[str, str] | None = None) -> None:
        """Add a creation event. Of several for one name the first counts, until the stream is deleted."""
        one = self.spark.createDataFrame([(name,)], "stream string")
        self._write_system(appending.creation_events(one, self.clock(), max_count, max_age, permissions, metadata))

    def update_stream(self, name: str, max_count: int | None = None, max_age: int | None = None, permissions: dict[str, int] | None = None, metadata: dict[str, str] | None = None) -> None:
        """Change what is given of an existing stream."""
        fields = {"name": name, "maxCount": max_count, "maxAge": max_age, "permissions": permissions, "metadata": metadata}
        self._one(STREAM_UPDATED, F.lit(json.dumps({k: v for k, v in fields.items() if v is not None})))

    def delete_stream(self, name: str) -> None:
        self._one(STREAM_DELETED, F.lit(json.dumps({"stream": name, "versionAtDeletion": self.version(name)})))

    def project(self, streams: list[str], initial: dict, handlers: dict) -> DataFrame:
        """Fold streams in order with handlers that may emit and link (see projections.fold_emitting()), append what they
        sent, and return stream, state."""
        rows = projections.fold_emitting(reads.from_streams(self.log, self.catalog, streams, self.clock()), initial, handlers)
        rows = written(rows, "projection")
        sent = rows.filter(F.col("what") != "state")
        if not sent.isEmpty():
            self.append(sent.select(F.col("target").alias("stream"), "type", "data", "metadata", F.col("position").alias("ordinal")), system=True)
        return rows.filter(F.col("what") == "state").select("stream", "state")

    def link_to(self, stream: str, events: DataFrame) -> None:
        self.append(self._copied(links.link_to, events, stream), system=True)

    def emit(self, stream: str, events: DataFrame) -> None:
        self.append(self._copied(links.emit, events, stream))

    @staticmethod
    def _copied(how: Callable[[DataFrame, str], DataFrame], events: DataFrame, stream: str) -> DataFrame:
        """What link_to or emit makes of events, in order of their position if they have one."""
        order = F.col("position") if "position" in events.columns else F.monotonically_increasing_id()
        return how(events.withColumn("ordinal", order), stream)

    # ---- reading

    def from_all(self, backward: bool = False) -> DataFrame:
        return reads.from_all(self.log, backward)

    def from_stream(self, stream: str, version: int = 0) -> DataFrame:
        return reads.from_stream(self.log, self.catalog, stream, self.clock(), version)

    def zip_streams(self, streams: list[str]) -> DataFrame:
        return reads.zip_streams(self.log, self.catalog, streams, self.clock())

    def zip_prefix(self, pattern: str) -> DataFrame:
        return reads.zip_prefix(self.log, self.catalog, pattern, self.clock())

    def from_streams(self, streams: list[str]) -> DataFrame:
        return reads.from_streams(self.log, self.catalog, streams, self.clock())

    def streams_mapped(self, streams: list[str]) -> dict[str, DataFrame]:
        return reads.streams_mapped(self.log, self.catalog, streams, self.clock())

    def get(self, stream: str, version: int) -> DataFrame:
        return reads.get_event(self.log, stream, version)

    def at_position(self, position: int) -> DataFrame:
        return reads.at_position(self.log, position)

    def keys(self) -> DataFrame:
        return reads.keys(self.log)

    def version(self, stream: str) -> int:
        """The current version of a stream, -1 without events; from the flushed versions and the rows behind them."""
        one = self.spark.createDataFrame([(stream,)], "stream string")
        found = self._known_versions(one).first()
        return -1 if found is None or found["version"] is None else found["version"]

    def versions(self, refresh: bool = False) -> DataFrame:
        """The current version of every stream, cached until refreshed or closed."""
        if self._versions is None or refresh:
            if self._versions is not None:
                self._versions.unpersist()
            self._versions = self._known_versions().cache()
        return self._versions

    def streams_metadata(self) -> DataFrame:
        return catalog.streams_metadata(self.catalog, self.log)

    def stream_metadata(self, name: str) -> DataFrame:
        return catalog.stream_metadata(self.catalog, self.log, name)

    # ---- maintenance and subscriptions

    def compacted(self, path: str) -> EventStore:
        """A copy of the store at another path that keeps what retention keeps, system events included, sorted for reading."""
        kept = retention.retained(self.log, self.catalog, self.clock())
        kept.repartitionByRange("stream", "version").sortWithinPartitions("stream", "version").write.parquet(f"{path}/log")
        return EventStore(self.spark, path, self.clock)

    def stream(self, position: int | None = None, files_per_batch: int | None = None) -> DataFrame:
        return subscriptions.log_stream(self.spark, f"{self.path}/log", LOG, position, files_per_batch)

    def subscribe(self, streams: list[str], callback: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
        """Push the events of some streams, also through links, to callback; see subscriptions.push()."""
        query = subscriptions.push(subscriptions.of_streams(self.stream(), streams), callback, checkpoint, self.log, once)
        self._queries.append(query)
        return query

    def poll(self, streams: list[str], callback: Callable[[DataFrame, int], None], checkpoint: str, seconds: float) -> None:
        """Push the events of some streams as they come, for a limited time."""
        subscriptions.poll(self.subscribe(streams, callback, checkpoint, once=False), seconds)

    def subscribe_all(self, callback: Callable[[DataFrame, int], None], checkpoint: str, position: int | None = None, once: bool = True) -> StreamingQuery:
        """Push every event from a position on, links resolved as they come."""
        query = subscriptions.push(self.stream(position), callback, checkpoint, self.log, once)
        self._queries.append(query)
        return query

    def dump(self, path: str) -> None:
        """The whole log as text lines in position order."""
        maintenance.dump_log(reads.from_all(self.log)).write.text(path)

    def close(self) -> None:
        """Stop the subscriptions started here and drop what is cached."""
        for query in self._queries:
            query.stop()
        self._queries.clear()
        if self._versions is not None:
            self._versions.unpersist()
            self._versions = None
