"""Subscriptions: following the log with Structured Streaming.

The log's folder is the source; which files were read is in the checkpoint, so a subscription goes on where it stopped.
`availableNow` reads up to the present head of the log and ends; a processing-time trigger goes on for good.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidelog.functions.names import matches_pattern
from tidelog.operators.links import resolve
from tidelog.schema import LOG
from tidelog.session import hadoop, scratch_path


def log_stream(spark: SparkSession, path: str, schema: StructType = LOG, position: int | None = None, files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream of rows, from a position on."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(path)
    return rows if position is None else rows.filter(F.col("position") >= position)


def of_streams(rows: DataFrame, streams: list[str]) -> DataFrame:
    return rows.filter(F.col("stream").isin(sorted(set(streams))))


def of_pattern(rows: DataFrame, pattern: str) -> DataFrame:
    """Streams that match when their events arrive; streams created later are included."""
    return rows.filter(matches_pattern(F.col("stream"), pattern))


def above_high_water(rows: DataFrame, path: str, once: bool = True, every: str = "2 seconds") -> StreamingQuery:
    """Emit rows whose version exceeds every version of their stream in earlier batches: repeats and late ones are dropped.

    Within a batch every (stream, version) comes once (the copy with the smallest position). Rows without stream or
    version are never emitted. The high-water marks are a small relation beside the output: each batch joins those of the
    batches before it, emits, and adds the marks of the streams it moved. Output and marks are written per batch number,
    so a batch that is repeated after a failure replaces itself. high_water_output() reads what was emitted.
    """
    fields = [f.name for f in LOG]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.filter(F.col("stream").isNotNull() & F.col("version").isNotNull())
        first = kept.groupBy("stream", "version").agg(F.min(F.struct("position", *[f for f in fields if f not in ("stream", "version", "position")])).alias("r"))
        new = first.select("stream", "version", "r.*").select(*fields)
        if number > 0:
            before = _marks(spark, path).filter(F.col("batch") < number).groupBy("stream").agg(F.max("mark").alias("mark"))
            new = new.join(before, "stream", "left").filter(F.col("mark").isNull() | (F.col("version") > F.col("mark"))).drop("mark")
        new.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        emitted = spark.read.schema(LOG).parquet(f"{path}/out/batch={number}")
        emitted.groupBy("stream").agg(F.max("version").alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("stream string, mark int, batch int").parquet(f"{path}/marks")


def high_water_output(spark: SparkSession, path: str) -> DataFrame:
    """What above_high_water() emitted into path."""
    return spark.read.schema(StructType([*LOG.fields, StructField("batch", IntegerType())])).parquet(f"{path}/out").select(*[f.name for f in LOG])


def push(rows: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, log: DataFrame | None = None, once: bool = True, every: str = "2 seconds") -> StreamingQuery:
    """Hand every micro-batch to callback(batch, batch number), sorted by stream and version over its partitions.

    With a log (re-read for every batch) links are resolved; link_stream and link_version then tell which row it was.
    A batch may come again after a failure, with the same number.
    """

    def run(batch: DataFrame, number: int) -> None:
        if log is not None:
            batch = resolve(batch, log, on_missing="drop")
        # by ranges, so that a hot stream is split and its parts are in order
        callback(batch.repartitionByRange("stream", "version").sortWithinPartitions("stream", "version"), number)

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def poll(query: StreamingQuery, seconds: float) -> bool:
    """Let a subscription that goes on for good run for a limited time, then stop it; whether it ended by itself. What it has
    not handled comes again at the next start from its checkpoint."""
    ended = query.awaitTermination(seconds)
    query.stop()
    return bool(ended)


def resolved(rows: DataFrame, log: DataFrame, path: str, on_missing: str = "drop") -> DataFrame:
    """Run a stream up to the present head of its source with links resolved: what came, with link_stream and link_version.

    Every batch is resolved against the log as it then is and written by its number, so a repeated batch replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        resolve(batch, log, on_missing).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*log.schema.fields, StructField("link_stream", StringType()), StructField("link_version", IntegerType())])
    found = hadoop(rows.sparkSession, f"{path}/out")
    if not found[0].exists(found[1]):
        return rows.sparkSession.createDataFrame([], schema)
    return rows.sparkSession.read.schema(schema).parquet(f"{path}/out/batch=*")


def drained(rows: DataFrame, label: str) -> DataFrame:
    """Run a stream up to the present head of its source into the shared folder; what it emitted."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    query = rows.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/data")
