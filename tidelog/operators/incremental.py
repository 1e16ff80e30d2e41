"""Processing only what was added or changed since the last successful run.

The watermark of a segment is the greatest time up to which a successful run has read it. A run fixes its upper limit when
it starts, takes the entries between watermark and limit, and publishes output and new watermarks together: both are
written to a folder of the run's own, and one commit file, created only if it is absent and never replaced, names that
folder, the limit and the number of the commit. What no commit names doesn't exist for readers, so a failed run is simply
repeated.

A run starts from the rows behind the watermarks. History is scanned for the states of their keys alone, which a
semi-join picks out before anything is shuffled, so the shuffle is in proportion to what is new.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.session import hadoop, local_path, small_side, written

ENTRY = ("stream", "version", "position", "segment_no", "written_at")


def segment_marks(runs: DataFrame) -> DataFrame:
    """segment_no, mark. A run counts if its report with the greatest report_no says ok in any letter case.

    Repeated reports don't matter; reports with a null run, number or segment are passed over, as is a null read_until.
    """
    known = runs.filter(F.col("run_id").isNotNull() & F.col("report_no").isNotNull() & F.col("segment_no").isNotNull())
    last = known.groupBy("run_id", "segment_no").agg(F.max_by(F.struct(F.lower(F.trim("status")).alias("status"), "read_until"), "report_no").alias("r"))
    return last.filter((F.col("r.status") == "ok") & F.col("r.read_until").isNotNull()).groupBy("segment_no").agg(F.max("r.read_until").alias("mark"))


def _segment() -> Column:
    """The segment to join by: rows without a number are a segment of their own."""
    return F.coalesce(F.col("segment_no"), F.lit(-(2**31)))


def _moment(at: datetime, entries: DataFrame) -> Column:
    """A moment as the type of written_at, through text: a Python value would pass through this machine's time zone."""
    return F.lit(at.isoformat(sep=" ")).cast(dict(entries.dtypes)["written_at"])


def upper_limit(entries: DataFrame) -> datetime | None:
    """The commit time up to which a run that starts now reads: fixed once, so rows written meanwhile wait for the next run."""
    return entries.agg(F.max("written_at").alias("m")).first()["m"]


def changed_entries(entries: DataFrame, marks: DataFrame, upper: datetime | None = None) -> DataFrame:
    """stream, version, position, old_position, segment_no of the entries whose state after the mark differs from that at it.

    The state at a moment is the position of the latest row written up to and including it (of rows written at the same
    time the greatest position). New entries, and all entries of a segment without a mark, have old_position null. Null
    stream or version is no entry; rows with a null written_at or beyond the upper limit aren't read.
    """
    if upper is None:
        upper = upper_limit(entries)
    if upper is None:
        upper = datetime.min
    marks = small_side(marks.select(_segment().alias("__segment"), "mark"), "marks")
    rows = entries.select(*ENTRY, _segment().alias("__segment")).filter(F.col("stream").isNotNull() & F.col("version").isNotNull() & (F.col("written_at") <= _moment(upper, entries)))
    new = written(rows.join(marks, "__segment", "left").filter(F.col("mark").isNull() | (F.col("written_at") > F.col("mark"))).select(*ENTRY), "new")
    state = F.struct("written_at", "position")
    now = new.groupBy("stream", "version").agg(F.max(state).alias("now"), F.min("segment_no").alias("segment_no"))
    keys = small_side(new.select("stream", "version").distinct(), "keys")
    seen = rows.join(keys, ["stream", "version"], "left_semi").join(marks, "__segment").filter(F.col("written_at") <= F.col("mark"))
    old = seen.groupBy("stream", "version").agg(F.max(state).alias("old"))
    both = now.join(old, ["stream", "version"], "left")
    changed = F.col("old").isNull() | ~F.col("now.position").eqNullSafe(F.col("old.position"))
    return both.filter(changed).select("stream", "version", F.col("now.position").alias("position"), F.col("old.position").alias("old_position"), "segment_no")


class Commits:
    """The commit files of one consumer: `<path>/commits/<number>.json`, each naming an output folder and a watermark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = hadoop(spark, self.path)[0]

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        if not self.exists(f"{self.path}/commits"):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/commits"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def all(self) -> list[dict]:
        """Every commit in order: one scan of the small commit files."""
        if not self.numbers():
            return []
        rows = self.spark.read.text(f"{self.path}/commits/*.json", wholetext=True).collect()
        return sorted((json.loads(r[0]) for r in rows), key=lambda c: c["number"])

    def last(self) -> dict | None:
        n = self.numbers()
        return json.loads(self._text(f"{self.path}/commits/{n[-1]:012d}.json")) if n else None

    def next_folder(self) -> tuple[int, str]:
        """The number of the next commit and a new folder for its output."""
        n = self.numbers()
        number = n[-1] + 1 if n else 1
        return number, f"{self.path}/data/{number:012d}-{uuid.uuid4().hex}"

    def publish(self, number: int, commit: dict) -> None:
        """Create the commit file, complete from the start and only if there is none of this number; else an error.

        The file is written beside its place and put there by one operation that fails if the name is taken: a hard link
        on a local file system, elsewhere a rename without overwriting, which is atomic on HDFS. A store that has neither
        needs one writer at a time.
        """
        final, draft = f"{self.path}/commits/{number:012d}.json", f"{self.path}/drafts/{uuid.uuid4().hex}.json"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(commit), "utf-8"))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        here = local_path(self.spark, draft)
        try:
            if here is not None:
                os.link(here, local_path(self.spark, final))
            elif self.exists(final):
                raise FileExistsError(final)
            else:
                self._rename(draft, final)
        except Exception as e:
            if isinstance(e, FileExistsError) or "AlreadyExists" in str(e):
                raise RuntimeError(f"commit {number} of {self.path} exists already") from e
            raise
        finally:
            with contextlib.suppress(Exception):
                self._fs.delete(self._path(draft), False)

    def _rename(self, draft: str, final: str) -> None:
        sc = self.spark.sparkContext
        option = getattr(sc._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = sc._gateway.new_array(option, 1)
        options[0] = option.NONE
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        files.rename(self._path(draft), self._path(final), options)

    @staticmethod
    def number_of_file() -> Column:
        """The number of the commit that a row's file belongs to."""
        return F.regexp_extract("_metadata.file_path", r"/data/([0-9]{12})-[0-9a-f]{32}/", 1).cast("int")

    def output(self, schema: str | StructType, part: str = "") -> DataFrame:
        """What all commits so far published, with their number, in one scan; drafts and leftovers of failed runs aren't in it."""
        folders = [c["folder"] + part for c in self.all()]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("commit_no", F.lit(0))
        return self.spark.read.schema(schema).parquet(*folders).withColumn("commit_no", self.number_of_file())


CHANGED = "stream long, version int, position long, old_position long, segment_no int"


def run_segments(entries: DataFrame, commits: Commits, reported: DataFrame, limit: datetime | None = None) -> dict | None:
    """Publish the entries added or changed since the marks, and the new marks, in one commit; None if nothing is new.

    The mark of a segment is the greater of the reported one (segment_no, mark) and that of the last commit. The upper
    limit is the greatest written_at there is at the start, or `limit`. Columns of the output: CHANGED. If anything fails
    before the commit, the next run finds the marks as they were and takes the same entries again.
    """
    last = commits.last()
    kind = dict(entries.dtypes)["written_at"]
    marks = reported.select("segment_no", F.col("mark").cast(kind).alias("mark"))
    if last is not None:
        marks = marks.unionByName(entries.sparkSession.read.schema(f"segment_no int, mark {kind}").parquet(last["folder"] + "/marks"))
    marks = written(marks.filter(F.col("mark").isNotNull()).groupBy("segment_no").agg(F.max("mark").alias("mark")), "marks")
    segments = written(entries.groupBy("segment_no").agg(F.max("written_at").alias("top")), "segments")
    upper = limit if limit is not None else segments.agg(F.max("top").alias("m")).first()["m"]
    if upper is None:
        return None
    number, folder = commits.next_folder()
    changed_entries(entries, marks, upper).write.parquet(f"{folder}/changed")
    known = segments.select("segment_no", _moment(upper, entries).alias("mark")).unionByName(marks)
    known.groupBy("segment_no").agg(F.max("mark").alias("mark")).write.parquet(f"{folder}/marks")
    commit = {"number": number, "from": last["watermark"] if last else None, "watermark": str(upper), "folder": folder}
    commits.publish(number, commit)
    return commit


def run_once(source: Callable[[], DataFrame], commits: Commits, process: Callable[[DataFrame], DataFrame], sequence: str, limit=None) -> dict | None:
    """Process the rows with watermark < sequence <= upper limit and publish output and watermark in one commit.

    sequence is a monotonic commit column (number or time); rows where it is null are never read. The upper limit is the
    greatest value there is at the start, or `limit` if that is less. Returns the commit, or None if nothing is new. If
    process or the write fails, nothing is published and the next run takes the same rows again.
    """
    rows = source()
    last = commits.last()
    kind = dict(rows.dtypes)[sequence]
    new = rows if last is None else rows.filter(F.col(sequence) > F.lit(last["watermark"]).cast(kind))
    if limit is not None:
        new = new.filter(F.col(sequence) <= F.lit(limit).cast(kind))
    upper = new.agg(F.max(sequence).cast("string").alias("m")).first()["m"]
    if upper is None:
        return None
    number, folder = commits.next_folder()
    process(new.filter(F.col(sequence) <= F.lit(upper).cast(kind))).write.parquet(folder)
    commit = {"number": number, "from": last["watermark"] if last else None, "watermark": upper, "folder": folder}
    commits.publish(number, commit)
    return commit
