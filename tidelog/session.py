"""Session helpers: the shared folder, stage cuts, size-checked broadcasts and joins that hot keys can't concentrate."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: The most bytes (values, uncompressed) that a broadcast side may have when no fixed bound is known.
BROADCAST_BYTES = 32 << 20
#: A key with more than this share of the rows is hot; there can't be more than its inverse of them.
HOT_SHARE = 1 / 1000
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent (tests on one machine) a folder of this machine is made.
    """
    sc = spark.sparkContext
    path = sc.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The file system that a path belongs to (the cluster's default one without a scheme), and the path as it names it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it, or None if its file system, once resolved, is a remote one."""
    at = hadoop(spark, path)[1].toUri()
    return at.getPath() if at.getScheme() == "file" else None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder. It is removed by remove_scratch(), at the latest when the program ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def remove_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch made by this program (the first `since` paths stay). Results that read it must be consumed."""
    while len(_scratch) > since:
        fs, at = hadoop(spark, _scratch.pop())
        fs.delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch made inside the block is removed at its end; consume (write, collect) the results inside."""
    since = len(_scratch)
    try:
        yield
    finally:
        remove_scratch(spark, since)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the engine may be gone by then
        if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()) is not None:
            remove_scratch(spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df into the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _size_of_values(df: DataFrame) -> Column:
    """Bytes of a row's values: 8 for a number, the length of a text, that of its JSON for what is nested."""

    def size(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        return F.length(F.to_json(F.struct(c))) if kind.startswith(("array", "map", "struct")) else F.lit(8)

    return reduce(lambda a, b: a + b, [size(n, k) for n, k in df.dtypes]).cast("long")


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values of df; known already if it comes from sized()."""
    known = getattr(df, "_value_bytes", None)
    return known if known is not None else df.agg(F.sum(_size_of_values(df)).alias("b")).first()["b"] or 0


def sized(df: DataFrame, label: str) -> DataFrame:
    """As written(), for a join side: the bytes of its values are summed up while it is written."""
    seen = Observation()
    out = written(df.observe(seen, F.sum(_size_of_values(df)).alias("b")), label)
    out._value_bytes = seen.get.get("b") or 0
    return out


def is_small(df: DataFrame, most_bytes: int | None = None) -> bool:
    return value_bytes(df) <= (BROADCAST_BYTES if most_bytes is None else most_bytes)


def small_side(df: DataFrame, label: str, most_bytes: int | None = None) -> DataFrame:
    """A join side that is computed once, written to the shared folder, and broadcast only if its values have at most
    most_bytes (BROADCAST_BYTES). Beyond that the hint is left out and the planner joins by shuffle."""
    side = sized(df, label)
    return F.broadcast(side) if is_small(side, most_bytes) else side


def join_by_key(rows: DataFrame, side: DataFrame, on: list[str], how: str, extra: Column | None = None, merge: bool = False) -> DataFrame:
    """rows joined with side, which has at most one row per key; a key with any share of the rows doesn't concentrate.

    how: inner, left, left_semi or left_anti; extra: a further condition on columns `l.x` and `r.y`. The side is written
    once and broadcast if it is small (checked by bytes; neither if `merge` asks for a sort-merge join). Else the rows are
    written once, those of hot keys meet a broadcast of those keys' side rows (fewer than 1 / HOT_SHARE), rows with a null
    key are not joined at all, and the rest is joined by shuffle.
    """
    others = [c for c in side.columns if c not in on] if how in ("inner", "left") else []
    clash = [c for c in others if c in rows.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        condition = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in on])
        out = a.alias("l").join(b.alias("r"), condition if extra is None else condition & extra, how)
        return out.select("l.*", *[F.col(f"r.{c}") for c in others])

    if not merge:
        side = side if hasattr(side, "_value_bytes") else sized(side, "side")
        if is_small(side):
            return joined(rows, F.broadcast(side))
    rows = written(rows, "rows")
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in on])
    counts = rows.filter(known).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    hot = written(counts.filter(F.col("__n") > max(1.0, total * HOT_SHARE)).select(*on), "hot")
    full = side.hint("merge") if merge else side
    if hot.isEmpty():
        parts = [joined(rows.filter(known), full)]
    else:
        one = rows.join(F.broadcast(hot), on, "left_semi")
        hot_side = side.join(F.broadcast(hot), on, "left_semi")
        parts = [joined(one, F.broadcast(hot_side)), joined(rows.filter(known).join(F.broadcast(hot), on, "left_anti"), full)]
    if how in ("left", "left_anti"):
        kinds = dict(side.dtypes)
        parts.append(rows.filter(~known).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in others]))
    return reduce(DataFrame.unionByName, parts)
