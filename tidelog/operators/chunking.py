"""Per-key results when a few keys hold most rows: exact offset chunking.

The rows of each key are numbered exactly without bringing a key together in one task:

1. the input is cut into parts by the order column; the bounds come from a sample that every input partition draws while
   it counts its rows (one scan of that column);
2. rows are spread by (part, key), sorted and numbered within it; the last number of each is its count, and a prefix sum
   of the counts over the parts gives the offset of each (part, key);
3. rows get their number: offset plus local number;
4. the numbers cut each key into chunks of the same number of rows, which are folded independently into states that
   know their first and last values; a chunk that crosses parts has one state in each of them;
5. the ordered states of a key are merged, including what happens where one part ends and the next begins.

There is one shuffle of rows, by (part, key), so a key with a third of all rows spreads over all tasks; counts and rows read
the same shuffle files. What follows it (offsets, states) has a row per (part, key) or per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import written

#: Rows of a part, about, and the most parts: past PART_ROWS * MOST_PARTS = 10^11 rows a part has a MOST_PARTS-th of them.
PART_ROWS = 500_000
MOST_PARTS = 200_000
#: Values of the order column that all input partitions together sample, about; a sorted list of them is all that reaches the driver.
SAMPLE = 4_000_000
#: Rows of a chunk.
CHUNK_ROWS = 100_000


def order_sketch(df: DataFrame, order: Column, parts: int | None = None) -> tuple[int, list]:
    """The number of rows of df, and increasing bounds, fewer than parts, that cut order into about equal parts.

    One scan. Every input partition counts its rows and draws the same number of values (those with the least random
    numbers), which weigh as much as the rows that they stand for. parts None: by the number of rows. Nulls have no bound.
    """
    rows = df.select(order.alias("o"))
    most = max(4, min(2_000, SAMPLE // max(1, rows.rdd.getNumPartitions())))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rnd = np.random.default_rng(TaskContext.get().partitionId())
        n, known = 0, 0
        kept, lots = None, np.zeros(0)
        for batch in batches:
            n += batch.num_rows
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            known += len(values)
            kept = values if kept is None else np.concatenate([kept, values])
            lots = np.concatenate([lots, rnd.random(len(values))])
            if len(lots) > most:
                least = np.argpartition(lots, most)[:most]
                kept, lots = kept[least], lots[least]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([known], pa.int64()), pa.array([kept.tolist()], kind)], ["n", "known", "sample"])

    number = dict(rows.dtypes)["o"]
    kind = pa.list_(pa.float64() if number in ("float", "double") else pa.int64())
    drawn = rows.mapInArrow(draw, f"n long, known long, sample array<{'double' if number in ('float', 'double') else 'bigint'}>").toArrow()
    total = sum(drawn["n"].to_pylist())
    if parts is None:
        parts = min(MOST_PARTS, max(8, math.ceil(total / PART_ROWS)))
    lists = drawn["sample"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], kind)
    sizes = np.asarray(pa.compute.list_value_length(lists), np.int64)
    values = np.asarray(lists.flatten())
    weight = np.repeat(np.asarray(drawn["known"], np.float64) / np.maximum(sizes, 1), sizes)
    at = np.argsort(values, kind="stable")
    values, reach = values[at], np.cumsum(weight[at])
    if not len(values):
        return total, []
    cuts = np.searchsorted(reach, np.arange(1, parts) * (reach[-1] / parts))
    return total, np.unique(values[np.minimum(cuts, len(values) - 1)]).tolist()


def _search(df: DataFrame, edges: Column, size: Column, most: int, order: str, name: str) -> DataFrame:
    """Add how many of the ascending edges (size of them, at most `most`) are <= order: binary search, one projection a step."""
    n = 1
    while n <= most:
        n *= 2
    df = df.withColumn(name, F.lit(0))
    while n > 1:
        n //= 2
        at = F.col(name) + n
        df = df.withColumn(name, F.when((at <= size) & (F.try_element_at(edges, at) <= F.col(order)), at).otherwise(F.col(name)))
    return df


def _numbers(values: list) -> str:
    return f"array({', '.join(f'{v!r}D' if isinstance(v, float) else f'{v}L' for v in values)})"


def with_part(df: DataFrame, order: str, bounds: list, name: str) -> DataFrame:
    """Add the part number (how many bounds are <= order). Null order: part 0. Bounds are searched in two levels, so that
    their list is held once in a plan."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    width = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    df = _search(df, F.expr(_numbers([r[0] for r in rows])), F.lit(len(rows)), len(rows), order, "__row")
    df = df.withColumn("__edges", F.try_element_at(F.expr(f"array({', '.join(map(_numbers, rows))})"), F.greatest("__row", F.lit(1))))
    df = _search(df, F.col("__edges"), F.size("__edges"), width, order, name)
    full = (F.greatest("__row", F.lit(1)) - 1) * width
    return df.withColumn(name, (full + F.col(name)).cast("int")).drop("__row", "__edges")


def _placed(df: DataFrame, key: str, order: list[str], bounds: list, more: dict[str, Column] | None = None) -> DataFrame:
    """Rows with part, row_no and the columns `more` (window expressions over the rows before, within part and key)."""
    own = Window.partitionBy("part", key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    spread = with_part(df, order[0], bounds, "part").repartition("part", key)
    local = spread.withColumn("local_no", F.row_number().over(own))
    # the last row of a (part, key) tells its count
    counts = local.withColumn("next_no", F.lead("local_no").over(own)).filter(F.col("next_no").isNull()).select("part", key, F.col("local_no").alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = local.withColumns({c: e.over(earlier) for c, e in (more or {}).items()})
    return rows.join(offsets, ["part", key]).withColumn("row_no", F.col("before") + F.col("local_no")).drop("before", "local_no")


def number_rows(df: DataFrame, key: str, order: list[str], bounds: list | None = None, parts: int | None = None) -> DataFrame:
    """Add `row_no`, from 1, per key in the order given; null keys and their rows are left out.

    Rows that are equal in all order columns get numbers in an unspecified order. The first order column must be
    numeric. Columns named `part`, `row_no`, `local_no`, `next_no` and `before` are reserved; select what you need first.
    """
    df = df.filter(F.col(key).isNotNull())
    if bounds is None:
        _, bounds = order_sketch(df, F.col(order[0]), parts)
    return _placed(df, key, order, bounds).drop("part")


def ordered_offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """key, before: for each row of counts (one per key) the sum of n over all smaller keys, whatever the key's type.

    The keys are range-partitioned and written once; sums run within the ranges, and over the ranges' totals (one row
    per range).
    """
    ranges = written(counts.select(key, n).repartitionByRange(key).withColumn("range_no", F.spark_partition_id()), "offsets")
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("range_no").agg(F.sum(n).alias("total"))
    bases = totals.select("range_no", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("range_no").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.join(F.broadcast(bases), "range_no").select(key, (F.col("base") + F.coalesce(F.sum(n).over(within), F.lit(0))).alias("before"))


def chunk_states(numbered: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One state per (key, part, chunk) of rows (key, part, position, version, row_no, prev_version, prev_position)."""
    df = numbered.withColumn("chunk", F.floor((F.col("row_no") - 1) / chunk_rows))
    seen = F.col("version").isNotNull()
    return df.groupBy("part", "key", "chunk").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("version").alias("n_versions"),
        F.min("version").alias("min_version"),
        F.max("version").alias("max_version"),
        F.min_by("version", F.when(seen, F.col("row_no"))).alias("first_version"),
        F.max_by("version", F.when(seen, F.col("row_no"))).alias("last_version"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
        F.count_if(F.col("version") < F.col("prev_version")).alias("n_backward"),
        F.max(F.col("position") - F.col("prev_position")).alias("max_gap"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Merge the states of each key in their order; a key has a state per part, and one more per CHUNK_ROWS rows.

    A state knows what its first row follows within its part. What the first row of a part follows is the last value that
    the states of earlier parts know.
    """
    earlier = Window.partitionBy("key").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("first_version").isNotNull()
    last = F.struct("part", F.col("last_version").alias("value"))
    df = states.withColumn("prev", F.last(F.when(seen, last), True).over(earlier)).withColumn("prev_position", F.last("last_position", True).over(earlier))
    df = df.withColumn("at", F.struct("part", "chunk"))
    turned = (F.col("prev.part") < F.col("part")) & (F.col("first_version") < F.col("prev.value"))
    return df.groupBy("key").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_versions").alias("n_versions"),
        F.min("min_version").alias("min_version"),
        F.max("max_version").alias("max_version"),
        F.min_by("first_version", F.when(seen, F.col("at"))).alias("first_version"),
        F.max_by("last_version", F.when(seen, F.col("at"))).alias("last_version"),
        F.min("first_position").alias("first_position"),
        F.max("last_position").alias("last_position"),
        F.sum(F.col("n_backward") + F.when(turned, 1).otherwise(0)).alias("n_backward"),
        F.max(F.greatest("max_gap", F.col("first_position") - F.col("prev_position"))).alias("max_gap"),
    )


def _summary(df: DataFrame, key: str, version: str, position: str, chunk_rows: int, parts: int | None) -> tuple[int, DataFrame]:
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(version).cast("int").alias("version"), F.col(position).cast("long").alias("position"))
    total, bounds = order_sketch(rows, F.col("position"), parts)
    before = {"prev_version": F.last("version", True), "prev_position": F.last("position", True)}
    return total, merge_states(chunk_states(_placed(rows.filter(F.col("key").isNotNull()), "key", ["position", "version"], bounds, before), chunk_rows))


def key_summary(df: DataFrame, key: str, version: str, position: str, chunk_rows: int = CHUNK_ROWS, parts: int | None = None) -> DataFrame:
    """One row per non-null key, folded over its rows in position order (rows counted as stored).

    key (as text), n_rows, n_versions (non-null), min_version, max_version, first_version and last_version (the first and
    last non-null one in position order, ties by version), first_position, last_position, n_backward (non-null versions
    smaller than the non-null one before) and max_gap (largest step between successive positions; null for one row).
    An empty input gives no rows; null versions and positions are allowed, other columns are ignored.
    """
    return _summary(df, key, version, position, chunk_rows, parts)[1]


def heavy_keys(df: DataFrame, key: str, version: str, position: str, per_cent: float = 1.0, chunk_rows: int = CHUNK_ROWS, parts: int | None = None) -> DataFrame:
    """key_summary() of the keys that hold at least per_cent of all rows of df, rows with a null key counting for the total."""
    total, summary = _summary(df, key, version, position, chunk_rows, parts)
    return summary.filter(F.col("n_rows") * 100 >= F.lit(total * per_cent))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
