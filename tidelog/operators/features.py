"""One feature row per entity from billions of typed events: mergeable sparse vectors.

Event types are encoded as small indices, so that a cell is (entity, index) and its state (count, total, latest time) can
be merged in any order: partial aggregates run before the shuffle, and a hot entity is spread over its cells. The cells
of an entity form a sparse vector (at most one element per known type), which is expanded into columns only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.json import json_object, may_hold_key, top_level
from tidelog.functions.names import is_system_name
from tidelog.session import small_side

AMOUNT = "decimal(28,6)"


def encoded_events(log: DataFrame, kinds: DataFrame) -> DataFrame:
    """stream, version, kind_no, timestamp, amount of the events that count, each (stream, version) once.

    User streams only; null stream or version and types that kinds doesn't spell exactly so don't count. Of copies of a
    (stream, version) the one with the smallest position counts (then by kind, time, amount). amount is the top-level
    number or numeric text; anything else is null.
    """
    kinds = kinds.filter(F.col("type").isNotNull()).groupBy(F.col("type").alias("kind_type")).agg(F.min("kind_no").alias("kind_no"))
    rows = log.filter(F.col("stream").isNotNull() & F.col("version").isNotNull() & ~is_system_name(F.col("stream"))).select("stream", "version", "type", "position", "timestamp", "data")
    rows = rows.join(small_side(kinds, "kinds"), F.col("type") == F.col("kind_type"), "left")
    known = F.col("kind_no").isNotNull()
    text = F.when(known & may_hold_key(F.col("data"), "amount"), F.col("data"))
    amount = F.trim(top_level(json_object(text), "amount")).try_cast(AMOUNT)
    cell = F.struct("position", "kind_no", "timestamp", amount.alias("amount"))
    once = rows.select("stream", "version", cell.alias("cell")).groupBy("stream", "version").agg(F.min("cell").alias("cell"))
    return once.select("stream", "version", "cell.kind_no", "cell.timestamp", "cell.amount").filter(F.col("kind_no").isNotNull())


def cells(events: DataFrame) -> DataFrame:
    """stream, kind_no, n, total, latest: the merged state of each cell."""
    return events.groupBy("stream", "kind_no").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.max("timestamp").alias("latest"))


def sparse_vectors(cell_rows: DataFrame) -> DataFrame:
    """stream, vector: the cells of a stream ordered by index; as many elements as kinds at most."""
    return cell_rows.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("kind_no", "n", "total", "latest"))).alias("vector"))


def merge_vectors(left: DataFrame, right: DataFrame) -> DataFrame:
    """Merge sparse vectors of disjoint events of the same streams."""
    flat = left.unionByName(right).select("stream", F.explode("vector").alias("c")).select("stream", "c.*")
    return sparse_vectors(flat.groupBy("stream", "kind_no").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest").alias("latest")))


def feature_vectors(log: DataFrame, kinds: DataFrame) -> DataFrame:
    """The sparse vector of every user stream that has an event of a known kind."""
    return sparse_vectors(cells(encoded_events(log, kinds)))


def dense(vector: Column, first: int, size: int) -> Column:
    """The cells of a sparse vector at their places in an array of `size`, for indices from `first` on: the gaps before the
    cells and behind the last are filled with nulls, so the work is in proportion to the array."""
    at = lambda c: c["kind_no"] - F.lit(first)
    last = lambda i: F.when(i == 0, F.lit(-1)).otherwise(at(F.try_element_at(vector, i)))
    none = F.when(F.lit(False), F.try_element_at(vector, F.lit(1)))
    gap = lambda n: F.array_repeat(none, F.greatest(n, F.lit(0)))
    filled = F.flatten(F.transform(vector, lambda c, i: F.concat(gap(at(c) - last(i) - 1), F.array(c))))
    return F.concat(filled, gap(F.lit(size) - F.size(filled)))


def feature_table(log: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row per user stream: stream, then n_<k>, total_<k>, latest_<k> for every kind number k.

    n is 0 and total (the exact decimal sum as a double) and latest are null where a stream has no event of the kind; total
    is null too where no event of the cell has an amount. Streams without any event of a known kind have a row as well, with
    counts of 0. Kinds become columns, so their number is bounded by what a table can have; kind numbers may leave gaps, but
    the array that is cut into columns is as long as their range.
    """
    numbers = sorted(r["kind_no"] for r in kinds.filter(F.col("type").isNotNull() & F.col("kind_no").isNotNull()).select("kind_no").distinct().collect())
    streams = log.filter(F.col("stream").isNotNull() & F.col("version").isNotNull() & ~is_system_name(F.col("stream"))).select("stream").distinct()
    wide = streams.join(feature_vectors(log, kinds), "stream", "left")
    if not numbers:
        return wide.select("stream")
    nothing = F.array().cast(wide.schema["vector"].dataType)
    wide = wide.select("stream", F.coalesce("vector", nothing).alias("vector"))
    wide = wide.select("stream", dense(F.col("vector"), numbers[0], numbers[-1] - numbers[0] + 1).alias("d"))
    # as text: hundreds of columns are made by one call
    out = ["stream"]
    for k in numbers:
        cell = f"d[{k - numbers[0]}]"
        out += [f"coalesce({cell}.n, 0L) AS n_{k}", f"CAST({cell}.total AS DOUBLE) AS total_{k}", f"{cell}.latest AS latest_{k}"]
    return wide.selectExpr(*out)


def frequent_cells(log: DataFrame, kinds: DataFrame, least: int = 5) -> DataFrame:
    """stream, type of the cells with a count of at least `least`."""
    c = feature_vectors(log, kinds).select("stream", F.explode(F.filter("vector", lambda x: x["n"] >= least)).alias("c")).select("stream", "c.kind_no")
    return c.join(F.broadcast(kinds.select("kind_no", "type")), "kind_no").select("stream", "type")
