"""Top N items within every group, also when a few groups hold millions of items.

The N-th best item that a partition has of a group is a lower bound for what can be among the N best of the whole group.
One pass over the table finds, in every partition and without a shuffle, the N best items of each group; the N-th of them
is the partition's bound, and what is worse than it is left behind where it was read. The greatest bound of each group is
joined back, rows below it are dropped before they are shuffled, and the survivors are ranked. A group brings N rows per
partition to the join at most, however large it is, and about N to the ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import join_by_key, written

#: Rows that a worker gathers at least before it sorts out the best ones again.
BUFFER_ROWS = 1 << 16


def _best(code: np.ndarray, score: np.ndarray, tie: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the n best distinct rows of each code, in order, and their ranks from 1."""
    order = np.lexsort((tie, np.invert(score), code))
    c, s, t = code[order], score[order], tie[order]
    if len(c):
        keep = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])])
        order, c = order[keep], c[keep]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, int)
    rank = np.arange(len(c)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(c)]]))) + 1
    top = rank <= n
    return order[top], rank[top]


class _Buffer:
    """Rows of one partition; sorted down to the n best per group whenever they have doubled, so the work is n log n."""

    def __init__(self, n: int):
        self.n, self.kept, self.size = n, 0, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, code: np.ndarray, score: np.ndarray, tie: np.ndarray) -> None:
        self.parts.append((code, score, tie))
        self.size += len(code)
        if self.size > 2 * self.kept + BUFFER_ROWS:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        code, score, tie = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in range(3))
        top, rank = _best(code, score, tie, self.n)
        self.parts = [(code[top], score[top], tie[top])]
        self.kept = self.size = len(top)
        return (*self.parts[0], rank)


def local_tops(rows: DataFrame, n: int) -> DataFrame:
    """grp, score, tie, local_rank: the n best distinct items of each group in each input partition, ranks from 1.

    rows: grp string, score long, tie long, no nulls. A row of rank n is its partition's bound for the group.
    """

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        buffer = _Buffer(n)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).dictionary_encode()
            known = np.fromiter((codes.setdefault(w, len(codes)) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            buffer.add(known[words.indices.to_numpy()], batch.column(1).to_numpy(), batch.column(2).to_numpy())
        code, score, tie, rank = buffer.best()
        names = pa.array(list(codes), pa.string())
        for i in range(0, len(code), BUFFER_ROWS):
            s = slice(i, i + BUFFER_ROWS)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code[s])), pa.array(score[s], pa.int64()), pa.array(tie[s], pa.int64()), pa.array(rank[s], pa.int32())], ["grp", "score", "tie", "local_rank"])

    return rows.mapInArrow(tops, "grp string, score long, tie long, local_rank int")


def group_bounds(tops: DataFrame, n: int) -> DataFrame:
    """grp, bound: the best of the partitions' n-th items; no group that has n items in some partition is left out."""
    # ~tie turns the order round without overflow
    return tops.filter(F.col("local_rank") == n).groupBy("grp").agg(F.max(F.struct("score", F.bitwise_not("tie").alias("not_tie"))).alias("bound"))


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    """The n distinct (group, score, tie) with greatest score, then smallest tie, of every group; with rank from 1.

    Rows with a null in one of the three are left out, equal rows count once, other columns are dropped. score and tie
    are whole numbers. Groups with fewer items give what they have; an empty table gives none. The table is read once.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(score).cast("long").alias("score"), F.col(tie).cast("long").alias("tie")).dropna()
    tops = written(local_tops(rows, n), "tops")
    met = join_by_key(tops.drop("local_rank"), written(group_bounds(tops, n), "bounds"), ["grp"], "left")
    kept = met.filter(F.col("bound").isNull() | (F.struct("score", F.bitwise_not("tie").alias("not_tie")) >= F.col("bound"))).select("grp", "score", "tie")
    # equal rows share a rank, so they are made one after the only shuffle of the survivors
    rank = F.dense_rank().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.asc("tie")))
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= n).distinct()
    kinds = dict(df.dtypes)
    return ranked.select(F.col("grp").cast(kinds[group]).alias(group), F.col("score").cast(kinds[score]).alias(score), F.col("tie").cast(kinds[tie]).alias(tie), "rank")
