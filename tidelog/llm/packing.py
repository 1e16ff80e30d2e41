"""Filling containers of fixed capacity with items of varying length: bounded-space online best fit.

Every partition keeps a fixed number of open containers per kind. An item goes into the open container that it leaves
least room in; if it fits in none, a new one is opened, and when that is one too many, the fullest is emitted. Items are
never split unless they exceed the capacity: such an item becomes pieces of full capacity and a rest that is placed like
any item. What is left open at the end of all partitions is merged: these containers, taken whole, are packed as items
(largest first, best fit), first within groups of partitions, then what is emptiest in each group once more over all, so
that no task gets more than WINDOWS containers of each of MERGE_PARTITIONS partitions or groups.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as Over
from pyspark.sql import functions as F

from tidelog.llm.lexicon import text_slices
from tidelog.session import small_side, written

#: Open containers per kind and partition.
WINDOWS = 64
#: Partitions whose open containers one task merges.
MERGE_PARTITIONS = 1024
PLACED = "kind int, item long, piece int, size int, part int, number int, full boolean"
MERGED = "kind int, container string, size int, into string, room int"


class Window:
    """The open containers of one kind: best fit by remaining room, at most `most` of them."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.open: list[tuple[int, int]] = []  # room, number; ascending
        self.opened = 0

    def place(self, size: int) -> int:
        """Put an item of at most the capacity; its container's number."""
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            room, number = self.capacity, self.opened
            self.opened += 1
            if len(self.open) >= self.most:
                self.open.pop(0)  # the fullest is emitted
        if room > size:
            bisect.insort(self.open, (room - size, number))
        return number

    def place_whole(self) -> int:
        """Fill a container of its own."""
        self.opened += 1
        return self.opened - 1


def pieces(size: int, capacity: int) -> list[int]:
    """An item's pieces: itself, or full ones and a rest if it exceeds the capacity."""
    full, rest = divmod(size, capacity)
    return [size] if size <= capacity else [capacity] * full + ([rest] if rest else [])


def place_items(items: DataFrame, capacities: dict[int, int], windows: int = WINDOWS) -> DataFrame:
    """Place items (kind, item, size >= 1) partition by partition, written to the shared folder.

    kind, item, piece (from 0), size, container, full (the container takes part in no merge).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        window = {k: Window(c, windows) for k, c in capacities.items()}
        # a row is held back while its container is open
        waiting: dict[tuple[int, int], list[tuple]] = {}

        def batch_of(rows: list[tuple], full: bool) -> pa.RecordBatch:
            kind, item, piece, size, number = map(list, zip(*rows))
            n = len(rows)
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            columns = (kind, item, piece, size, [part] * n, number, [full] * n)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["kind", "item", "piece", "size", "part", "number", "full"])

        for batch in batches:
            done = []
            for kind, item, size in zip(*(c.to_pylist() for c in batch.columns)):
                w = window[kind]
                if size < w.capacity:
                    n = w.place(size)
                    waiting.setdefault((kind, n), []).append((kind, item, 0, size, n))
                    continue
                for i, s in enumerate(pieces(size, w.capacity)):
                    if s == w.capacity:
                        done.append((kind, item, i, s, w.place_whole()))
                    else:
                        n = w.place(s)
                        waiting.setdefault((kind, n), []).append((kind, item, i, s, n))
            alive = {(k, number) for k, w in window.items() for _, number in w.open}
            for c in [c for c in waiting if c not in alive]:
                done += waiting.pop(c)
            if done:
                yield batch_of(done, True)
        rest = [row for rows in waiting.values() for row in rows]
        if rest:
            yield batch_of(rest, False)

    placed = items.select(F.col("kind").cast("int"), F.col("item").cast("long"), F.col("size").cast("int")).mapInArrow(run, PLACED)
    return written(placed.select("kind", "item", "piece", "size", F.concat_ws("-", "kind", "part", "number").alias("container"), "full"), "placed")


def _merged(bins: DataFrame, capacities: dict[int, int], by: str) -> DataFrame:
    """kind, container, size, into, room (left in the container it goes into at the end) of bins (kind, container, size, by)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(key[0])
        rooms: list[tuple[int, int, str]] = []
        left: dict[str, int] = {}
        out = []
        for size, container in sorted(zip(pdf["size"].tolist(), pdf["container"]), key=lambda x: (-x[0], x[1])):
            at = bisect.bisect_left(rooms, (size, -1, ""))
            if at < len(rooms):
                room, n, into = rooms.pop(at)
            else:
                room, n, into = capacities[kind], len(out), container
            left[into] = room - size
            bisect.insort(rooms, (room - size, n, into))
            out.append((kind, container, size, into))
        return pd.DataFrame([(*row, left[row[3]]) for row in out], columns=["kind", "container", "size", "into", "room"])

    return bins.groupBy("kind", by).applyInPandas(run, MERGED)


def merge_open(placed: DataFrame, capacities: dict[int, int], windows: int = WINDOWS) -> DataFrame:
    """kind, container, into: the open containers of all partitions packed whole, largest first, best fit, in two rounds."""
    part = (F.split_part("container", F.lit("-"), F.lit(2)).cast("long") / MERGE_PARTITIONS).cast("long")
    bins = placed.filter(~F.col("full")).groupBy("kind", "container").agg(F.sum("size").cast("int").alias("size")).withColumn("grp", part)
    one = written(_merged(bins, capacities, "grp"), "merged")
    # the emptiest containers of each group meet once more; a group brings as many as a partition had
    group = (F.split_part("into", F.lit("-"), F.lit(2)).cast("long") / MERGE_PARTITIONS).cast("long")
    filled = one.groupBy("kind", "into").agg(F.sum("size").cast("int").alias("size"), F.max("room").alias("room")).withColumn("grp", group)
    emptiest = filled.withColumn("r", F.row_number().over(Over.partitionBy("kind", "grp").orderBy(F.desc("room"), "into"))).filter(F.col("r") <= windows)
    two = _merged(emptiest.select("kind", F.col("into").alias("container"), "size", F.lit(0).alias("all")), capacities, "all")
    last = two.select("kind", F.col("container").alias("into"), F.col("into").alias("final"))
    return one.join(last, ["kind", "into"], "left").select("kind", "container", F.coalesce("final", "into").alias("into"))


def pack(items: DataFrame, capacities: dict[int, int], windows: int = WINDOWS) -> DataFrame:
    """kind, item, piece, size, container of every item; items of size 0 (or null) have container null and piece 0.

    A container is named by kind, partition and number. Kinds without a capacity are an error. Items may repeat: every row
    is placed. An empty input gives no rows.
    """
    sized = items.select("kind", "item", F.coalesce("size", F.lit(0)).alias("size"))
    placed = place_items(sized.filter(F.col("size") > 0), capacities, windows)
    # only what was open at the end of a partition takes part in the merge
    merges = small_side(merge_open(placed, capacities, windows), "merges")
    still = placed.filter(~F.col("full")).join(merges, ["kind", "container"], "left").withColumn("container", F.coalesce("into", "container"))
    out = placed.filter("full").unionByName(still.drop("into")).select("kind", "item", "piece", "size", "container")
    nothing = sized.filter(F.col("size") <= 0).select("kind", "item", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("container"))
    return out.unionByName(nothing)


def unused_space(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """kind, capacity, n_items, n_containers, least_containers (all tokens over the capacity), tokens, unused, unused_share."""
    caps = packed.sparkSession.createDataFrame(sorted(capacities.items()), "kind int, capacity int")
    per = packed.filter(F.col("container").isNotNull()).groupBy("kind", "container").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"))
    sums = per.groupBy("kind").agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("tokens"))
    out = sums.join(F.broadcast(caps), "kind")
    space = F.col("n_containers") * F.col("capacity")
    return out.select("kind", "capacity", "n_items", "n_containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "tokens", (space - F.col("tokens")).alias("unused"), (1 - F.col("tokens") / space).alias("unused_share"))


def token_counts(docs: DataFrame, item: str, text: str, tokenizers: list[str], folder: str | None = None) -> DataFrame:
    """item, tokenizer, size: tokens of every non-null text by each public tokenizer (no special tokens; empty text: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [counter(name, folder) for name in tokenizers]
        for batch in batches:
            # slices by bytes, so that what a tokenizer gives is never large
            for part in text_slices(batch, 1):
                texts = part.column(1).to_pylist()
                sizes = pa.array([list(x) for x in zip(*(count(texts) for count in counters))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), sizes], ["item", "sizes"])

    rows = docs.filter(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "item long, sizes array<int>")
    names = F.array(*[F.lit(t) for t in tokenizers])
    each = F.arrays_zip(names.alias("tokenizer"), F.col("sizes").alias("size"))
    return counted.select("item", F.inline(each)).select("item", "tokenizer", "size")


def counter(name: str, folder: str | None = None):
    """A function from texts to their numbers of tokens. folder: where the vocabulary files are, or None for the package."""
    import os

    def path(file: str) -> str:
        if folder:
            return os.path.join(folder, file)
        import public_tokenizers

        return public_tokenizers.path(file)

    if name.startswith("piece"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path(f"{name}.model"))
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if name.startswith("byte"):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path(f"{name}.tiktoken"), "rb"))}
        model = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(model.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path(f"{name}.json"))
    model.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
