"""Has this key been seen before? Immutable fingerprint filters for sealed batches, exact handling of the current one.

Sealed keys are never kept as a set. Sealed batches are grouped into generations as in a log-structured store: a batch
that has just been sealed is a generation of its own, FAN_OUT complete neighbours become one generation of the next level,
and so on. A generation's keys are split by hash into shards of a bounded number of keys, and for each shard a 3-wise xor
filter is built by peeling: slots that one key alone refers to are taken off wave by wave, and the fingerprints are
assigned in reverse. It needs about 1.23 x 16 bits a key, never says no to a key that it holds, and says yes to a foreign
one with probability 2^-16.

Filters live in a store at a fixed path and are never changed. A generation is known by its level, its number and a digest
of what its batches hold, so a run builds only those that are absent: with one more sealed batch, its own one (or, where it
completes a group, the group's). Asking G generations makes the rate 1 - (1 - 2^-16)^G; G grows with the logarithm of the
number of batches. Keys of the current batch are handled exactly by their first arrival. Where wrong answers aren't
acceptable, the keys with a yes (never those with a no) are looked up in the sealed rows, which they filter where they are
scanned.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import hadoop, join_by_key, shared_dir, small_side, written

BITS = 16
#: Keys of a shard of a filter, about.
SHARD_KEYS = 500_000
#: Complete neighbours that make a generation of the next level.
FAN_OUT = 16
#: Generations that one task asks at a time: with SHARD_KEYS keys each, 64 filters have 80 MB.
ASKED_TOGETHER = 64
GENERATION = "level int, generation long, digest string, shards int"
NAME = ["level", "generation", "digest", "shards"]
FILTERS = f"{GENERATION}, shard int, n_keys long, seed long, block long, prints binary"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift) of keys plus seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _slots(mixed: np.ndarray, block: int) -> np.ndarray:
    """Three slots for each key, one in each third: rows of an array of shape (3, n)."""
    parts = []
    for i, turn in enumerate((0, 21, 42)):
        x = (mixed << np.uint64(turn)) | (mixed >> np.uint64((64 - turn) % 64)) if turn else mixed
        parts.append((((x & np.uint64(0xFFFFFFFF)) * np.uint64(block)) >> np.uint64(32)).astype(np.int64) + i * block)
    return np.stack(parts)


def _prints(mixed: np.ndarray) -> np.ndarray:
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(2**BITS - 1)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, np.ndarray]:
    """seed, block and fingerprints of the xor filter of distinct 64-bit keys."""
    n = len(keys)
    block = (int(1.23 * n) + 32) // 3 + 1
    for seed in range(1, 200):
        mixed = _mixed(keys, seed)
        slots = _slots(mixed, block)
        count = np.bincount(slots.ravel(), minlength=3 * block)
        total = np.zeros(3 * block, np.int64)
        for row in slots:
            np.add.at(total, row, np.arange(n))
        waves, done = [], 0
        alone = np.flatnonzero(count == 1)
        while len(alone):
            who, first = np.unique(total[alone], return_index=True)
            waves.append((who, alone[first]))
            done += len(who)
            touched = slots[:, who].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(total, touched, np.tile(who, 3))
            touched = np.unique(touched)
            alone = touched[count[touched] == 1]
        if done == n:
            prints = np.zeros(3 * block, np.uint16)
            own = _prints(mixed)
            for who, at in reversed(waves):
                a, b, c = slots[:, who]
                prints[at] = own[who] ^ prints[a] ^ prints[b] ^ prints[c]
            return seed, block, prints
    raise RuntimeError("no seed lets the keys be peeled; are they distinct?")


def contains(keys: np.ndarray, seed: int, block: int, prints: np.ndarray) -> np.ndarray:
    """Whether the filter says yes, for an array of 64-bit keys."""
    mixed = _mixed(keys, seed)
    a, b, c = _slots(mixed, block)
    return (prints[a] ^ prints[b] ^ prints[c]) == _prints(mixed)


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def _spread(shards: Column) -> Column:
    """The shard of a hash: its low bits, so that a power of two of shards is refined by a greater one."""
    return F.pmod(F.xxhash64(F.col("h"), F.lit(7)), shards).cast("int")


def with_generation(entries: DataFrame, key: str, batch: str, batches: int) -> DataFrame:
    """h, level, generation of the sealed rows with a key, of batches numbered from 0 to batches - 1.

    A batch belongs to the largest aligned group of FAN_OUT^level batches that is complete. Rows with a null or negative
    batch make a generation of their own (level -1).
    """
    at = F.col(batch).cast("long")
    level = F.when(at.isNull() | (at < 0), -1)
    top = 0
    while FAN_OUT ** (top + 1) <= batches:
        top += 1
    for n in range(top, 0, -1):
        level = level.when((F.floor(at / FAN_OUT**n) + 1) * FAN_OUT**n <= batches, n)
    rows = entries.filter(F.col(key).isNotNull()).select(key_hash(F.col(key)).alias("h"), at.alias("at"), level.otherwise(0).cast("int").alias("level"))
    size = F.pow(F.lit(float(FAN_OUT)), F.col("level"))
    return rows.select("h", "level", F.when(F.col("level") < 0, 0).otherwise(F.floor(F.col("at") / size)).cast("long").alias("generation"))


def generations(sealed: DataFrame, key: str, batch: str) -> tuple[int, list[tuple]]:
    """The number of batches, and level, generation, digest, shards of the generations that the sealed rows make: fewer than
    FAN_OUT for each level, so a list on the driver.

    The digest is made of the number of rows and of sums over the hashes of their keys, so it tells what a filter must hold
    without the filter. One scan after that for the number of batches.
    """
    top = sealed.filter(F.col(key).isNotNull()).agg(F.max(batch).alias("m")).first()["m"]
    batches = max(0, int(top) + 1 if top is not None else 0)
    rows = with_generation(sealed, key, batch, batches)
    low, high = F.pmod("h", F.lit(1 << 31)), F.pmod(F.xxhash64("h"), F.lit(1 << 31))
    per = rows.groupBy("level", "generation").agg(F.concat_ws("-", F.count(F.lit(1)), F.sum(low), F.sum(high)).alias("digest"), F.approx_count_distinct("h").alias("n"))
    shards = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / SHARD_KEYS, F.lit(1.0)))))
    return batches, sorted(tuple(r) for r in per.select("level", "generation", "digest", shards.cast("int").alias("shards")).collect())


class FilterStore:
    """The filters of one table's sealed keys at a fixed path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def of_table(sealed: DataFrame, label: str = "") -> FilterStore:
        """The store in the shared folder that belongs to the files' folder of a table."""
        files = sealed.inputFiles()
        place = uuid.uuid5(uuid.NAMESPACE_URL, f"{label} {files[0].rpartition('/')[0] if files else uuid.uuid4()}")
        return FilterStore(sealed.sparkSession, f"{shared_dir(sealed.sparkSession)}/seen-filters-{place.hex}")

    def filters(self) -> DataFrame:
        """All filters of finished builds, with the name of the build (run)."""
        fs, at = hadoop(self.spark, self.path)
        runs = [s.getPath().toString() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [r for r in runs if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{r}/_SUCCESS"))]
        if not done:
            return self.spark.createDataFrame([], f"{FILTERS}, run string")
        return self.spark.read.schema(FILTERS).parquet(*done).withColumn("run", F.regexp_extract("_metadata.file_path", "/(run-[0-9a-f]+)/", 1))

    def _built(self) -> dict[tuple, str]:
        """The generations that have filters, each with one build of it (builds at the same time may make a filter twice)."""
        rows = self.filters().groupBy(*NAME).agg(F.min("run").alias("run")).collect()
        return {tuple(r)[:-1]: r["run"] for r in rows}

    def seal(self, sealed: DataFrame, key: str, batch: str) -> tuple[list[tuple], DataFrame]:
        """Build the filters that are absent; the generations that the sealed rows make now (NAME), and their filters."""
        batches, wanted = generations(sealed, key, batch)
        absent = sorted(set(wanted) - set(self._built()))
        if absent:
            now = F.broadcast(self.spark.createDataFrame(absent, GENERATION))
            rows = with_generation(sealed, key, batch, batches).join(now, ["level", "generation"]).distinct()

            def build(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                h = np.unique(pdf["h"].to_numpy().view(np.uint64))
                seed, block, prints = build_filter(h)
                return pd.DataFrame([(*group, len(h), seed, block, prints.tobytes())], columns=[*NAME, "shard", "n_keys", "seed", "block", "prints"])

            made = rows.withColumn("shard", _spread(F.col("shards"))).groupBy(*NAME, "shard").applyInPandas(build, FILTERS)
            made.write.parquet(f"{self.path}/run-{uuid.uuid4().hex}")
        built = self._built()
        now = self.spark.createDataFrame([(*g, built[g]) for g in wanted], f"{GENERATION}, run string")
        return wanted, self.filters().join(F.broadcast(now), [*NAME, "run"], "left_semi").drop("run")


def probe(generations_: list[tuple], filters: DataFrame, keys: DataFrame) -> DataFrame:
    """h, hits: how many generations (NAME) say yes (never fewer than hold the key) to each distinct hash of keys."""
    if not generations_:
        return keys.select("h").distinct().withColumn("hits", F.lit(0))
    most = max(shards for *_, shards in generations_)
    chunks = math.ceil(len(generations_) / ASKED_TOGETHER)
    spark = filters.sparkSession
    numbered = [(level, generation, i % chunks) for i, (level, generation, *_) in enumerate(generations_)]
    chunk = F.broadcast(spark.createDataFrame(numbered, "level int, generation long, chunk int"))
    asked = keys.select("h").distinct().withColumn("bin", _spread(F.lit(most)))
    if chunks > 1:
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    else:
        asked = asked.withColumn("chunk", F.lit(0))
    # a filter of few shards is asked in every bin that refines its shard
    bins = F.explode(F.sequence(F.col("shard"), F.lit(most - 1), F.col("shards")))
    sealed = filters.join(chunk, ["level", "generation"]).withColumn("bin", bins).select("chunk", "bin", "seed", "block", "prints")

    def ask(sealed: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["h"].to_numpy().view(np.uint64)
        hits = np.zeros(len(h), np.int32)
        for f in sealed.itertuples():
            hits += contains(h, f.seed, f.block, np.frombuffer(f.prints, np.uint16))
        return pd.DataFrame({"h": pdf["h"].to_numpy(), "hits": hits})

    one = sealed.groupBy("chunk", "bin").cogroup(asked.groupBy("chunk", "bin")).applyInPandas(ask, "h long, hits int")
    return one.groupBy("h").agg(F.sum("hits").cast("int").alias("hits")) if chunks > 1 else one


def probed_keys(sealed: DataFrame, incoming: DataFrame, key: str, order: str, batch: str, store: FilterStore) -> DataFrame:
    """One row per distinct non-null incoming key: key, h, n, first_order, hits, known.

    hits is the filters' answer (0: no), known the exact one. Keys without a hit are not known, and nothing else is asked
    about them; the keys with a hit go to where the sealed rows are scanned.
    """
    new = incoming.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("o"))
    per = written(new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first_order")).withColumn("h", key_hash(F.col("key"))), "asked")
    answered = written(per.join(probe(*store.seal(sealed, key, batch), per), "h", "left").withColumn("hits", F.coalesce("hits", F.lit(0))), "answered")
    asked = small_side(answered.filter(F.col("hits") > 0).select("key"), "yes")
    there = sealed.select(F.col(key).alias("key")).join(asked, "key", "left_semi").distinct().withColumn("there", F.lit(True))
    yes = answered.filter(F.col("hits") > 0).join(there, "key", "left").withColumn("known", F.coalesce("there", F.lit(False))).drop("there")
    no = answered.filter(F.col("hits") == 0).withColumn("known", F.lit(False))
    return yes.unionByName(no).select("key", "h", "n", "first_order", "hits", "known")


def seen_rows(sealed: DataFrame, incoming: DataFrame, key: str, order: str, batch: str, store: FilterStore | None = None) -> DataFrame:
    """Incoming rows whose non-null key is sealed or occurs in an incoming row with a smaller order: all columns of incoming.

    order is unique. Empty tables on either side are allowed. A hot key of the incoming rows doesn't concentrate. store:
    where the filters are, by default the place in the shared folder that belongs to the sealed table.
    """
    keys = probed_keys(sealed, incoming, key, order, batch, store or FilterStore.of_table(sealed))
    answer = keys.filter(F.col("known") | (F.col("n") > 1)).select("key", "first_order", "known")
    # the row's own columns are kept apart, so that their names can't clash
    rows = incoming.filter(F.col(key).isNotNull()).select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(order).alias("o"))
    met = join_by_key(rows, answer, ["key"], "inner")
    return met.filter(F.col("known") | (F.col("o") > F.col("first_order"))).select("row.*")


def error_report(sealed: DataFrame, incoming: DataFrame, key: str, order: str, batch: str, store: FilterStore | None = None) -> DataFrame:
    """One row: keys asked, filter answers and the rates of wrong ones, measured and compounded over the generations.

    n_keys, n_known, n_false_no (always 0), n_false_yes, measured_rate (false among the unknown), generations (of the
    sealed rows), rate_of_one (2^-16) and compounded_rate. Whether a key is known is looked up for all keys here, not only
    for those with a hit.
    """
    store = store or FilterStore.of_table(sealed)
    keys = written(probed_keys(sealed, incoming, key, order, batch, store), "probed")
    asked = small_side(keys.select("key"), "asked")
    exact = sealed.select(F.col(key).alias("key")).join(asked, "key", "left_semi").distinct().withColumn("there", F.lit(True))
    yes = F.col("hits") > 0
    full = keys.join(exact, "key", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    n = len(generations(sealed, key, batch)[1])
    one = 2.0**-BITS
    return full.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if("there").alias("n_known"),
        F.count_if(~yes & F.col("there")).alias("n_false_no"),
        F.count_if(yes & ~F.col("there")).alias("n_false_yes"),
    ).select(
        "*",
        F.try_divide("n_false_yes", F.col("n_keys") - F.col("n_known")).alias("measured_rate"),
        F.lit(n).alias("generations"),
        F.lit(one).alias("rate_of_one"),
        F.lit(1 - (1 - one) ** n).alias("compounded_rate"),
    )
