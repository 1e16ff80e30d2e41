"""Index maintenance and inspection: compaction, zone maps, membership sketches, dumps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: False answers that a membership sketch may give.
BLOOM_ERROR = 0.01


def concat(*parts: DataFrame) -> DataFrame:
    """Union of all rows of all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compact(*segments: DataFrame) -> DataFrame:
    """Index segments merged to one sorted segment with one entry per (stream, version): that of the first segment that has it."""
    marked = concat(*[s.select("stream", "version", "position", F.lit(i).alias("segment")) for i, s in enumerate(segments)])
    unique = marked.groupBy("stream", "version").agg(F.min(F.struct("segment", "position")).alias("e")).select("stream", "version", "e.position")
    return unique.repartitionByRange("stream", "version").sortWithinPartitions("stream", "version")


def zone_map(numbered: DataFrame, block_rows: int) -> DataFrame:
    """block, first and last key and row count of blocks of an index (columns stream, version, row_no from 1)."""
    block = F.floor((F.col("row_no") - 1) / block_rows)
    k = F.struct("stream", "version")
    zones = numbered.groupBy(block.alias("block")).agg(F.min(k).alias("lo"), F.max(k).alias("hi"), F.count(F.lit(1)).alias("n_entries"))
    return zones.select("block", F.col("lo.stream").alias("first_stream"), F.col("lo.version").alias("first_version"), F.col("hi.stream").alias("last_stream"), F.col("hi.version").alias("last_version"), "n_entries")


def bloom_shape(n_keys: int, error: float = BLOOM_ERROR) -> tuple[int, int]:
    """Bits and hash functions for a number of keys and a rate of false answers."""
    bits = max(64, int(n_keys * abs(math.log(error)) / math.log(2) ** 2))
    return bits, max(1, math.ceil(math.log(2) * bits / max(1, n_keys)))


def _bits(key: Column, bits: int, hashes: int) -> Column:
    one, two = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))
    # Kirsch-Mitzenmacher: position i is h1 + i * h2; shifted first, so that nothing overflows
    one, two = F.pmod(one, F.lit(bits)), F.pmod(two, F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(one + i * two, F.lit(bits)))


def bloom_words(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """word, value: the non-zero 64-bit words of a membership sketch. Two sketches merge by bit_or over their words."""
    at = keys.filter(F.col(key).isNotNull()).select(F.explode(_bits(F.col(key), bits, hashes)).alias("b"))
    value = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))
    return at.select(F.floor(F.col("b") / 64).alias("word"), value.alias("value")).groupBy("word").agg(F.bit_or("value").alias("value"))


def bloom_contains(words: DataFrame, asked: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """key, maybe: whether the sketch has all bits of each distinct non-null key asked."""
    q = asked.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("b", F.explode(_bits(F.col(key), bits, hashes)))
    q = q.withColumn("word", F.floor(F.col("b") / 64)).join(words, "word", "left")
    on = F.call_function("shiftright", F.coalesce("value", F.lit(0).cast("long")), F.pmod("b", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return q.groupBy(key).agg(F.bool_and(on).alias("maybe"))


def dump_stream(rows: DataFrame) -> DataFrame:
    """line: one text line per event."""
    return rows.select(F.format_string("%s@%s %s %s", F.col("stream"), F.col("version"), F.col("type"), F.coalesce("data", F.lit(""))).alias("line"))


def dump_log(log: DataFrame) -> DataFrame:
    """line: position and event."""
    return log.select(F.format_string("%s | %s@%s %s %s", F.col("position"), F.col("stream"), F.col("version"), F.col("type"), F.coalesce("data", F.lit(""))).alias("line"))


def dump_index(index: DataFrame) -> DataFrame:
    """line: position and key."""
    return index.select(F.format_string("%s | %s@%s", F.col("position"), F.col("stream"), F.col("version")).alias("line"))
