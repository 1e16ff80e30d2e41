"""Queries of the problems on language data and on seen keys and top items, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import lexicon, packing, seen, sentences, topn
from tidelog.session import written
from tidelog.sources.tables import table

# ---- 4: has this key been seen before?


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows whose stream is in the index or came earlier: answers of the filters, positives verified."""
    rows = seen.seen_rows(table(spark, d, "index_entry"), table(spark, d, "incoming_entry"), "stream", "arrival_no", "segment_no")
    return rows.select("arrival_no")


def p4_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often the filters were asked and wrong."""
    return seen.error_report(table(spark, d, "index_entry"), table(spark, d, "incoming_entry"), "stream", "arrival_no", "segment_no")


def p4_checked_rates(spark: SparkSession, d: str) -> DataFrame:
    """What of the report SQL can tell as well: keys, known keys, no false no, the generations and their rate, and whether
    the false yes are at most twice what that rate lets expect (and three more, as there are few)."""
    r = p4_error_rates(spark, d)
    most = 3 + 2 * F.col("compounded_rate") * (F.col("n_keys") - F.col("n_known"))
    return r.select("n_keys", "n_known", "n_false_no", "generations", "compounded_rate", (F.col("n_false_yes") <= most).alias("within"))


# ---- 7: top N in every group


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The 3 newest events of every stream."""
    return topn.top_n(table(spark, d, "event_log"), "stream", "version", "position", 3).select("stream", "version", "position")


# ---- 8: encoding


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text by byte_bpe_50k."""
    return lexicon.encode(table(spark, d, "documents"), ["doc_id"], "text", lexicon.Vocabulary.public("byte_bpe_50k"))


# ---- 9: packing


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, dict[int, int]]:
    """Every text packed into every kind of container, and the kinds' capacities (container_kind is a fixed table of three)."""
    kinds = table(spark, d, "container_kind").select("container_no", "tokenizer", "capacity").collect()
    # counted once: items without tokens are picked out apart from the others
    sizes = written(packing.token_counts(table(spark, d, "documents"), "doc_id", "text", sorted({k["tokenizer"] for k in kinds})), "tokens")
    which = spark.createDataFrame([(k["container_no"], k["tokenizer"]) for k in kinds], "kind int, tokenizer string")
    capacities = {k["container_no"]: k["capacity"] for k in kinds}
    return packing.pack(sizes.join(F.broadcast(which), "tokenizer").select("kind", "item", "size"), capacities), capacities


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text or piece of a text, for each kind of container."""
    packed, _ = _packed(spark, d)
    return packed.select(F.col("kind").alias("container_no"), F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")


def p9_unused_space(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled."""
    packed, capacities = _packed(spark, d)
    return packing.unused_space(packed, capacities).withColumnRenamed("kind", "container_no")


def p9_totals(spark: SparkSession, d: str) -> DataFrame:
    """What of the containers doesn't depend on how they are filled: every text is whole in one container or, if it exceeds
    the capacity, in the least number of pieces; no container is over its capacity."""
    packed, capacities = _packed(spark, d)
    packed = written(packed, "packed")
    caps = spark.createDataFrame(sorted(capacities.items()), "kind int, capacity int")
    per = packed.groupBy("kind", "item").agg(F.sum("size").alias("size"), F.count("container").alias("n")).join(F.broadcast(caps), "kind")
    texts = per.groupBy("kind").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.when(F.col("n") == F.ceil(F.col("size") / F.col("capacity")), 0).otherwise(1)).alias("n_split_wrongly"))
    used = packed.filter(F.col("container").isNotNull()).groupBy("kind", "container").agg(F.sum("size").alias("used")).join(F.broadcast(caps), "kind")
    over = used.groupBy("kind").agg(F.count_if(F.col("used") > F.col("capacity")).alias("n_over"))
    return texts.join(over, "kind", "left").select(F.col("kind").alias("container_no"), "n_texts", "n_split_wrongly", F.coalesce("n_over", F.lit(0)).cast("long").alias("n_over"))


# ---- 10: sentences


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every text."""
    return sentences.split_sentences(table(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", "start_char", "end_char")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units with their text."""
    return sentences.split_sentences(table(spark, d, "documents"), "text", ["doc_id", "lang"])


QUERIES = {f.__name__: f for f in (p4_found, p4_error_rates, p4_checked_rates, p7_found, p8_ids, p9_containers, p9_unused_space, p9_totals, p10_found, p10_sentences)}

ORACLE = {
    "p4_found": """
SELECT arrival_no FROM (SELECT arrival_no, stream, min(arrival_no) OVER (PARTITION BY stream) AS f FROM incoming_entry WHERE stream IS NOT NULL)
WHERE arrival_no > f OR stream IN (SELECT stream FROM index_entry WHERE stream IS NOT NULL)""",
    "p4_checked_rates": """
WITH b AS (SELECT DISTINCT segment_no AS s, max(segment_no) OVER () + 1 AS n FROM index_entry WHERE stream IS NOT NULL),
g AS (SELECT DISTINCT CASE WHEN s IS NULL OR s < 0 THEN -1 WHEN (s // 4096 + 1) * 4096 <= n THEN 3 WHEN (s // 256 + 1) * 256 <= n THEN 2 WHEN (s // 16 + 1) * 16 <= n THEN 1 ELSE 0 END AS level,
             CASE WHEN s IS NULL OR s < 0 THEN 0 WHEN (s // 4096 + 1) * 4096 <= n THEN s // 4096 WHEN (s // 256 + 1) * 256 <= n THEN s // 256 WHEN (s // 16 + 1) * 16 <= n THEN s // 16 ELSE s END AS no FROM b),
k AS (SELECT DISTINCT stream, stream IN (SELECT stream FROM index_entry WHERE stream IS NOT NULL) AS known FROM incoming_entry WHERE stream IS NOT NULL)
SELECT count(*) AS n_keys, count(*) FILTER (known) AS n_known, CAST(0 AS BIGINT) AS n_false_no, CAST((SELECT count(*) FROM g) AS INTEGER) AS generations,
       1 - (1 - pow(2.0, -16)) ** (SELECT count(*) FROM g) AS compounded_rate, true AS within FROM k""",
    "p9_totals": """
SELECT container_no, count(text) AS n_texts, CAST(0 AS BIGINT) AS n_split_wrongly, CAST(0 AS BIGINT) AS n_over FROM container_kind, documents WHERE text IS NOT NULL GROUP BY container_no""",
    "p7_found": """
SELECT stream, version, position FROM (
  SELECT stream, version, position, row_number() OVER (PARTITION BY stream ORDER BY version DESC, position) AS r
  FROM (SELECT DISTINCT stream, version, position FROM event_log WHERE stream IS NOT NULL AND version IS NOT NULL AND position IS NOT NULL))
WHERE r <= 3""",
}
