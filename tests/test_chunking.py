import random

from pyspark.sql import functions as F

from tidelog.operators import chunking

SCHEMA = "stream string, version int, position long, row_no int, chunk string, key int"


def brute(rows):
    out = {}
    for s in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2] is not None, r[2] or 0, r[1] is not None, r[1] or 0))
        versions = [r[1] for r in own if r[1] is not None]
        at = [r[2] for r in own if r[2] is not None]
        out[s] = (
            len(own), len(versions), min(versions, default=None), max(versions, default=None), versions[0] if versions else None, versions[-1] if versions else None,
            min(at, default=None), max(at, default=None), sum(b < a for a, b in zip(versions, versions[1:])), max((b - a for a, b in zip(at, at[1:])), default=None),
        )
    return out


def test_summary_equals_brute_force_with_a_hot_key_nulls_and_repeats(spark):
    rnd = random.Random(4)
    rows = []
    for p in range(600):
        stream = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", "", "c", None])
        rows.append((stream, rnd.choice([None, *range(30)]), rnd.choice([None, p]) if rnd.random() < 0.05 else p, 1, "x", 2))
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for size, parts in ((7, 5), (100_000, 64), (1, 2)):
        got = {r["key"]: tuple(r)[1:] for r in chunking.key_summary(df, "stream", "version", "position", size, parts).collect()}
        assert got == brute(rows)


def test_numbers_are_dense_per_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("stream"), (F.col("id") * 7919 % 1000).alias("position"))
    n = chunking.number_rows(df, "stream", ["position"], parts=9)
    rows = n.collect()
    for s in {r["stream"] for r in rows}:
        own = sorted((r["position"], r["row_no"]) for r in rows if r["stream"] == s)
        assert [x for _, x in own] == list(range(1, len(own) + 1))


def test_one_order_value_and_empty_and_only_nulls(spark):
    same = spark.createDataFrame([("a", 1, 5)] * 20 + [("b", 2, 5)], "stream string, version int, position long")
    assert {(r["key"], r["n_rows"]) for r in chunking.key_summary(same, "stream", "version", "position", 3, 4).collect()} == {("a", 20), ("b", 1)}
    assert chunking.key_summary(same.limit(0), "stream", "version", "position").count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 3, "stream string, version int, position long")
    assert chunking.key_summary(nulls, "stream", "version", "position").count() == 0
    assert chunking.heavy_keys(nulls, "stream", "version", "position").count() == 0


def test_heavy_keys_count_null_rows_in_the_total(spark):
    rows = [("a", 1, i) for i in range(1)] + [(None, 1, i) for i in range(99)]
    df = spark.createDataFrame(rows, "stream string, version int, position long")
    assert [r["key"] for r in chunking.heavy_keys(df, "stream", "version", "position").collect()] == ["a"]
    df = spark.createDataFrame(rows + [(None, 1, 100)], df.schema)
    assert chunking.heavy_keys(df, "stream", "version", "position").count() == 0


def test_ordered_offsets(spark):
    rnd = random.Random(9)
    rows = [(f"k{i:04}", rnd.randrange(5)) for i in range(500)]
    got = {r["k"]: r["before"] for r in chunking.ordered_offsets(spark.createDataFrame(rnd.sample(rows, 500), "k string, n int").repartition(7), "k", "n").collect()}
    total = 0
    for k, n in rows:
        assert got[k] == total
        total += n
    assert chunking.ordered_offsets(spark.createDataFrame([], "k string, n int"), "k", "n").count() == 0


def test_bounds_cut_evenly_whatever_the_input_partitions_hold(spark):
    # one input partition holds nine tenths of the rows
    df = spark.range(90_000).select((F.col("id") * 7919 % 90_000).alias("p")).coalesce(1).union(spark.range(90_000, 100_000).select(F.col("id").alias("p")).repartition(5))
    total, bounds = chunking.order_sketch(df, F.col("p"), 20)
    assert total == 100_000 and len(bounds) == 19
    sizes = [r["count"] for r in chunking.with_part(df, "p", bounds, "part").groupBy("part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 5_000


def test_parts_of_many_bounds(spark):
    bounds = list(range(0, 5000, 7))
    df = spark.range(-20, 5020).withColumn("p", F.when(F.col("id") % 50 != 0, F.col("id")))
    for r in chunking.with_part(df, "p", bounds, "part").collect():
        assert r["part"] == (0 if r["p"] is None else sum(b <= r["p"] for b in bounds))
    doubles = chunking.with_part(spark.createDataFrame([(0.5,), (1.5,), (9.0,)], "p double"), "p", [1.0, 2.0], "part")
    assert [r["part"] for r in doubles.orderBy("p").collect()] == [0, 1, 2]


def test_rows_are_shuffled_once_and_a_hot_key_is_spread(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("stream"), F.col("id").cast("int").alias("version"), F.col("id").alias("position"))
    rows = chunking._placed(df.withColumnRenamed("stream", "key"), "key", ["position", "version"], list(range(0, 40_000, 500)))
    sizes = [r["count"] for r in rows.filter("key = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    out = chunking.key_summary(df, "stream", "version", "position", parts=40)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
