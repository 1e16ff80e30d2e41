import os
import random

import pytest

from tidelog import session


@pytest.mark.parametrize("most_bytes", [session.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_by_key_equals_a_join(spark, monkeypatch, most_bytes, how):
    monkeypatch.setattr(session, "BROADCAST_BYTES", most_bytes)
    rnd = random.Random(1)
    rows = spark.createDataFrame([(rnd.choice(["hot"] * 5 + [None, "a", "b", "c"]), i) for i in range(500)], "k string, n int")
    side = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3), (None, 4)], "k string, m int")
    got = session.join_by_key(rows, side, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(side, "k", how).select(*got.columns).collect()))
    for merge in (True, False):
        assert session.join_by_key(rows.limit(0), side, ["k"], how, merge=merge).count() == 0


def test_no_task_gets_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("n")).repartition(8)
    side = spark.range(-1, 40_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("m"))
    out = session.join_by_key(rows, side, ["k"], "inner")
    sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect())
    assert sum(sizes) == 40_000 and sizes[-1] <= 2.1 * sizes[len(sizes) // 2]


def test_bytes_of_values(spark):
    df = spark.createDataFrame([("abc", 1, {"a": 1}), (None, None, None)], "s string, n int, m map<string,int>")
    assert 30 < session.value_bytes(df) < 90
    assert session.value_bytes(df.limit(0)) == 0


def test_scratch_is_removed_and_paths_are_resolved(spark):
    with session.scratch(spark):
        df = session.written(spark.range(3), "kept")
        path = session.local_path(spark, session._scratch[-1])
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)
    assert session.local_path(spark, "/x/y") == "/x/y"  # the default file system is the local one here
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://127.0.0.1:8020")
    try:
        assert session.local_path(spark, "/x/y") is None and session.local_path(spark, "file:///x/y") == "/x/y"
    finally:
        conf.set("fs.defaultFS", before)
