import random

import numpy as np
import pytest

from tidelog import session
from tidelog.llm import topn

SCHEMA = "stream string, version int, position long, rank int, grp string, bound long"


def brute(rows, n):
    out = []
    clean = {(r[0], r[1], r[2]) for r in rows if None not in r[:3]}
    for s in {r[0] for r in clean}:
        out += [(*r, i + 1) for i, r in enumerate(sorted((r for r in clean if r[0] == s), key=lambda r: (-r[1], r[2]))[:n])]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_equals_brute_force_with_hot_groups_ties_and_repeats(spark, n):
    rnd = random.Random(n)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice(["", "b", None, *map(str, range(40))]), rnd.choice([None, *range(-5, 60)]), rnd.choice([None, *range(200)]), 9, "g", 9) for _ in range(3000)]
    rows += rows[:100] + [("tied", 1, p, 9, "g", 9) for p in range(100)] + [("same", 2, 2, 9, "g", 9)] * 50
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert sorted(map(tuple, topn.top_n(df, "stream", "version", "position", n).collect())) == brute(rows, n)


def test_extremes_empty_and_bad_n(spark):
    rows = [("a", 2**31 - 1, -(2**63), 0, "", 0), ("a", -(2**31), 2**63 - 1, 0, "", 0)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r)[:3] for r in topn.top_n(df, "stream", "version", "position", 1).collect()] == [rows[0][:3]]
    assert topn.top_n(df.limit(0), "stream", "version", "position", 3).count() == 0
    assert topn.top_n(df, "stream", "version", "position", 3).schema["version"].dataType.simpleString() == "int"
    with pytest.raises(ValueError):
        topn.top_n(df, "stream", "version", "position", 0)


@pytest.mark.parametrize("per_partition", [3, 25, 200])
def test_every_group_with_n_items_in_a_partition_has_a_bound(spark, per_partition):
    rows = [("hot", i * 37 % 1000, i, 0, "", 0) for i in range(8 * per_partition)] + [("few", i, i, 0, "", 0) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8).selectExpr("stream AS grp", "CAST(version AS LONG) AS score", "position AS tie")
    tops = topn.local_tops(df, 3)
    scores = sorted({r[1] for r in rows[: 8 * per_partition]}, reverse=True)
    bounds = {b["grp"]: b["bound"]["score"] for b in topn.group_bounds(tops, 3).collect()}
    assert list(bounds) == ["hot"] and bounds["hot"] <= scores[2]
    assert tops.filter("grp = 'hot'").count() <= 8 * 3


def test_the_buffer_is_sorted_only_when_it_has_doubled(monkeypatch):
    monkeypatch.setattr(topn, "BUFFER_ROWS", 8)
    sorts = []
    real = topn._best
    monkeypatch.setattr(topn, "_best", lambda *a: sorts.append(len(a[0])) or real(*a))
    b = topn._Buffer(2)
    for i in range(1000):
        b.add(np.arange(i * 10, i * 10 + 10), np.arange(10), np.arange(10))
    assert len(b.best()[0]) == 10_000 and sum(sorts) < 5 * 10_000


def test_bounds_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randrange(30)}", rnd.randrange(50), rnd.randrange(9), 9, "g", 9) for _ in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert sorted(map(tuple, topn.top_n(df, "stream", "version", "position", 3).collect())) == brute(rows, 3)
