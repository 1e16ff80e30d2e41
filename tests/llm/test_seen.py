import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import seen

SEALED = "stream long, segment_no int, n long, hits int"
INCOMING = "arrival_no long, stream long, key string, hot boolean"


def test_filter_never_forgets_and_rarely_invents():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 2**63, 20_000, dtype=np.uint64))
    seed, block, prints = seen.build_filter(keys)
    assert seen.contains(keys, seed, block, prints).all()
    assert len(prints) < 1.25 * len(keys) + 64
    foreign = rnd.integers(2**63, 2**64, 400_000, dtype=np.uint64)
    assert seen.contains(foreign, seed, block, prints).mean() < 5 / 2**seen.BITS
    for n in (0, 1, 2, 3, 10):
        few = keys[:n]
        assert seen.contains(few, *seen.build_filter(few)).all()


@pytest.mark.parametrize("shard_keys", [500_000, 40])
def test_rows_equal_brute_force(spark, monkeypatch, tmp_path, shard_keys):
    monkeypatch.setattr(seen, "SHARD_KEYS", shard_keys)
    rnd = np.random.default_rng(2)
    sealed = [(int(rnd.integers(0, 300)), int(rnd.integers(0, 9)), 1, 1) for _ in range(500)] + [(None, 1, 1, 1), (1000, None, 1, 1)]
    incoming = [(i, None if rnd.random() < 0.05 else 7777 if rnd.random() < 0.4 else int(rnd.integers(0, 900)), "k", True) for i in range(1500)]
    known = {r[0] for r in sealed} - {None}
    want, before = set(), set()
    for i, k, *_ in incoming:
        if k is not None and (k in known or k in before):
            want.add(i)
        before.add(k)
    s = spark.createDataFrame(sealed, SEALED)
    x = spark.createDataFrame(incoming, INCOMING).orderBy("stream").repartition(3)
    store = seen.FilterStore(spark, f"file://{tmp_path}/filters")
    got = seen.seen_rows(s, x, "stream", "arrival_no", "segment_no", store)
    assert got.columns == ["arrival_no", "stream", "key", "hot"]
    rows = [r["arrival_no"] for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    report = seen.error_report(s, x, "stream", "arrival_no", "segment_no", store).first()
    assert report["n_false_no"] == 0 and report["n_known"] == len({k for _, k, *_ in incoming if k in known})
    assert report["generations"] == 10  # nine batches and the rows without one
    assert report["compounded_rate"] == pytest.approx(10 / 2**16, rel=1e-3)
    assert report["n_false_yes"] <= 5


def test_empty_tables(spark):
    s, x = spark.createDataFrame([(5, 0, 1, 1)], SEALED), spark.createDataFrame([(1, 5, "a", True), (2, 6, "a", True), (3, 6, "a", True)], INCOMING)
    ids = lambda s, x: sorted(r["arrival_no"] for r in seen.seen_rows(s, x, "stream", "arrival_no", "segment_no").collect())

    assert ids(s, x) == [1, 3]
    assert ids(s.limit(0), x) == [3]
    assert ids(s, x.limit(0)) == []


def sealed_rows(spark, batches, per=20):
    return spark.createDataFrame([(b * 1000 + i, b, 1, 1) for b in batches for i in range(per)], SEALED)


def built(store):
    return {(r["level"], r["generation"]) for r in store.filters().select("level", "generation").collect()}


def test_a_new_batch_builds_its_own_filter_only(spark, tmp_path):
    store = seen.FilterStore(spark, f"file://{tmp_path}/filters")
    store.seal(sealed_rows(spark, range(5)), "stream", "segment_no")
    runs = lambda: sorted(p.name for p in tmp_path.joinpath("filters").iterdir())
    first = runs()
    assert built(store) == {(0, b) for b in range(5)} and len(first) == 1
    store.seal(sealed_rows(spark, range(5)), "stream", "segment_no")
    assert runs() == first
    store.seal(sealed_rows(spark, range(6)), "stream", "segment_no")
    (new,) = set(runs()) - set(first)
    assert [(r["level"], r["generation"], r["n_keys"]) for r in spark.read.parquet(f"file://{tmp_path}/filters/{new}").collect()] == [(0, 5, 20)]
    # the sixteenth batch completes a group, which is then asked instead of its batches
    wanted, now = store.seal(sealed_rows(spark, range(18)), "stream", "segment_no")
    assert len(wanted) == 3
    assert {(r["level"], r["generation"]) for r in now.collect()} == {(1, 0), (0, 16), (0, 17)}
    # a batch that got other rows after all has another filter
    _, late = store.seal(sealed_rows(spark, range(18)).union(spark.createDataFrame([(-1, 17, 1, 1)], SEALED)), "stream", "segment_no")
    assert {(r["level"], r["generation"]): r["n_keys"] for r in late.collect()} == {(1, 0): 320, (0, 16): 20, (0, 17): 21}


def test_answers_come_from_the_filters(spark, tmp_path, monkeypatch):
    s = sealed_rows(spark, range(3))
    x = spark.createDataFrame([(i, k, "a", True) for i, k in enumerate([0, 1000, 2005, 77, 88, 99])], INCOMING)

    def asked(label):
        store = seen.FilterStore(spark, f"file://{tmp_path}/{label}")
        keys = seen.probed_keys(s, x, "stream", "arrival_no", "segment_no", store).collect()
        return {r["key"] for r in keys if r["hits"]}, {r["key"] for r in keys if r["known"]}

    assert asked("as it is") == ({0, 1000, 2005}, {0, 1000, 2005})
    monkeypatch.setattr(seen, "contains", lambda keys, *a: np.zeros(len(keys), bool))
    assert asked("always no") == (set(), set())  # no key with a no is looked up
    monkeypatch.setattr(seen, "contains", lambda keys, *a: np.ones(len(keys), bool))
    assert asked("always yes") == ({0, 1000, 2005, 77, 88, 99}, {0, 1000, 2005})


def test_more_generations_than_are_asked_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "ASKED_TOGETHER", 4)
    monkeypatch.setattr(seen, "FAN_OUT", 1000)
    s = sealed_rows(spark, range(40), 5)
    x = spark.createDataFrame([(b, b * 1000 + 2, "a", True) for b in range(40)] + [(100 + b, -b - 1, "a", True) for b in range(40)], INCOMING)
    store = seen.FilterStore(spark, f"file://{tmp_path}/filters")
    assert {r["arrival_no"] for r in seen.seen_rows(s, x, "stream", "arrival_no", "segment_no", store).collect()} == set(range(40))


def test_generations_are_few(spark):
    batches = spark.range(2000).select(F.col("id").alias("stream"), F.col("id").alias("segment_no"))
    rows = seen.with_generation(batches, "stream", "segment_no", 2000).groupBy("level").agg(F.count_distinct("generation").alias("n")).collect()
    assert {r["level"]: r["n"] for r in rows} == {2: 7, 1: 13}
