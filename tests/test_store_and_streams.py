import json

import pytest
from pyspark.sql import functions as F

from tidelog.plans import projections as P
from tidelog.schema import LOG
from tidelog.sources.store import EventStore
from tidelog.streaming import subscriptions as sub


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, f"file://{tmp_path}/store", clock=lambda: 1000)


def events(spark, *rows):
    return spark.createDataFrame([(s, t, d, None) for s, t, d in rows], "stream string, type string, data string, metadata string").coalesce(1)


def test_store_round_trip(spark, store):
    store.append(events(spark, ("a", "t", "1"), ("b", "t", "2"), ("a", "t", "3")))
    store.append(events(spark, ("a", "u", "4")), expected={"a": 1, "b": -1})
    with pytest.raises(ValueError, match="version"):
        store.append(events(spark, ("a", "u", "5")), expected={"a": 0})
    with pytest.raises(ValueError, match="reserved"):
        store.append(events(spark, ("_a", "u", "5")))
    assert [(r["version"], r["data"]) for r in store.from_stream("a").collect()] == [(0, "1"), (1, "3"), (2, "4")]
    assert store.version("a") == 2 and store.version("zzz") == -1
    created = store.log.filter("stream = '_streams'").orderBy("version").collect()
    assert sorted(json.loads(r["data"])["name"] for r in created) == ["a", "b"] and [r["version"] for r in created] == [0, 1]
    assert sorted(r["position"] for r in store.log.collect()) == list(range(6))
    store.link_to("l", store.log.filter("stream = 'a' AND version > 0").select("position", "stream", "version", "type", "data"))
    assert [r["data"] for r in store.from_stream("l").collect()] == ["3", "4"]
    assert store.get("l", 1).first()["version"] == 2
    store.emit("copy", store.log.filter("stream = 'b'"))
    assert store.from_stream("copy").first()["data"] == "2"
    store.create_stream("short", max_count=1, permissions={"ann": 1, "bob": 2}, metadata={"owner": "ann"})
    store.create_stream("short", max_count=7)  # the first creation counts
    store.update_stream("short", max_age=99)
    store.append(events(spark, ("short", "t", "x"), ("short", "t", "y")))
    assert [r["data"] for r in store.from_stream("short").collect()] == ["y"]
    short = {r["name"]: r for r in store.streams_metadata().collect()}["short"]
    assert (short["version"], short["max_count"], short["max_age"], short["permissions"], short["metadata"]) == (1, 1, 99, {"ann": 1, "bob": 2}, {"owner": "ann"})
    store.delete_stream("b")
    assert store.stream_metadata("b").count() == 0
    assert store.from_all(backward=True).first()["type"] == "_STREAM_DELETED"


def test_store_subscription_resolves_links_and_resumes(spark, store, tmp_path):
    got = []
    take = lambda batch, number: got.extend((r["link_stream"], r["stream"], r["version"]) for r in batch.collect())
    store.append(events(spark, ("a", "t", "1"), ("b", "t", "2")))
    store.link_to("l", store.log.filter("stream = 'b'"))
    store.subscribe(["a", "l"], take, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert sorted(got, key=str) == sorted([(None, "a", 0), ("l", "b", 0)], key=str)
    got.clear()
    store.append(events(spark, ("a", "t", "3"), ("c", "t", "4")))
    store.subscribe(["a", "l"], take, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert got == [(None, "a", 1)]


def rows(spark, *versions, stream="a", start=0):
    return spark.createDataFrame([(start + i, stream, "t", v, 0, None, None) for i, v in enumerate(versions)], LOG).coalesce(1)


def test_high_water_across_batches(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for k, batch in enumerate([(0, 1, 1, 2), (2, 1, 4, 3), (4, 0, 5, None)]):
        rows(spark, *batch, start=10 * k).unionByName(rows(spark, k, stream="b")).coalesce(1).write.mode("append").parquet(path)
    out = f"file://{tmp_path}/high"
    sub.above_high_water(sub.log_stream(spark, path, files_per_batch=1), out).awaitTermination()
    got = sub.high_water_output(spark, out).collect()
    assert sorted((r["stream"], r["version"], r["position"]) for r in got) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 3), ("a", 3, 13), ("a", 4, 12), ("a", 5, 22), ("b", 0, 0), ("b", 1, 0), ("b", 2, 0)]
    rows(spark, 5, 3, 7).write.mode("append").parquet(path)
    sub.above_high_water(sub.log_stream(spark, path, files_per_batch=1), out).awaitTermination()
    assert sorted(r["version"] for r in sub.high_water_output(spark, out).filter("stream = 'a'").collect()) == [0, 1, 2, 3, 4, 5, 7]


def test_stream_equals_batch(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows(spark, *range(30)).repartition(3).write.parquet(path)
    got = sub.drained(sub.of_pattern(sub.log_stream(spark, path, position=10), "a*"), "plain")
    assert sorted(r["position"] for r in got.collect()) == list(range(10, 30))
    assert sub.drained(sub.of_streams(sub.log_stream(spark, path), ["zz"]), "none").count() == 0


def log(spark):
    data = [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("a", "x", 4), ("b", "z", 5), (None, "x", 6), ("a", None, 7)]
    return spark.createDataFrame([(i, s, t, i, n, str(n), None) for i, (s, t, n) in enumerate(data)], LOG).repartition(3)


def test_projections(spark):
    p = P.Projection(log(spark)).when({"x": {"xs": P.count(), "sum": P.total(F.col("timestamp"))}, P.ANY: {"all": P.count(), "last": P.latest(F.col("type")), "first": P.first(F.col("type"))}})
    assert p.single().first().asDict() == {"xs": 4, "sum": 14, "all": 7, "last": None, "first": "x"}
    got = {r["stream"]: (r["xs"], r["all"]) for r in p.filter(F.col("stream").isNotNull()).per_stream().collect()}
    assert got == {"a": (2, 4), "b": (1, 2)}
    assert p.filter(F.lit(False)).single().first()["all"] == 0
    with pytest.raises(ValueError):
        P.Projection(log(spark)).single()


def test_ordered_folds(spark):
    step = lambda state, event: {"s": state["s"] + (event["data"] or "")}
    got = {r["stream"]: json.loads(r["state"])["s"] for r in P.fold_per_stream(log(spark), {"s": ""}, {P.ANY: step}).collect()}
    assert got == {"a": "1247", "b": "35"}
    typed = {r["stream"]: json.loads(r["state"])["s"] for r in P.fold_per_stream(log(spark), {"s": ""}, {"x": step, P.ANY: lambda s, e: s}).collect()}
    assert typed == {"a": "14", "b": "3"}
    assert P.fold_all(log(spark), {"s": ""}, {P.ANY: step}, lambda a, b: {"s": a["s"] + b["s"]}) == {"s": "1234567"}
    assert P.fold_all(log(spark).limit(0), {"s": ""}, {P.ANY: step}, lambda a, b: b) == {"s": ""}
    registry = P.Registry()
    registry.add("n", lambda df: P.Projection(df).when({P.ANY: {"n": P.count()}}).single())
    assert registry.names() == ["n"] and registry.run("n", log(spark)).first()["n"] == 7


def test_flush_events_and_versions_without_a_scan_of_the_log(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = EventStore(spark, path, clock=lambda: 1000, flush_entries=1000)
    many = spark.range(2500).select((F.col("id") % 7).cast("string").alias("stream"), F.lit("t").alias("type"), F.col("id").cast("string").alias("data"), F.lit(None).cast("string").alias("metadata"), F.col("id").alias("ordinal"))
    store.append(many)
    flushes = [json.loads(r["data"]) for r in store.log.filter("type = '_INDEX_FLUSHED'").orderBy("position").collect()]
    assert [(f["logPosition"], f["entries"]) for f in flushes] == [(999, 1000), (1999, 1000)]
    again = EventStore(spark, path, clock=lambda: 2000, flush_entries=1000)
    assert again._index.last()["position"] == 1999
    again.append(many.limit(1).withColumn("stream", F.lit("3")), expected={"3": 356})
    assert again.version("3") == 357
    tail, flushed, at = again._tail()
    assert tail.count() == again.log.count() - 2000 and flushed.count() == 8
    assert {r["stream"]: r["version"] for r in again.versions().collect()} == {r["stream"]: r["v"] for r in again.log.groupBy("stream").agg(F.max("version").alias("v")).collect()}
    # versions stay dense, and no position is given twice
    assert again.log.groupBy("stream").agg((F.max("version") + 1 == F.count_distinct("version")).alias("ok")).filter("NOT ok").count() == 0
    assert again.log.count() == again.log.select("position").distinct().count()
    with pytest.raises(ValueError, match="at least"):
        EventStore(spark, path, flush_entries=10)


def test_handlers_emit_and_link(spark, store):
    store.append(events(spark, ("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3"), ("a", "x", "4")))

    def on_x(state, event, out):
        out.emit("xs", event)
        out.link_to("links", event)
        return {"n": state["n"] + 1}

    got = {r["stream"]: json.loads(r["state"])["n"] for r in store.project(["a", "b"], {"n": 0}, {"x": on_x}).collect()}
    assert got == {"a": 2, "b": 1}
    assert [(r["version"], r["data"]) for r in store.from_stream("xs").collect()] == [(0, "1"), (1, "3"), (2, "4")]
    assert [(r["stream"], r["version"], r["link_version"]) for r in store.from_stream("links").collect()] == [("a", 0, 0), ("b", 0, 1), ("a", 2, 2)]


def test_subscribing_to_all_resolves_links(spark, store, tmp_path):
    store.append(events(spark, ("a", "t", "1")))
    store.link_to("l", store.log.filter("stream = 'a'"))
    got = []
    store.subscribe_all(lambda batch, n: got.extend((r["link_stream"], r["stream"]) for r in batch.collect()), f"file://{tmp_path}/all").awaitTermination()
    assert sorted(got, key=str) == sorted([("l", "a"), (None, "a"), (None, "_streams"), (None, "_streams")], key=str)
    got.clear()
    store.poll(["a"], lambda batch, n: got.extend(r["version"] for r in batch.collect()), f"file://{tmp_path}/poll", 6)
    assert got == [0]
