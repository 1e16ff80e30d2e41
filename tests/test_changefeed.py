import json
import random

import pytest
from pyspark.sql import functions as F

from tidelog import session
from tidelog.operators import changefeed as cf
from tidelog.operators import catalog

LOG = "stream string, version int, position long, type string, data string, key string, seq int"


def apply(changes):
    """The feed applied one change after the other."""
    state, ever = {}, set()
    for seq, op, key, age in sorted(changes):
        if op == "created" and key not in state:
            state[key] = [seq, seq, age]
            ever.add(key)
        elif op == "updated" and key in state:
            state[key][1] = seq
            state[key][2] = age if age is not None else state[key][2]
        elif op == "deleted":
            state.pop(key, None)
    return state, ever


def test_equals_sequential_application(spark):
    rnd = random.Random(1)
    changes = [(i, rnd.choice(["created", "updated", "updated", "deleted"]), f"k{rnd.choice([0, 0, 0, *range(40)])}", rnd.choice([None, 1, 2, 3])) for i in range(900)]
    df = spark.createDataFrame([(*c[:3], c[3] if c[1] != "deleted" else None) for c in rnd.sample(changes, len(changes))], "seq int, op string, key string, max_age int").repartition(3)
    state, ever = apply(changes)
    got = cf.current_state(cf.change_files(df), ("max_age",)).collect()
    assert {r["key"]: [r["first_seq"], r["last_seq"], r["max_age"]] for r in got} == state
    lazily = cf.state_of(df, ("max_age",)).collect()
    assert {r["key"]: [r["first_seq"], r["last_seq"], r["max_age"]] for r in lazily} == state
    lives = {r["key"]: r["valid_to"] for r in cf.lifetimes(df).collect()}
    assert set(lives) == ever
    assert {k for k, to in lives.items() if to is None} == set(state)


def event(version, kind, data, stream="_streams", position=None):
    return (stream, version, version if position is None else position, kind, data, "k", 7)


def test_reading_changes(spark):
    made = json.dumps({"name": "a", "maxAge": 5, "permissions": {"u": 1}})
    rows = [
        event(1, "_STREAM_CREATED", made), event(1, "_STREAM_CREATED", made, position=99),
        event(2, "_STREAM_UPDATED", '{"na\\u006de" : "a", "maxCount": 3}'), event(3, "_STREAM_DELETED", '{"stream":"b"}'),
        event(4, "_STREAM_CREATED", None), event(5, "_STREAM_CREATED", ""), event(6, "_STREAM_CREATED", '{"name":"c"'), event(7, "_STREAM_CREATED", '["name"]'),
        event(8, "_STREAM_CREATED", '{"name":"c"} {"name":"d"}'), event(9, "_STREAM_CREATED", '{"name":null}'), event(10, "_STREAM_CREATED", '{"stream":"c"}'),
        event(None, "_STREAM_CREATED", '{"name":"c"}', position=3), event(11, None, '{"name":"c"}'), event(12, "_STREAM_CREATED", '{"name":"c"}', stream=None), event(13, "other", '{"name":"c"}'), event(14, "_STREAM_CREATED", '{"name":"c"}', stream="x"),
    ]
    log = spark.createDataFrame(rows, LOG)
    got = {r["seq"]: (r["op"], r["key"], r["max_age"], r["max_count"]) for r in cf.catalog_changes(log).collect()}
    assert got == {1: ("created", "a", 5, None), 2: ("updated", "a", None, 3), 3: ("deleted", "b", None, None)}
    state = cf.current_state(cf.change_files(cf.catalog_changes(log))).collect()
    assert [(r["key"], r["last_seq"], r["max_age"], r["max_count"], r["permissions"]) for r in state] == [("a", 2, 5, 3, {"u": 1})]
    assert cf.current_state(cf.change_files(cf.catalog_changes(log.limit(0)))).count() == 0


def test_catalog_replay_first_creation_wins_and_delete_ends(spark):
    rows = [
        event(1, "_STREAM_CREATED", '{"name":"a","created":1}'), event(2, "_STREAM_CREATED", '{"name":"a","created":2}'), event(3, "_STREAM_DELETED", '{"stream":"a"}'),
        event(5, "_STREAM_CREATED", '{"name":"a","created":5}'), event(4, "_STREAM_UPDATED", '{"name":"a","maxAge":9}'), event(6, "_STREAM_CREATED", '{"name":"b","created":6}'), event(7, "_STREAM_DELETED", '{"stream":"b"}'),
    ]
    got = catalog.replay(spark.createDataFrame(rows, LOG)).select("name", "created", "max_age").collect()
    assert [tuple(r) for r in got] == [("a", 5, None)]


def test_very_long_data(spark):
    big = json.dumps({"name": "n" * 300_000, "x": "y" * 300_000})
    log = spark.createDataFrame([event(1, "_STREAM_CREATED", big)], LOG)
    assert cf.catalog_changes(log).select(F.length("key").alias("n")).first()["n"] == 300_000


@pytest.mark.parametrize("most_bytes", [session.BROADCAST_BYTES, 0])
def test_batches_of_files_with_a_hot_key(spark, tmp_path, monkeypatch, most_bytes):
    monkeypatch.setattr(session, "BROADCAST_BYTES", most_bytes)
    rnd = random.Random(3)
    changes = [(i, rnd.choice(["created", "updated", "updated", "deleted"]), "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}", rnd.choice([None, 1, 2])) for i in range(2000)]
    state, _ = apply(changes)
    files = cf.ChangeFiles(spark, f"file://{tmp_path}/changes")
    assert cf.current_state(files, ()).count() == 0
    mixed = rnd.sample(changes, len(changes))
    # out of order over three batches, and the second one delivers rows of the first again
    for part in (mixed[:900], mixed[700:1400], mixed[1400:]):
        files.append(spark.createDataFrame([(s, o, k, a if o != "deleted" else None) for s, o, k, a in part], "seq int, op string, key string, max_age int").repartition(3))
    again = cf.ChangeFiles(spark, f"file://{tmp_path}/changes")  # another reader
    assert {r["commit"] for r in again.deletes().select(F.lit(1).alias("commit")).collect()} == {1}
    got = cf.current_state(again, ("max_age",)).collect()
    assert {r["key"]: [r["first_seq"], r["last_seq"], r["max_age"]] for r in got} == state


def test_files_without_a_commit_do_not_exist(spark, tmp_path):
    files = cf.ChangeFiles(spark, f"file://{tmp_path}/changes")
    rows = lambda *r: spark.createDataFrame(list(r), "seq int, op string, key string")
    files.append(rows((1, "created", "a"), (2, "other", "b")))
    _, folder = files.commits.next_folder()
    rows((2, "deleted", "a")).withColumn("kind", F.lit("delete")).write.partitionBy("kind").parquet(folder)  # a run that died before its commit
    assert [r["key"] for r in cf.current_state(files, ()).collect()] == ["a"]
    files.append(rows((0, "deleted", "a"), (5, "created", "c")))
    assert sorted(r["key"] for r in cf.current_state(files, ()).collect()) == ["a", "c"]


def test_the_last_value_of_a_repeated_key_counts(spark):
    log = spark.createDataFrame([event(1, "_STREAM_CREATED", '{"name":"a","name":"b","maxAge":1}')], LOG)
    assert [(r["key"], r["max_age"]) for r in cf.catalog_changes(log).collect()] == [("b", 1)]
