from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog.operators import incremental

T0 = datetime(2020, 1, 1)
RUNS = "run_id long, report_no int, segment_no int, status string, read_until timestamp_ntz, last_position long, reported_at timestamp_ntz, mark int"
ENTRIES = "stream long, version int, position long, segment_no int, written_at timestamp_ntz, old string, now string"


def at(h):
    return T0 + timedelta(hours=h)


def test_marks_take_the_last_report_of_each_run(spark):
    rows = [
        (1, 0, 0, "started", at(5), None, at(9), 0), (1, 1, 0, "OK", at(5), None, at(8), 0),
        (2, 1, 0, "ok", at(9), 1, at(9), 0), (2, 2, 0, "rolled_back", at(9), 1, at(9), 0),
        (3, 1, 1, "failed", at(9), 1, at(9), 0), (3, 0, 1, "ok", at(9), 1, at(9), 0),
        (4, 0, 2, " Ok", at(3), 1, at(9), 0), (4, 0, 2, " Ok", at(3), 1, at(9), 0), (5, 0, 2, "ok", at(2), 1, at(9), 0),
        (None, 0, 3, "ok", at(2), 1, at(9), 0), (6, None, 3, "ok", at(2), 1, at(9), 0), (7, 0, None, "ok", at(2), 1, at(9), 0), (8, 0, 4, None, at(2), 1, at(9), 0), (9, 0, 5, "ok", None, 1, at(9), 0),
    ]
    got = {r["segment_no"]: r["mark"] for r in incremental.segment_marks(spark.createDataFrame(rows, RUNS)).collect()}
    assert got == {0: at(5), 2: at(3)}


def test_changes_against_the_state_at_the_mark(spark):
    e = [
        (1, 0, 10, 0, at(1)), (1, 0, 10, 0, at(6)),  # same position again: unchanged
        (1, 1, 11, 0, at(1)), (1, 1, 12, 0, at(6)),  # changed
        (1, 2, 13, 0, at(6)), (1, 2, 13, 0, at(6)),  # new, stored twice
        (1, 3, 14, 0, at(5)),  # at the mark itself
        (1, 4, 15, 0, at(1)), (1, 4, 16, 0, at(6)), (1, 4, 15, 0, at(7)),  # changed and back
        (2, 0, 20, 1, at(1)),  # segment without a mark
        (2, 1, 21, None, at(1)), (None, 1, 21, 0, at(9)), (2, None, 21, 0, at(9)), (3, 3, 21, 0, None),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in e], ENTRIES)
    marks = spark.createDataFrame([(0, at(5))], "segment_no int, mark timestamp_ntz")
    got = {(r["stream"], r["version"]): (r["position"], r["old_position"]) for r in incremental.changed_entries(df, marks).collect()}
    assert got == {(1, 1): (12, 11), (1, 2): (13, None), (2, 0): (20, None), (2, 1): (21, None)}
    early = incremental.changed_entries(df, marks, at(6)).select("stream", "version").collect()
    assert (1, 4) in {tuple(r) for r in early}
    assert incremental.changed_entries(df.limit(0), marks).count() == 0
    assert incremental.changed_entries(df, marks.limit(0)).count() == 7


def test_runs_commit_output_and_watermark_together(spark, tmp_path):
    source = tmp_path / "source"
    add = lambda a, b: spark.range(a, b).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("k")).write.mode("append").parquet(f"file://{source}")
    read = lambda: spark.read.parquet(f"file://{source}")
    commits = incremental.Commits(spark, f"file://{tmp_path}/job")
    schema = "seq long, k long"
    assert commits.output(schema).count() == 0
    add(0, 10)
    assert incremental.run_once(read, commits, lambda df: df, "seq")["watermark"] == "9"
    assert incremental.run_once(read, commits, lambda df: df, "seq") is None
    add(10, 25)

    def fail(df):
        return df.select("seq", F.raise_error(F.lit("broken")).cast("long").alias("k"))

    with pytest.raises(Exception, match="broken"):
        incremental.run_once(read, commits, fail, "seq")
    assert commits.output(schema).count() == 10  # nothing of the failed run
    incremental.run_once(read, commits, lambda df: df, "seq", limit=17)
    incremental.run_once(read, commits, lambda df: df, "seq")
    rows = commits.output(schema).collect()
    assert sorted(r["seq"] for r in rows) == list(range(25))
    assert {r["commit_no"] for r in rows if r["seq"] in (18, 24)} == {3}
    with pytest.raises(RuntimeError, match="exists"):
        commits.publish(3, {})


def test_segment_runs_take_each_change_once_and_survive_a_killed_run(spark, tmp_path, monkeypatch):
    reported = spark.createDataFrame([(0, at(5))], "segment_no int, mark timestamp_ntz")
    e = [(1, 0, 10, 0, at(1)), (1, 0, 11, 0, at(6)), (1, 1, 12, 0, at(3)), (2, 0, 20, 1, at(2)), (3, 0, 30, None, at(4))]
    later = [(1, 1, 13, 0, at(8)), (2, 0, 20, 1, at(9)), (2, 1, 21, 1, at(9)), (4, 0, 40, 2, at(7))]
    frame = lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], ENTRIES)
    commits = incremental.Commits(spark, f"file://{tmp_path}/runs")
    read = lambda: sorted((r["stream"], r["version"], r["position"], r["old_position"], r["commit_no"]) for r in commits.output(incremental.CHANGED, "/changed").collect())
    first = [(1, 0, 11, 10, 1), (2, 0, 20, None, 1), (3, 0, 30, None, 1)]
    incremental.run_segments(frame(e), commits, reported)
    assert read() == first
    # a run that dies between its output and its commit leaves nothing
    monkeypatch.setattr(incremental.Commits, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        incremental.run_segments(frame(e + later), commits, reported)
    monkeypatch.undo()
    assert read() == first
    incremental.run_segments(frame(e + later), commits, reported)
    second = [(1, 1, 13, 12, 2), (2, 1, 21, None, 2), (4, 0, 40, None, 2)]
    assert read() == sorted(first + second)
    incremental.run_segments(frame(e + later), commits, reported)  # nothing is new
    assert read() == sorted(first + second)


def test_a_commit_is_created_only_if_absent(spark, tmp_path):
    commits = incremental.Commits(spark, f"file://{tmp_path}/runs")
    commits.publish(1, {"number": 1, "folder": "a"})
    other = incremental.Commits(spark, f"file://{tmp_path}/runs")
    with pytest.raises(RuntimeError, match="exists"):
        other.publish(1, {"number": 1, "folder": "b"})
    assert [c["folder"] for c in commits.all()] == ["a"]
    assert commits.last()["folder"] == "a"
    commits._rename = None  # not used on a local file system
    commits.publish(2, {"number": 2, "folder": "c"})
    assert commits.numbers() == [1, 2]


def test_a_small_change_to_a_large_history_shuffles_little(spark):
    old = spark.range(200_000).select((F.col("id") % 1000).alias("stream"), (F.col("id") / 1000).cast("int").alias("version"), F.col("id").alias("position"), F.lit(0).alias("segment_no"), F.lit(at(1)).cast("timestamp_ntz").alias("written_at"))
    new = spark.createDataFrame([(5, 5, 1, 0, at(9)), (5, 5000, 2, 0, at(9))], "stream long, version int, position long, segment_no int, written_at timestamp_ntz")
    marks = spark.createDataFrame([(0, at(5))], "segment_no int, mark timestamp_ntz")
    out = incremental.changed_entries(old.unionByName(new), marks)
    assert sorted(tuple(r) for r in out.select("stream", "version", "old_position").collect()) == [(5, 5, 5005), (5, 5000, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
