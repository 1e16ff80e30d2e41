import pytest

from tidelog import session
from tidelog.operators import references as rf

LOG = "position long, stream string, type string, version int, timestamp long, data string, status string, salt int"
ROWS = [
    (1, "_streams", "_STREAM_CREATED", 0, 0, '{"name":"gone"}'), (2, "_streams", "_STREAM_DELETED", 1, 0, '{"stream":"gone"}'), (3, "_streams", "_STREAM_CREATED", 2, 0, '{"name":"a@b"}'),
    (4, "gone", "x", 0, 0, None), (5, "a@b", "x", 7, 0, None), (50, "late", "x", 0, 0, None), (60, "late", "x", 0, 0, None),
    (10, "l", "_>", 0, 0, "a@b@7"), (11, "l", "_>", 1, 86_400_000, "gone@0"), (12, "l", "_>", 2, None, "late@0"), (13, "l", "_>", 3, 0, "nobody@0"), (14, "l", "_>", 4, 0, "a@b"), (15, "l", "_>", 5, 0, ""),
    (16, "l", "_>", 6, 0, None), (17, "l", "_>", 7, 0, "a@b@07"), (18, "l", "_>", 8, 0, "late@99999999999"), (55, "l", "_>", 9, 0, "late@0"), (19, "l", "_>", 9, 0, "late@0"), (70, "l", "_>", 10, 0, "late@0"), (71, "l", "_>", 11, 0, "@0"),
    (20, "u", "t", 0, 0, '{"cause":"gone@0"}'), (21, "u", "t", 1, 0, '{"cause":null}'), (22, "u", None, 2, 0, '{"c\\u0061use":"nobody@1"}'), (23, "u", "t", 3, 0, '{"x":{"cause":"nobody@1"}}'), (24, "u", "t", 4, 0, "cause"), (25, "u", "t", None, 0, '{"cause":"nobody@1"}'),
    (26, None, "_>", 3, 0, "nobody@0"), (27, "u", "t", 5, 0, '{"cause":17}'), (28, "_x", "t", 0, 0, '{"cause":"nobody@1"}'), (29, "u", "t", 6, 0, '{"cause":"a@b@7"'), (None, "u", "t", 7, 0, '{"cause":"a@b@7"}'),
    (30, "_index", "_INDEX_FLUSHED", 0, 0, '{"logPosition":29}'), (31, "_index", "_INDEX_FLUSHED", 1, 0, '{"logPosition":999}'), (32, "_index", "_INDEX_FLUSHED", 2, 0, '{"logPosition":50}'), (33, "_index", "_INDEX_FLUSHED", 3, 0, "{}"), (34, "_index", "_INDEX_FLUSHED", 4, 0, '{"logPosition":26}'),
]


def test_every_status(spark):
    log = spark.createDataFrame([(*r, "fine", 3) for r in ROWS], LOG).repartition(3)
    got = {(r["stream"], r["version"]): r["status"] for r in rf.judged_references(log).collect()}
    assert got == {
        ("l", 0): "fine", ("l", 1): "deleted", ("l", 2): "late", ("l", 3): "missing", ("l", 4): "missing", ("l", 5): "missing", ("l", 6): "missing", ("l", 7): "fine", ("l", 8): "missing", ("l", 9): "late", ("l", 10): "fine", ("l", 11): "missing",
        ("u", 0): "deleted", ("u", 2): "missing", ("u", 5): "missing", ("u", 7): "fine",
        ("_index", 0): "fine", ("_index", 1): "missing", ("_index", 2): "late", ("_index", 4): "fine",
    }
    broken = {tuple(r) for r in rf.broken_references(log).collect()}
    assert broken == {k for k, s in got.items() if s != "fine"}
    days = {(r["kind"], r["day"], r["status"]): r["n_references"] for r in rf.reference_report(log).collect()}
    assert days[("link", "1970-01-02", "deleted")] == 1 and days[("link", None, "late")] == 1
    assert rf.broken_references(log.limit(0)).count() == 0


@pytest.mark.parametrize("most_bytes", [session.BROADCAST_BYTES, 0])
def test_a_target_named_by_half_of_all_references(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(session, "BROADCAST_BYTES", most_bytes)
    rows = [(0, "t", "x", 0, 0, None)] + [(i, f"l{i % 50}", "_>", i, 0, "t@0" if i % 2 else f"t@{i}" if i % 3 else "gone@1") for i in range(1, 3001)]
    rows += [(5000, "_streams", "_STREAM_CREATED", 0, 0, '{"name":"gone"}'), (5001, "_streams", "_STREAM_DELETED", 1, 0, '{"stream":"gone"}'), (5002, "gone", "x", 1, 0, None)]
    log = spark.createDataFrame([(*r, "fine", 3) for r in rows], LOG).repartition(4)
    got = {(r["stream"], r["version"]): (r["status"], r["target_end"]) for r in rf.judged_references(log).collect()}
    assert len(got) == 3000
    for i in range(1, 3001):
        assert got[(f"l{i % 50}", i)] == (("fine", None) if i % 2 else ("missing", None) if i % 3 else ("deleted", 1))


def test_a_flush_event_with_a_cause_and_long_positions(spark):
    rows = [(1, "u", "_INDEX_FLUSHED", 0, 0, '{"logPosition":1,"cause":"nobody@0"}'), (2, "_index", "_INDEX_FLUSHED", 0, 0, '{"logPosition":9223372036854775807}'), (9223372036854775807, "_index", "_INDEX_FLUSHED", 1, 0, '{"logPosition":9223372036854775807}')]
    got = {(r["stream"], r["version"], r["kind"]): r["status"] for r in rf.judged_references(spark.createDataFrame([(*r, "", 0) for r in rows], LOG)).collect()}
    assert got == {("u", 0, "flush"): "fine", ("u", 0, "cause"): "missing", ("_index", 0, "flush"): "late", ("_index", 1, "flush"): "fine"}
