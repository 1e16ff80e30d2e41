from decimal import Decimal

from tidelog.operators import features as ft

LOG = "position long, stream string, type string, version int, timestamp long, data string, kind_no string, n int"
KINDS = [(1, "a", "f"), (2, "B", "f"), (3, "c", "f")]


def frames(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], LOG), spark.createDataFrame(KINDS, "kind_no int, type string, family string")


ROWS = [
    (1, "s", "a", 0, 10, '{"amount": 1.5}'), (9, "s", "a", 0, 99, '{"amount": 1.5}'), (2, "s", "a", 1, 5, '{"amount":"2.25"}'), (3, "s", "a", 2, None, '{"body":{"amount":9}}'),
    (4, "s", "B", 3, 7, "plain"), (5, "s", "b", 4, 7, '{"amount":1}'), (6, "s", None, 5, 7, None), (7, "s", "c", None, 7, "{}"), (8, None, "c", 1, 7, "{}"), (10, "_s", "c", 1, 7, "{}"),
    (11, "t", "zzz", 0, 1, ""), (12, "u", "c", 0, 4, '{"amount": tru'), (13, "u", "c", 1, 3, '{"am\\u006funt": 1e2}'), (14, "", "c", 0, 3, '{"amount":null}'),
]


def test_cells(spark):
    log, kinds = frames(spark, ROWS)
    got = {(r["stream"], r["kind_no"]): (r["n"], r["total"], r["latest"]) for r in ft.cells(ft.encoded_events(log, kinds)).collect()}
    assert got == {("s", 1): (3, Decimal("3.75"), 10), ("s", 2): (1, None, 7), ("u", 3): (2, Decimal(100), 4), ("", 3): (1, None, 3)}


def test_table_has_all_streams_and_columns(spark):
    log, kinds = frames(spark, ROWS)
    t = ft.feature_table(log, kinds)
    assert t.columns == ["stream"] + [f"{c}_{k}" for k in (1, 2, 3) for c in ("n", "total", "latest")]
    got = {r["stream"]: r.asDict() for r in t.collect()}
    assert set(got) == {"s", "t", "u", ""}
    assert got["s"]["n_1"] == 3 and got["s"]["total_1"] == 3.75 and got["t"]["n_1"] == 0 and got["t"]["latest_1"] is None
    assert ft.feature_table(log.limit(0), kinds).count() == 0
    assert ft.frequent_cells(log, kinds, 3).collect() == [("s", "a")]
    assert ft.frequent_cells(log, kinds.limit(0), 1).count() == 0


def test_vectors_merge(spark):
    log, kinds = frames(spark, ROWS)
    whole = ft.feature_vectors(log, kinds)
    a = ft.sparse_vectors(ft.cells(ft.encoded_events(log.filter("version % 2 = 0"), kinds)))
    b = ft.sparse_vectors(ft.cells(ft.encoded_events(log.filter("version % 2 = 1"), kinds)))
    flat = lambda df: sorted((r["stream"], [tuple(c) for c in r["vector"]]) for r in df.collect())
    assert flat(ft.merge_vectors(a, b)) == flat(whole)
