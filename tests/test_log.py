import pytest
from pyspark.sql import functions as F

from tidelog.functions.names import is_blank, matches_pattern, reference_stream, reference_version
from tidelog.operators import appending, links, maintenance, reads, retention
from tidelog.schema import LOG

CATALOG = "name string, created long, max_age long, max_count int, state int, permissions map<string,int>, metadata map<string,string>"
NOW = 1_000_000


def log(spark, rows):
    return spark.createDataFrame([(*r, None)[:7] for r in rows], LOG)


def stream(name, n, ts=NOW, start=0):
    return [(start + i, name, "t", i, ts, f"d{i}") for i in range(n)]


def cat(spark, *rows):
    return spark.createDataFrame([(n, 0, age, count, 0, None, None) for n, age, count in rows], CATALOG)


def test_max_count_keeps_the_newest(spark):
    df = log(spark, stream("a", 50) + stream("b", 5, start=100) + stream("c", 3, start=200))
    kept = retention.max_count(df, cat(spark, ("a", -1, 10), ("b", -1, 10), ("b", -1, 10), ("c", -1, 0)))
    rows = kept.collect()
    assert sorted(r["version"] for r in rows if r["stream"] == "a") == list(range(40, 50))
    assert len(rows) == 18 and kept.columns == df.columns


def test_max_age_is_inclusive_up_to_999_ms_more(spark):
    ages = {0: 5_999, 1: 6_000, 2: 5_000, 3: 0}
    rows = [(v, s, "t", v, NOW - age, "") for s in ("five", "none", "zero", "missing") for v, age in ages.items()]
    kept = retention.max_age(log(spark, rows), cat(spark, ("five", 5, -1), ("none", -1, -1), ("zero", 0, -1)), NOW)
    by = {s: sorted(r["version"] for r in kept.collect() if r["stream"] == s) for s in ("five", "none", "zero", "missing")}
    assert by == {"five": [0, 2, 3], "none": [0, 1, 2, 3], "zero": [0, 1, 2, 3], "missing": [0, 1, 2, 3]}


def test_reads(spark):
    df = log(spark, stream("a", 20) + stream("b", 5, start=100) + stream("x1", 2, start=200) + stream("_x", 2, start=300))
    c = cat(spark, ("a", -1, 10), ("b", -1, -1), ("x1", -1, -1), ("_x", -1, -1))
    versions = lambda d: [r["version"] for r in d.collect()]
    assert versions(reads.from_stream(df, c, "a", NOW)) == list(range(10, 20))
    assert versions(reads.from_stream(df, c, "a", NOW, 15)) == list(range(15, 20))
    assert versions(reads.from_stream(df, c, "nobody", NOW)) == []
    with pytest.raises(ValueError):
        reads.from_stream(df, c, "a", NOW, -1)
    merged = reads.zip_streams(df, c, ["b", "a", "b", "", " ", None], NOW).collect()
    assert [r["position"] for r in merged] == [*range(20), *range(100, 105)]  # no max-count
    assert reads.zip_streams(df, c, [], NOW).count() == 0
    assert {r["stream"] for r in reads.zip_prefix(df, c, "_*", NOW).collect()} == {"_x"}
    assert reads.zip_prefix(df, c, "*", NOW).count() == 29
    assert reads.zip_prefix(df, c, "b", NOW).count() == 5 and reads.zip_prefix(df, c, "z*", NOW).count() == 0 and reads.zip_prefix(df, c, None, NOW).count() == 0
    assert versions(reads.index_range(df, "a", 1, 3)) == [1, 2] and versions(reads.index_range(df, "a", 17, backward=True)) == [19, 18, 17]
    with pytest.raises(ValueError):
        reads.index_range(df, "a", -1)
    with pytest.raises(ValueError):
        reads.at_position(df, 99_999)
    with pytest.raises(KeyError):
        reads.get_event(df, "a", 20)
    assert reads.from_streams(df, c, ["a", "b"], NOW).count() == 15
    assert set(reads.streams_mapped(df, c, ["a", "b", ""], NOW)) == {"a", "b"}
    assert reads.log_size(df.limit(0)).first() == (0, 0, -1)


def test_links(spark):
    rows = stream("a@b", 3) + [(10, "l", "_>", 0, 0, "a@b@1"), (11, "m", "_>", 0, 0, "l@0"), (12, "l", "_>", 1, 0, "a@b@9")]
    df = log(spark, rows)
    got = {(r["link_stream"], r["link_version"]): (r["stream"], r["version"]) for r in links.resolve(df, df, "drop").collect() if r["link_stream"]}
    assert got == {("l", 0): ("a@b", 1), ("m", 0): ("a@b", 1)}
    assert links.resolve(df, df, "drop").count() == 5
    with pytest.raises(Exception, match="a@b@9"):
        links.resolve(df.filter("stream = 'l'"), df).collect()
    again = links.resolve(links.resolve(df, df, "drop").select(*df.columns), df, "drop")
    assert again.count() == 5
    made = links.link_to(df.filter("stream = 'l' OR position = 2"), "z").collect()
    assert {r["data"] for r in made} == {"a@b@1", "a@b@9", "a@b@2"}
    loop = log(spark, [(1, "p", "_>", 0, 0, "q@0"), (2, "q", "_>", 0, 0, "p@0")])
    with pytest.raises(Exception, match="go round"):
        links.resolve(loop, loop).collect()
    assert links.resolve(loop, loop, "drop").count() == 0


def test_a_chain_of_forty_links_and_a_long_circle(spark):
    chain = [(0, "c", "t", 0, 0, "end")] + [(i, "c", "_>", i, 0, f"c@{i - 1}") for i in range(1, 41)]
    circle = [(100 + i, "r", "_>", i, 0, f"r@{(i + 1) % 5}") for i in range(5)] + [(110, "into", "_>", 0, 0, "r@3")]
    df = log(spark, chain + circle).coalesce(1).cache()
    got = links.resolve(df.filter("stream IN ('into', 'r') OR version IN (1, 40)"), df, "drop").collect()
    assert sorted((r["link_stream"], r["link_version"], r["data"]) for r in got) == [("c", 1, "end"), ("c", 40, "end")]


def test_repeated_names_in_a_catalog(spark):
    c = spark.createDataFrame([("a", 1, 5, 2), ("a", 2, -1, 3), ("a", 2, 9, 3), ("a", None, 1, 1), ("b", None, None, -1)], "name string, created long, max_age long, max_count int")
    got = {r["name"]: (r["created"], r["max_age"], r["max_count"]) for r in retention.one_per_name(c).collect()}
    assert got == {"a": (2, 9, 3), "b": (None, None, -1)}


def test_link_retention_goes_by_the_link(spark):
    df = log(spark, stream("old", 2, ts=0) + [(10, "l", "_>", 0, NOW, "old@0"), (11, "l", "_>", 1, 0, "old@1")])
    c = cat(spark, ("old", 5, -1), ("l", 5, -1))
    assert [(r["stream"], r["version"]) for r in reads.from_stream(df, c, "l", NOW).collect()] == [("old", 0)]


def test_appending(spark):
    df = log(spark, stream("a", 3))
    batch = spark.createDataFrame([(i, s, "t") for i, s in enumerate(["a", "n", "a", "n", "m", "a"])], "ordinal long, stream string, type string")
    got = sorted((r["ordinal"], r["stream"], r["version"], r["position"]) for r in appending.append_versions(df, batch).collect())
    assert got == [(0, "a", 3, 3), (1, "n", 0, 4), (2, "a", 4, 5), (3, "n", 1, 6), (4, "m", 0, 7), (5, "a", 5, 8)]
    assert sorted(r["version"] for r in appending.append_versions(df.limit(0), batch).collect()) == [0, 0, 0, 1, 1, 2]
    expected = spark.createDataFrame([("a", 2), ("a", 1), ("a", -1), ("n", -1), ("n", 0)], "stream string, expected int")
    assert {tuple(r) for r in appending.version_conflicts(df, expected).collect()} == {("a", 1, 2), ("n", 0, -1)}
    bad = spark.createDataFrame([(" ", "t"), (None, "t"), ("a", ""), ("a", None), ("_x", "t"), ("x_", "t")], "stream string, type string")
    assert [r["reason"] for r in appending.invalid_rows(bad).collect()] == ["blank stream", "blank stream", "blank type", "blank type", "reserved stream name"]
    assert appending.invalid_rows(bad, system=True).count() == 4
    with pytest.raises(Exception, match="reserved"):
        appending.validated(bad.filter("stream = '_x'")).collect()
    with pytest.raises(ValueError):
        appending.flush_batches(df, 10)


def test_names(spark):
    df = spark.createDataFrame([("a@b@12",), ("a@",), ("a",), ("@3",), (None,), ("a@v1",), ("a@99999999999",), ("",)], "t string")
    got = [tuple(r) for r in df.select(reference_stream(F.col("t")), reference_version(F.col("t"))).collect()]
    assert got == [("a@b", 12), ("a", None), (None, None), ("", 3), (None, None), ("a", None), ("a", None), (None, None)]
    names = spark.createDataFrame([("abc-1",), ("abc",), ("x%",), ("_s",)], "n string")
    match = lambda p: [r["n"] for r in names.filter(matches_pattern(F.col("n"), p)).collect()]
    assert match("abc*") == ["abc-1", "abc"] and match("abc") == ["abc"] and match("_*") == ["_s"] and match("x%*") == ["x%"] and match(None) == [] and len(match("*")) == 4
    assert [r[0] for r in spark.createDataFrame([(" \t",), ("",), (None,), ("x",)], "t string").select(is_blank(F.col("t"))).collect()] == [True, True, True, False]


def test_maintenance(spark):
    old = spark.createDataFrame([("b", 1, 5), ("a", 2, 3), ("a", 1, 2)], "stream string, version int, position long")
    new = spark.createDataFrame([("a", 1, 9), ("c", 0, 8)], old.schema)
    assert [tuple(r) for r in maintenance.compact(new, old).orderBy("stream", "version").collect()] == [("a", 1, 9), ("a", 2, 3), ("b", 1, 5), ("c", 0, 8)]
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    bits, hashes = maintenance.bloom_shape(2000)
    words = maintenance.bloom_words(keys, "k", bits, hashes).cache()
    assert maintenance.bloom_contains(words, keys, "k", bits, hashes).filter("maybe").count() == 2000
    foreign = spark.range(5000).select(F.concat(F.lit("f"), "id").alias("k"))
    assert maintenance.bloom_contains(words, foreign, "k", bits, hashes).filter("maybe").count() < 150
    assert maintenance.bloom_contains(words.limit(0), keys.limit(3), "k", bits, hashes).filter("maybe").count() == 0
