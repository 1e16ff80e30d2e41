import random
from collections import defaultdict

import pytest

from tidelog.llm import packing as pk

CAPS = {1: 100, 2: 37}


def items(spark, sizes, parts=4):
    rows = [(k, i, s, "x", True) for k in CAPS for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "kind int, item long, size int, container string, full boolean").repartition(parts)


@pytest.mark.parametrize("windows", [1, 8])
def test_whole_items_within_capacity(spark, windows):
    rnd = random.Random(6)
    sizes = [rnd.choice([1, 3, 20, 37, 60, 99, 100, 101, 260, 1000]) for _ in range(400)] + [0, None]
    rows = pk.pack(items(spark, sizes), CAPS, windows).collect()
    used, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        parts[r["kind"], r["item"]].append(r)
        if r["container"] is not None:
            used[r["kind"], r["container"]] += r["size"]
    assert len(parts) == 2 * len(sizes)
    assert all(total <= CAPS[k] for (k, _), total in used.items())
    for (k, i), own in parts.items():
        size = sizes[i] or 0
        assert sum(r["size"] for r in own) == size
        assert sorted(r["piece"] for r in own) == list(range(len(own)))
        assert len(own) == max(1, -(-size // CAPS[k]))  # split only above the capacity
        assert (own[0]["container"] is None) == (size == 0)
    report = {r["kind"]: r for r in pk.unused_space(pk.pack(items(spark, sizes), CAPS, windows), CAPS).collect()}
    assert report[1]["tokens"] == sum(s or 0 for s in sizes) and report[1]["n_containers"] >= report[1]["least_containers"]


def test_little_space_is_left(spark):
    rnd = random.Random(7)
    sizes = [rnd.randrange(1, 40) for _ in range(4000)]
    report = {r["kind"]: r for r in pk.unused_space(pk.pack(items(spark, sizes, 8), {1: 100, 2: 64}), {1: 100, 2: 64}).collect()}
    assert report[1]["unused_share"] < 0.02


def test_groups_of_partitions_meet_in_the_second_round(spark, monkeypatch):
    monkeypatch.setattr(pk, "MERGE_PARTITIONS", 1)
    rows = pk.pack(items(spark, [30] * 12, 24), {1: 100, 2: 64}).collect()
    assert len({r["container"] for r in rows if r["kind"] == 1}) == 4
    assert len({r["container"] for r in rows if r["kind"] == 2}) == 6


def test_empty(spark):
    assert pk.pack(items(spark, [1]).limit(0), CAPS).count() == 0
    assert pk.unused_space(pk.pack(items(spark, [0]), CAPS), CAPS).count() == 0


def test_token_counts(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "x " * 20_000)], "doc_id long, text string")
    got = {(r["item"], r["tokenizer"]): r["size"] for r in pk.token_counts(docs, "doc_id", "text", ["byte_bpe_50k", "piece_bpe_32k"]).collect()}
    assert got[1, "byte_bpe_50k"] == 2 and got[2, "byte_bpe_50k"] == 0 and got[2, "piece_bpe_32k"] == 0
    assert not any(i == 3 for i, _ in got) and got[4, "byte_bpe_50k"] >= 20_000
