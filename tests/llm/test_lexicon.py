import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import lexicon as lx

P = pytest.importorskip("public_tokenizers")
V = lx.Vocabulary.public("byte_bpe_50k")
TEXTS = [
    None, "", " ", "\n\n", "Hello world, hello  world\n\n  again.", "<|endoftext|> and <s>", "we'll've it's", "naïve façade Ångström", "日本語のテキスト。中文，文本", "สวัสดีครับ ทดสอบ", "हिन्दी पाठ और शब्द", "نص عربي", "🙂👩‍🌾🚜", "a" * 5000, "ab" * 3000 + " x", " " * 3000 + "end", "tab\there \x1f\x07 zero​width ﻿ x\xa0y", "1234567890123456789", "𝔉𝔯𝔢 ½ ⅓", "é" * 700, "\r\n \r\n x", "A" + "́" * 300,
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


def test_merging_equals_the_library(whole):
    ranks = V.ranks()
    rnd = random.Random(3)
    words = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 40))) for _ in range(300)] + ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(1, 60))).encode() for _ in range(500)]
    import tiktoken

    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for w in words:
        assert lx.merge_word(w, ranks) == list(model._encode_single_piece(w))


def test_automaton_gives_each_word_its_ids_and_no_other():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))).encode() for _ in range(900)} | {"über".encode(), b"\xff\x00"})
    ids = [[i, i + 1][: 1 + i % 2] for i in range(len(words))]
    a = lx.compile_lexicon(words, ids)
    asked = words + [w + b"q" for w in words[:50]] + [w[:-1] for w in words if len(w) > 1 and w[:-1] not in set(words)] + [b"", b"z" * 100]
    data = np.frombuffer(b"".join(asked), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in asked])])
    rank = lx.look_up(a, data, starts)
    assert rank[: len(words)].tolist() == list(range(len(words)))
    assert (rank[len(words) :] == -1).all()
    assert all(a["ids"][a["starts"][r] : a["starts"][r + 1]].tolist() == ids[r] for r in range(len(words)))
    assert len(a["edges"]) < sum(len(w) for w in words) / 3  # prefixes and suffixes are shared
    assert (lx.look_up(lx.compile_lexicon([], []), data, starts) == -1).all()


@pytest.mark.parametrize("most", [1, 20, 50_000])
def test_encoding_equals_the_library_whatever_the_lexicon_holds(spark, whole, most):
    rows = [(i, t, "en", [1]) for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids array<int>").repartition(3)
    got = lx.encode(docs, ["doc_id"], "text", V, most)
    assert got.columns == ["doc_id", "ids"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert list(r["ids"]) == whole(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_empty_table_and_only_nulls(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in lx.encode(docs, ["doc_id"], "text", V).collect()] == [(1, [])]
    assert lx.encode(docs.limit(0), ["doc_id"], "text", V).count() == 0


def test_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([("a a b",), ("a",), (None,), ("c" * 100,)], "text string").repartition(2)
    assert {bytes(r["word"]): r["n"] for r in lx.count_words(docs, "text", V).collect()} == {b"a": 2, b" a": 1, b" b": 1}
    assert docs.select(F.sum(F.length("text"))).first()[0] == 106


def test_slices_hold_every_row_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lx, "SLICE_BYTES", 10)
    texts = ["a" * 4, None, "b" * 7, "", "c" * 30, "d", "e" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["k", "t"])
    parts = list(lx.text_slices(batch, 1))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert [p.num_rows for p in parts] == [2, 2, 1, 1, 1]
