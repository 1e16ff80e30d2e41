"""Encoding a corpus with a public byte-level BPE through a compiled lexicon.

BPE works word by word, and a corpus uses few words often. The frequent words, counted over all documents, are compiled
with their ids into a minimal acyclic automaton: words share prefixes and suffixes, and every edge knows how many words
come before it, so that walking a word yields its rank and the rank its ids (a transducer with shared suffixes). The
automaton is a few flat arrays in the shared folder that all workers memory-map. Words of a batch walk it together, one
byte at a time; words that it doesn't hold are merged exactly by the vocabulary's ranks. Results don't depend on what the
lexicon holds.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import local_path, scratch_path, written

#: Words of the lexicon at most: it is compiled on the driver, about 20 bytes a word.
LEXICON_WORDS = 50_000
#: Longer words are always merged.
LEXICON_BYTES = 64
#: A word must occur this often.
LEAST_COUNT = 2
#: Words whose ids a worker keeps beside the lexicon.
MEMO_WORDS = 20_000
ARRAYS = ("edges", "targets", "skips", "final", "starts", "ids")


@dataclass(frozen=True)
class Vocabulary:
    """Where a byte-level BPE's ranks are and how it cuts texts into words."""

    path: str
    pattern: str

    @staticmethod
    def public(name: str = "byte_bpe_50k") -> Vocabulary:
        """A vocabulary of the installed public_tokenizers package."""
        import public_tokenizers

        return Vocabulary(public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)

    def ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as f:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: merge the neighbouring pair of lowest rank, leftmost first, until no pair is in the vocabulary."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here, 0 if merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n:
            rank = ranks.get(word[a : end[b]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if end[a] != b or end[b] != stop:
            continue
        end[a], end[b] = stop, 0
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """The minimal automaton of distinct words in byte order, and their ids by rank, as flat arrays.

    edges: state * 256 + byte, ascending; targets and skips: by edge; final: by state; starts: ids of rank r are
    ids[starts[r] : starts[r + 1]]. State 0 is the start. Words are added in order; when a word leaves the path of the one
    before, the path's states are final and are replaced by equal states that exist already.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # minimal states: final, ((byte, state), ...)
    sizes: list[int] = []

    def settle(node: list) -> int:
        shape = (node[0], tuple(node[1]))
        at = register.get(shape)
        if at is None:
            at = register[shape] = len(states)
            states.append(shape)
            sizes.append(int(node[0]) + sum(sizes[t] for _, t in node[1]))
        return at

    path: list[list] = [[False, [], -1]]  # final, edges, byte that leads here
    last = b""
    for word in words:
        if last and word <= last:
            raise ValueError("words must be distinct and in byte order")
        same = len(os.path.commonprefix([word, last]))
        while len(path) - 1 > same:
            node = path.pop()
            path[-1][1].append((node[2], settle(node)))
        for byte in word[same:]:
            path.append([False, [], byte])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((node[2], settle(node)))
    root = settle(path[0])
    number = {root: 0}
    for s in range(len(states)):
        number.setdefault(s, len(number))
    edges = []
    for s, (final, out) in enumerate(states):
        skip = int(final)
        for byte, t in out:
            edges.append((number[s] * 256 + byte, number[t], skip))
            skip += sizes[t]
    edges.sort()
    finals = np.zeros(len(states), bool)
    for s, (final, _) in enumerate(states):
        finals[number[s]] = final
    e = np.array(edges, np.int64).reshape(-1, 3)
    return {
        "edges": e[:, 0].copy(),
        "targets": e[:, 1].astype(np.int32),
        "skips": e[:, 2].astype(np.int32),
        "final": finals,
        "starts": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
        "ids": np.array([i for x in ids for i in x], np.int32),
    }


def look_up(lexicon: dict[str, np.ndarray], text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of many words at once (-1: not in the lexicon); word i is text[starts[i] : starts[i + 1]], bytes."""
    edges, targets, skips = lexicon["edges"], lexicon["targets"], lexicon["skips"]
    lengths = np.diff(starts)
    rank = np.full(len(lengths), -1, np.int64)
    going = np.flatnonzero((lengths <= LEXICON_BYTES) & (lengths > 0)) if len(edges) else np.zeros(0, np.int64)
    state, found = np.zeros(len(going), np.int64), np.zeros(len(going), np.int64)
    for step in range(LEXICON_BYTES):
        if not len(going):
            break
        key = state * 256 + text[starts[going] + step]
        at = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
        on = edges[at] == key
        going, at = going[on], at[on]
        state, found = targets[at].astype(np.int64), found[on] + skips[at]
        end = lengths[going] == step + 1
        done = end & lexicon["final"][state]
        rank[going[done]] = found[done]
        going, state, found = going[~end], state[~end], found[~end]
    return rank


def _words(texts: list, pattern) -> tuple[list[str], np.ndarray]:
    """All words of the texts in a row, and how many each text has (none: null and empty)."""
    per = [pattern.findall(t) if t else [] for t in texts]
    return [w for p in per for w in p], np.fromiter(map(len, per), np.int64, len(per))


#: Bytes of text that a worker cuts or encodes at a time, about.
SLICE_BYTES = 8 << 20


def text_slices(batch: pa.RecordBatch, at_column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of the text column; a longer text is a slice of its own."""
    texts = batch.column(at_column)
    if texts.nbytes <= SLICE_BYTES or batch.num_rows <= 1:
        yield batch
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


def count_words(docs: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """word (bytes), n over all documents; partly counted in each task before the shuffle. Long words aren't counted."""
    pattern = vocabulary.pattern

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern)
        for part in (p for batch in batches for p in text_slices(batch, 0)):
            words, _ = _words(part.column(0).to_pylist(), cut)
            found = pa.array(words, pa.string()).value_counts()
            n = found.field("counts")
            values = found.field("values").cast(pa.binary())
            short = pa.compute.less_equal(pa.compute.binary_length(values), LEXICON_BYTES)
            yield pa.RecordBatch.from_arrays([values.filter(short), n.filter(short)], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """word of the `most` words with the greatest n (ties by bytes). A quantile of n first leaves few more than that, so
    that the final sort is small however many words there are."""
    total = counted.count()
    if total > 2 * most:
        least = counted.agg(F.percentile_approx("n", 1 - most / total, 100_000).alias("q")).first()["q"]
        near = counted.filter(F.col("n") >= least)
        counted = near if near.count() <= 4 * most else counted.filter(F.col("n") > least)
    return counted.orderBy(F.desc("n"), "word").limit(most).select("word")


def build_lexicon(docs: DataFrame, text: str, vocabulary: Vocabulary, most: int = LEXICON_WORDS) -> dict[str, np.ndarray]:
    """Compile the `most` most frequent words (ties by bytes); the ids are merged in parallel, the automaton is built here."""
    counted = written(count_words(docs, text, vocabulary).filter(F.col("n") >= LEAST_COUNT), "words")
    top = most_frequent(counted, most)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary.ranks()
        for batch in batches:
            ids = [merge_word(w, ranks) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    rows = sorted((bytes(w), list(i)) for w, i in top.mapInArrow(encode, "word binary, ids array<int>").collect())
    return compile_lexicon([w for w, _ in rows], [i for _, i in rows])


def publish(spark: SparkSession, lexicon: dict[str, np.ndarray]) -> Callable[[], dict[str, np.ndarray]]:
    """Put the arrays where workers reach them; the result opens them: memory-mapped files of the shared folder, or, where
    that folder is no mounted path, a broadcast of the arrays (their size is bounded by LEXICON_WORDS)."""
    path = scratch_path(spark, "lexicon")
    folder = local_path(spark, path)
    if folder is None:
        sent = spark.sparkContext.broadcast(lexicon)
        return lambda: sent.value
    os.makedirs(folder)
    for name in ARRAYS:
        np.save(os.path.join(folder, f"{name}.npy"), lexicon[name])

    def opened() -> dict[str, np.ndarray]:
        # an empty array can't be mapped
        return {n: np.load(p, mmap_mode="r" if os.path.getsize(p) > 128 else None) for n in ARRAYS for p in [os.path.join(folder, f"{n}.npy")]}

    return opened


def encode(docs: DataFrame, keys: list[str], text: str, vocabulary: Vocabulary, most: int = LEXICON_WORDS) -> DataFrame:
    """keys and ids (array of int): one row per row of docs, without special tokens; null and empty texts give [].

    Strings that look like special tokens are ordinary text. Texts may have any length. Other columns are dropped.
    """
    opened = publish(docs.sparkSession, build_lexicon(docs, text, vocabulary, most))
    pattern = vocabulary.pattern
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut, lexicon, ranks = regex.compile(pattern), opened(), None
        memo: dict[bytes, list[int]] = {}
        for batch in (p for b in batches for p in text_slices(b, n_keys)):
            words, per = _words(batch.column(n_keys).to_pylist(), cut)
            coded = pa.array(words, pa.large_string()).dictionary_encode()
            unique = coded.dictionary.cast(pa.large_binary())
            used = np.asarray(coded.indices, np.int64)
            bounds = np.frombuffer(unique.buffers()[1], np.int64)[: len(unique) + 1] if len(unique) else np.zeros(1, np.int64)
            data = np.frombuffer(unique.buffers()[2], np.uint8) if len(unique) else np.zeros(0, np.uint8)
            rank = look_up(lexicon, data, bounds)
            safe = np.maximum(rank, 0)
            known = rank >= 0
            start = np.where(known, lexicon["starts"][safe] if len(lexicon["ids"]) else 0, 0)
            size = np.where(known, lexicon["starts"][np.minimum(safe + 1, len(lexicon["starts"]) - 1)] - start, 0)
            extra: list[int] = []
            for i in np.flatnonzero(~known):
                if ranks is None:
                    ranks = vocabulary.ranks()
                word = data[bounds[i] : bounds[i + 1]].tobytes()
                ids = memo.get(word)
                if ids is None:
                    ids = merge_word(word, ranks)
                    if len(memo) < MEMO_WORDS and len(word) <= LEXICON_BYTES:
                        memo[word] = ids
                start[i], size[i] = len(lexicon["ids"]) + len(extra), len(ids)
                extra += ids
            pool = np.concatenate([lexicon["ids"], np.array(extra, np.int32)]) if extra else lexicon["ids"]
            sizes = size[used]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            at = np.repeat(start[used] - (ends - sizes), sizes) + np.arange(total)
            per_word = np.concatenate([[0], ends])
            offsets = per_word[np.concatenate([[0], np.cumsum(per)])]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pool[at], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], lists], [*keys, "ids"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ids array<int>"
    return docs.select(*keys, text).mapInArrow(run, schema)
