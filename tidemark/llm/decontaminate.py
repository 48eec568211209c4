"""Benchmark decontamination with suffix arrays over shards of the training text.

Every task turns its texts into shards of a bounded number of words. The words of a shard
become numbers of the benchmark's vocabulary, found by hash and compared byte by byte; a
word outside it cannot be in any match, so it only ends one. A suffix array of what is left is built by prefix doubling, and every
suffix of every test item is searched in it by binary search, one more word at a time, for
all of them at once, up to the length of a window. The ranges found give the places of every
window. In the rows that have any, a second suffix array, over the covered words and the
items found in them, gives the longest verbatim match and its place: the longest common
extension of a place and the nearest item suffixes in order.

The benchmark is a table dealt into blocks of a bounded size; the driver holds one at a
time. Each block is one narrow pass over the documents with the same search. The first
annotates them; the others write what they find in the few texts that they hit, by hash of
the text, and join it. The documents are not shuffled where that table can be broadcast.

Defined cases: a null or empty text has no words; an item without words has no window; an
item with a null id marks words but is not listed; repeated items and repeated documents
are each handled as they stand; of equally long matches the earliest place counts; texts
over ``SLICE_BYTES`` are read in slices and searched in overlapping shards, with the same
results (only ``longest_match`` is measured within ``SHARD_WORDS`` words); an empty
benchmark marks nothing; an empty table gives an empty result; other columns of the
documents are kept, except those that have the name of a result column, which the result
replaces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import LOWER_BYTE, SLICE_BYTES, cuts, kept_columns, long_hash, map_batches, passes, runs, span_hashes, text_bytes, written

WINDOW = 10

#: Benchmark text that one pass holds in every Python worker, in bytes.
BLOCK_BYTES = 8 << 20

#: Words of a shard, about, and of the stretches in which a longest match is measured.
SHARD_WORDS = 1 << 18

#: Spans and items (some 16 bytes each) of hits that may be broadcast.
BROADCAST_ENTRIES = 500_000

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x41:0x5B] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_SPANS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))

#: What a pass finds: spans of covered words, items, longest match and its place.
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("__cover", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()),
    T.StructField("longest_at", T.LongType()),
]

RESULT = ["n_words", "n_hit", "items", "longest_match", "longest_at"]


class Vocabulary:
    """Different words, numbered. A word is found by a hash and then compared byte by byte, so
    that words of equal hash are told apart."""

    def __init__(self, words: list[bytes]):
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join(words), dtype=np.uint8)
        hashes = span_hashes(self.data, self.starts, self.ends)
        self.number = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.number]
        self.most = int(np.unique(hashes, return_counts=True)[1].max(initial=0))  # words of one hash

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of the word in each span of ``data``, -1 for one that is not known."""
        out = np.full(len(starts), -1, dtype=np.int32)
        near = np.searchsorted(self.hashes, hashes)
        for k in range(self.most):
            at = np.minimum(near + k, len(self.hashes) - 1)
            same = np.flatnonzero((self.hashes[at] == hashes) & (near + k < len(self.hashes)) & (out < 0))
            word = self.number[at[same]]
            fine = equal_spans(data, starts[same], ends[same], self.data, self.starts[word], self.ends[word])
            out[same[fine]] = word[fine]
        return out


def equal_spans(x: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether the bytes ``x[a:b]`` and ``y[c:d]`` are equal, for every pair of spans."""
    size = b - a
    equal = size == d - c
    for k in np.flatnonzero(equal & (size > 64)).tolist():
        equal[k] = np.array_equal(x[a[k] : b[k]], y[c[k] : d[k]])
    # Eight bytes at a time, as numbers that may begin at any byte.
    padded = [np.concatenate([z, np.zeros(8, dtype=np.uint8)]) for z in (x, y)]
    eights = [np.ndarray(len(z) - 7, dtype="<u8", buffer=z, strides=(1,)) for z in padded]
    left = np.flatnonzero(equal & (size <= 64))
    for at in range(0, 64, 8):
        left = left[equal[left] & (size[left] > at)]
        if not len(left):
            break
        unused = np.uint64(8) * np.maximum(0, 8 - (size[left] - at)).astype(np.uint64)
        p, q = (z[s[left] + at] << unused for z, s in zip(eights, (a, c)))
        equal[left] = p == q
    return equal


def numbered(texts: pa.Array, vocabulary: Vocabulary, size: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first): the vocabulary's numbers of all words, and the first word of every
    row. A single long row is read slice by slice, a word is always whole."""
    data, offsets = text_bytes(texts)
    if len(texts) > 1 or len(data) <= size:
        return _numbered(data, offsets, vocabulary)
    parts = [_numbered(data[a:b], np.array([0, b - a]), vocabulary)[0] for a, b in cuts(data, size, ~_WORD_BYTE, whole=True)]
    numbers = np.concatenate(parts)
    return numbers, np.array([0, len(numbers)])


def _numbered(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER_BYTE[data]
    starts, ends = runs(_WORD_BYTE[data], offsets)
    first = np.searchsorted(starts, offsets)
    if not len(vocabulary.starts):
        return np.full(len(starts), -1, dtype=np.int32), first
    alone = len(starts) == 1 and ends[0] - starts[0] > SLICE_BYTES
    hashes = np.array([long_hash(data[starts[0] : ends[0]])]) if alone else span_hashes(data, starts, ends)
    return vocabulary.numbers(data, starts, ends, hashes), first


@dataclass
class Tests:
    """A block of test items.

    ``prefix`` has the first words of every different suffix (-1 behind its end), ``size``
    the words of the window that begins there, 0 for none. The ids of the items with window
    ``k`` are ``ids[owner[first[k] : first[k + 1]]]``; ``text`` from ``start`` on are the
    items' words, -1 behind each.
    """

    vocabulary: Vocabulary
    prefix: np.ndarray
    size: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    ids: list[str | None]
    text: np.ndarray
    start: np.ndarray

    @property
    def shortest(self) -> int:
        return int(self.size[self.size > 0].min()) if len(self.size) else 0


def tests_of(rows: list[tuple], window: int = WINDOW) -> Tests:
    parts = [_WORD.findall(text.encode().lower()) for _, text in rows]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(w, len(known)) for p in parts for w in p], dtype=np.int64)
    n = len(number)
    item = np.repeat(np.arange(len(rows)), counts)
    start = np.cumsum(counts + 1) - (counts + 1)
    text = np.full(int(counts.sum()) + len(rows), -1, dtype=np.int64)
    place = np.arange(n) + item
    text[place] = number
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the item's end
    wanted = np.minimum(window, counts)[item]
    table = np.full((n, window + 1), -1, dtype=np.int32)
    for k in range(window):
        inside = left > k
        table[inside, k] = text[place[inside] + k]
    table[:, window] = np.where(left >= wanted, wanted, 0)
    prefix, which = np.unique(table, axis=0, return_inverse=True) if n else (table, np.zeros(0, dtype=np.int64))
    which = which.reshape(-1)
    pairs = np.unique(np.stack([which, item], axis=1), axis=0) if n else np.zeros((0, 2), dtype=np.int64)
    first = np.searchsorted(pairs[:, 0], np.arange(len(prefix) + 1))
    return Tests(Vocabulary(list(known)), prefix[:, :window].astype(np.int64), prefix[:, window].astype(np.int64), first, pairs[:, 1], [None if i is None else str(i) for i, _ in rows], text, start)


def suffix_array(text: np.ndarray, levels: list[np.ndarray] | None = None) -> np.ndarray:
    """The suffixes of ``text`` in order, by prefix doubling. Negative numbers separate;
    they sort first and, as each is different, no order reaches past one. ``levels`` takes
    the ranks of the first 1, 2, 4, ... words from every place."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    order = np.argsort(rank, kind="stable")
    if levels is not None:
        levels.append(rank.astype(np.int32))
    while n and width < n:
        behind = np.zeros(n, dtype=np.int64)
        behind[:-width] = rank[width:] + 1
        key = rank * (n + 2) + behind
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        width *= 2
        if levels is not None:
            levels.append(rank.astype(np.int32))
    return order


def _narrow(text: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range of suffixes, those whose word ``depth`` is ``word``: two binary searches."""
    n = len(text)

    def bound(above: bool) -> np.ndarray:
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            at = order[np.minimum(middle, n - 1)] + depth
            value = np.where(at < n, text[np.minimum(at, n - 1)], np.iinfo(np.int64).min)
            right = open_ & ((value <= word) if above else (value < word))
            a = np.where(right, middle + 1, a)
            b = np.where(open_ & ~right, middle, b)
        return a

    return bound(False), bound(True)


def search(text: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(places, windows): every occurrence of a window in ``text``."""
    none = np.zeros(0, dtype=np.int64)
    if not len(text) or not len(tests.prefix):
        return none, none
    order = suffix_array(text)
    which = np.arange(len(tests.prefix))
    low, high = np.zeros(len(which), dtype=np.int64), np.full(len(which), len(text), dtype=np.int64)
    places, windows = [none], [none]
    for depth in range(tests.prefix.shape[1]):
        word = tests.prefix[which, depth]
        low, high = _narrow(text, order, low, high, depth, word)
        alive = (low < high) & (word >= 0)
        which, low, high = which[alive], low[alive], high[alive]
        full = tests.size[which] == depth + 1
        times = high[full] - low[full]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        places.append(order[np.repeat(low[full], times) + inside])
        windows.append(np.repeat(which[full], times))
        which, low, high = which[~full], low[~full], high[~full]
        if not len(which):
            break
    return np.concatenate(places), np.concatenate(windows)


def common_extensions(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words are equal from the places ``x`` and ``y`` on."""
    n, length = len(levels[0]), np.zeros(len(x), dtype=np.int64)
    for k in reversed(range(len(levels))):
        a, b = x + length, y + length
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        length += same << k
    return length


def longest_matches(text: np.ndarray, items: np.ndarray) -> np.ndarray:
    """For every place of ``text`` the longest verbatim match with any place of ``items``,
    linear in both but for the sorting. Negative numbers separate."""
    joined = np.concatenate([text, [-1], items])
    joined[joined < 0] = -1 - np.arange((joined < 0).sum())
    levels: list[np.ndarray] = []
    order = suffix_array(joined, levels)
    ours = order < len(text)
    at = np.arange(len(order))
    above = np.maximum.accumulate(np.where(ours, -1, at))
    below = np.minimum.accumulate(np.where(ours, len(order), at)[::-1])[::-1]
    best = np.zeros(len(text), dtype=np.int64)
    for near in (above, below):
        known = ours & (near >= 0) & (near < len(order))
        length = common_extensions(levels, order[known], order[near[known]])
        best[order[known]] = np.maximum(best[order[known]], length)
    return np.where(text < 0, 0, best)


def _stretches(starts: np.ndarray, ends: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs longer than ``most`` words as several that overlap."""
    step = most - overlap
    count = np.maximum(1, -(-(ends - starts - overlap) // step))
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(starts, count) + k * step
    return begin, np.minimum(np.repeat(ends, count), begin + most)


def _joined(number: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, back): runs of words one after the other, a separator behind each, and their
    places before."""
    sizes = ends - starts + 1
    begin = np.cumsum(sizes) - sizes
    back = np.arange(sizes.sum()) - np.repeat(begin - starts, sizes)
    text = number[np.minimum(back, len(number) - 1)].astype(np.int64)
    text[begin + sizes - 1] = -1 - np.arange(len(begin))
    return text, back


def _shards(starts: np.ndarray, ends: np.ndarray, most: int):
    """Groups of runs with about ``most`` words together."""
    group = (np.cumsum(ends - starts) - (ends - starts)) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(starts)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield starts[a:b], ends[a:b]


def shard_result(texts: pa.Array, tests: Tests, most: int = SHARD_WORDS) -> list[pa.Array]:
    """The columns of ``FOUND`` for some texts."""
    number, first = numbered(texts, tests.vocabulary)
    n, words = len(texts), len(number)
    starts, ends = runs(number >= 0, first)
    long = ends - starts >= max(1, tests.shortest)
    starts, ends = _stretches(starts[long], ends[long], most, tests.prefix.shape[1] - 1)
    covered = np.zeros(words, dtype=bool)
    listed: list[np.ndarray] = []
    for a, b in _shards(starts, ends, most):
        text, back = _joined(number, a, b)
        places, windows = search(text, tests)
        change = np.bincount(places, minlength=len(text) + 1) - np.bincount(places + tests.size[windows], minlength=len(text) + 1)
        covered[back[np.cumsum(change)[: len(text)] > 0]] = True
        row = np.searchsorted(first, back[places], side="right") - 1
        listed.append(np.unique(row * len(tests.size) + windows))
    items = _items(np.unique(np.concatenate(listed)) if listed else np.zeros(0, dtype=np.int64), tests, n)
    cover_from, cover_to = runs(covered, first)
    row = np.searchsorted(first, cover_from, side="right") - 1
    longest, place = _longest(number, cover_from, cover_to, first, tests, items, most)
    spans = pa.StructArray.from_arrays([pa.array(cover_from - first[row]), pa.array(cover_to - first[row])], names=["a", "b"])
    bounds = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    names = [sorted({tests.ids[k] for k in own.tolist()} - {None}) for own in items]
    return [
        pa.array(np.diff(first)), pa.ListArray.from_arrays(bounds, spans), pa.array(names, pa.list_(pa.string())),
        pa.array(longest), pa.array(place, mask=longest == 0),
    ]


def _items(found: np.ndarray, tests: Tests, rows: int) -> list[np.ndarray]:
    """By row, the numbers of the items whose windows are ``found`` (row and window)."""
    row, window = found // max(1, len(tests.size)), found % max(1, len(tests.size))
    edges = np.searchsorted(row, np.arange(rows + 1))
    none = np.zeros(0, dtype=np.int64)
    out = []
    for a, b in zip(edges, edges[1:]):
        own = [tests.owner[tests.first[k] : tests.first[k + 1]] for k in window[a:b].tolist()]
        out.append(np.unique(np.concatenate(own)) if own else none)
    return out


def _longest(number: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, tests: Tests, items: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """By row, the longest match inside the covered runs and its first word."""
    longest, place = np.zeros(len(first) - 1, dtype=np.int64), np.zeros(len(first) - 1, dtype=np.int64)
    starts, ends = _stretches(starts, ends, most, tests.prefix.shape[1] - 1)
    for a, b in _shards(starts, ends, most):
        text, back = _joined(number, a, b)
        row = np.searchsorted(first, back, side="right") - 1
        here = np.unique(np.concatenate([items[k] for k in np.unique(row[text >= 0]).tolist()]))
        edges = np.append(tests.start, len(tests.text))
        found = longest_matches(text, np.concatenate([tests.text[edges[k] : edges[k + 1]] for k in here.tolist()]))
        at = np.flatnonzero(found)
        at = at[np.lexsort((back[at], -found[at], row[at]))]
        best = at[np.unique(row[at], return_index=True)[1]]
        for k in best[found[best] > longest[row[best]]].tolist():
            longest[row[k]], place[row[k]] = found[k], back[k] - first[row[k]]
    return longest, place


def _pass(docs: DataFrame, block: list[tuple], window: int) -> DataFrame:
    """``docs`` with the columns of ``FOUND`` for one block of the benchmark."""
    schema = T.StructType(docs.schema.fields + FOUND)
    sent = docs.sparkSession.sparkContext.broadcast(tests_of(block, window))  # of BLOCK_BYTES

    def scan(batches):
        for part in passes(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *shard_result(part.column("text"), sent.value)], names=schema.names)

    return map_batches(docs, scan, schema)


def _keys() -> list[Column]:
    return [F.xxhash64("text").alias("__a"), F.xxhash64(F.lit(1), F.col("text")).alias("__b")]


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with, per row: ``n_words``; ``n_hit``, its words inside an occurrence of a
    window of ``window`` item words (an item of fewer words is one window); ``items``, the
    ids of the items with occurring windows, sorted as strings; ``longest_match`` and
    ``longest_at``, length and first word of its longest verbatim match (0 and null
    without a window). Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z
    lower-cased."""
    docs = docs.drop(*RESULT)
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))

    def block(k: int) -> list[tuple]:
        return [tuple(r) for r in blocks.where(F.col("block") == k).select("item_id", "text").collect()]

    found = _pass(docs, block(0), window)
    more = [written(_pass(docs.select("text"), block(k), window).where(F.size("__cover") > 0).select(*_keys(), "__cover", "items", "longest_match", "longest_at").dropDuplicates(["__a", "__b"])) for k in range(1, count)]
    if more:
        found = _with_more(found, reduce(DataFrame.unionByName, more))
    # Spans of different blocks overlap; in order, each adds what lies behind the others.
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    add = lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(x["b"], s["end"]).alias("end"))
    hit = F.aggregate(F.array_sort("__cover"), start, add, lambda s: s["n"])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", hit.alias("n_hit"), "items", "longest_match", "longest_at")


def _with_more(found: DataFrame, more: DataFrame) -> DataFrame:
    """What the first block found, and what others found in the same texts."""
    best = F.max(F.struct("longest_match", (-F.col("longest_at")).alias("before"))).alias("__best")
    merged = written(more.groupBy("__a", "__b").agg(F.flatten(F.collect_list("__cover")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"), best))  # a row for each block at most
    keyed = found.select("*", *_keys())
    entries = merged.agg(F.sum(F.size("__spans") + F.size("__items") + 4)).first()[0] or 0
    joined = keyed.join(F.broadcast(merged) if entries <= BROADCAST_ENTRIES else merged, ["__a", "__b"], "left")
    own = F.struct("longest_match", (-F.col("longest_at")).alias("before"))
    best = F.greatest(own, F.coalesce("__best", own))
    return joined.withColumns(
        {
            "__cover": F.when(F.col("__spans").isNull(), F.col("__cover")).otherwise(F.concat("__cover", "__spans")),
            "items": F.when(F.col("__items").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", "__items")))),
            "longest_match": best["longest_match"],
            "longest_at": -best["before"],
        }
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark."""
    return kept_columns(docs, RESULT, lambda d: contamination(d, benchmark, window=window).where("n_hit = 0"))


def digest(marked: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
