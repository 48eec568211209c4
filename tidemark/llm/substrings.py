"""Removal of repeated word sequences with compressed full-text indexes of shards.

A window is ``window`` consecutive words of one document. Sharding is by content: the anchor
of a window is its run of ``ANCHOR`` words with the smallest hash, so equal windows have equal
anchors, wherever they stand, and consecutive windows share one for a while. A document thus
falls into segments, each the windows of one anchor, of at most ``2 * window - ANCHOR`` words.
Only anchors with several places can hold a repeat; a first pass counts them, a second one
sends the segments of those to their shards. Equal segments are folded to the first place
before they are shuffled, so that copies and very frequent passages travel once a task.
Every shard, of a bounded number of words, builds an FM-index (Burrows-Wheeler transform in a
wavelet tree) of its different segments, streams them through backward search, and from the
matching statistics reports the windows of full length that stand earlier too: the least
place among the rows of the match. An anchor with more than ``HOT`` different segments does
not fit a shard; those are cut into single windows, folded by hash of their words. Of equal
segments all but the first are repeats whole. Spans go back to the documents by a join, and
the words outside stay.

Defined cases: documents are told apart by doc_id, and of two places that with the smaller
(doc_id, start) is earlier; a null doc_id comes before any other; rows of equal doc_id are one
document, so of equal starts none is earlier, and equal rows have equal results; a null or
empty text has no words, and one of fewer words than a window keeps all; of equal texts only
the smallest doc_id's is searched, the others lose every word that a window covers; texts of
any length are read in slices, with the same results; an empty table gives an empty result;
other columns are kept, except ``n_words`` and ``n_removed``, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SLICE_BYTES, SPACE_BYTE, cuts, map_batches, mixed, passes, runs, span_hashes, text_bytes, written
from tidemark.llm.fmindex import FMIndex

WINDOW = 20

#: Words of an anchor.
ANCHOR = 6

#: Different segments of an anchor above which they are compared by single windows.
HOT = 4096

#: Words of a shard, about.
SHARD_WORDS = 1 << 18

#: What may be broadcast: anchors (8 bytes each), texts that repeat (some 30), spans (16).
BROADCAST_ANCHORS, BROADCAST_TEXTS, BROADCAST_SPANS = 2_000_000, 500_000, 2_000_000

_KEY = ["doc_id", "__a", "__b"]

_SPAN = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _sized(df: DataFrame, size: int, most: int) -> DataFrame:
    return F.broadcast(df) if size <= most else df


class _Words:
    """The words of some rows: one byte array with a space behind every word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool):
        starts, ends = runs(~SPACE_BYTE[data], offsets)
        keep = ~SPACE_BYTE[data]
        self.first = np.searchsorted(starts, offsets)  # the first word of every row
        self.hashes = span_hashes(data, starts, ends) if hashed else None
        sizes = ends - starts
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.bytes = np.full(int(sizes.sum()) + len(sizes), 0x20, dtype=np.uint8)
        place = np.ones(len(self.bytes), dtype=bool)
        place[self.ends] = False
        self.bytes[place] = data[keep]


def _pieces(texts: pa.Array, window: int, size: int = SLICE_BYTES, *, hashed: bool = True) -> Iterator[tuple[_Words, np.ndarray]]:
    """(words, places of the rows' first words): all rows at once, or one long row in slices,
    each with the last ``window - 1`` words of the one before."""
    data, offsets = text_bytes(texts)
    if len(texts) != 1 or len(data) <= size:
        words = _Words(data, offsets, hashed)
        yield words, np.zeros(len(offsets) - 1, dtype=np.int64)
        return
    before, count = np.zeros(0, dtype=np.uint8), 0
    for a, b in cuts(data, size, whole=True):
        part = np.concatenate([before, data[a:b]])
        words = _Words(part, np.array([0, len(part)]), hashed)
        yield words, np.array([count])
        fresh = max(0, len(words.starts) - window + 1)
        count += fresh
        before = words.bytes[words.starts[fresh] :] if len(words.starts) > fresh else np.zeros(0, dtype=np.uint8)


def anchored(words: _Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor) of every segment."""
    n, m = len(words.hashes), min(ANCHOR, window)
    if n < window:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    gram = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(m):
            gram[: n - k] = mixed(gram[: n - k] + words.hashes[k:])
    least, place, have, wanted = gram, np.arange(n), 1, window - m + 1
    while have < wanted:  # the leftmost least of ``have`` grams, by doubling
        k = min(have, wanted - have)
        better = least[k:] < least[: n - k]
        least, place = (np.concatenate([np.where(better, x[k:], x[: len(better)]), x[len(better) :]]) for x in (least, place))
        have += k
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    whole = np.flatnonzero(np.arange(n) + window <= words.first[row + 1])
    row, place = row[whole], place[whole]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(row) != 0)])) if len(whole) else whole
    count = np.diff(np.append(begin, len(whole)))
    return row[begin], whole[begin], count, least[whole[begin]].view(np.int64)


def _anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    """(h, places): anchors with several places."""
    schema = "h bigint, places bigint"

    def scan(batches):
        for part in passes(batches):
            for words, _ in _pieces(part.column("text"), window):
                h, n = np.unique(anchored(words, window)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "places"])

    counted = map_batches(docs.select("text"), scan, schema).groupBy("h").agg(F.sum("places").alias("places"))
    return counted.where(F.col("places") > 1)


def _segments(docs: DataFrame, window: int, *, words: bool = True) -> DataFrame:
    """Every document's segments: anchor ``h``, first window ``at``, ``n`` windows and, if
    wanted, their ``words``. Where ``docs`` have lists ``__at`` only those first windows."""
    fields = [docs.schema[c] for c in _KEY] + [T.StructField("h", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.IntegerType())]
    schema = T.StructType(fields + [T.StructField("words", T.StringType())] * words)
    listed = "__at" in docs.columns

    def scan(batches):
        for part in passes(batches):
            keys = [part.column(c) for c in _KEY]
            for piece, place in _pieces(part.column("text"), window):
                row, at, n, h = anchored(piece, window)
                begin = at - piece.first[row] + place[row]
                if listed:
                    lists = part.column("__at")
                    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                    wanted = np.isin((row << 40) + begin, (owner << 40) + lists.flatten().to_numpy())
                    row, at, n, h, begin = row[wanted], at[wanted], n[wanted], h[wanted], begin[wanted]
                columns = [*(k.take(pa.array(row)) for k in keys), pa.array(h), pa.array(begin), pa.array(n, pa.int32())]
                if words:
                    data = piece.bytes.tobytes()
                    columns.append(pa.array([data[a:b] for a, b in zip(piece.starts[at].tolist(), piece.ends[at + n + window - 2].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_batches(docs.select(*_KEY, "text", *["__at"] * listed), scan, schema)


def _candidates(docs: DataFrame, window: int) -> DataFrame:
    """The segments of anchors with several places, with their words."""
    repeated = written(_anchor_counts(docs, window).select("h"))
    if repeated.count() <= BROADCAST_ANCHORS:
        return _segments(docs, window).join(F.broadcast(repeated), "h")
    # Places first and their words then, so that no other words are shuffled.
    key = ["doc_id", "__a"]
    places = _segments(docs, window, words=False).join(repeated, "h").groupBy(*key).agg(F.collect_list("at").alias("__at"))  # of one text
    own = docs.withColumnsRenamed({c: f"_{c}" for c in key})
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in key]
    return _segments(own.join(places, same).select(*_KEY, "text", "__at"), window)


def repeated_windows(shard: pa.Table, window: int) -> list[np.ndarray]:
    """For every row of a shard (``doc_id``, ``at``, ``h``, ``words``: different segments with
    their first place) the windows, counted from its first one, that stand earlier too."""
    none = [np.zeros(0, dtype=np.int64)] * shard.num_rows
    anchors, which, times = np.unique(shard["h"].to_numpy(), return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[which] > 1)  # another anchor's segments share no window
    if not len(several):
        return none
    part = shard.take(pa.array(several))
    lists = pc.split_pattern(part["words"].combine_chunks(), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    number = pc.dictionary_encode(lists.flatten()).indices.to_numpy() + 1  # exact words
    first = np.cumsum(counts + 1) - (counts + 1)
    text = np.zeros(int(counts.sum()) + len(counts), dtype=np.int64)
    inside = np.arange(len(number)) + np.repeat(np.arange(len(counts)), counts)
    text[inside] = number
    # Places in their order: doc_id (null first), then the word in the document.
    document = pc.rank(part["doc_id"].combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    when = np.zeros(len(text), dtype=np.int64)
    when[inside] = np.repeat((document << 40) + part["at"].to_numpy(), counts) + np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
    index = FMIndex(text, window)
    windows = counts - window + 1
    begin = np.repeat(first, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    length, low, high = index.matching_statistics(begin + window, window)
    full = np.flatnonzero(length == window)
    low, group = np.unique(low[full], return_inverse=True)  # ranges of one length are equal or apart
    ends = np.zeros(len(low), dtype=np.int64)
    ends[group] = high[full]
    edges = np.stack([low, ends], axis=1).ravel()
    earliest = np.minimum.reduceat(np.append(when[index.order], np.iinfo(np.int64).max), edges)[::2] if len(edges) else edges
    late = full[earliest[group] < when[begin[full]]]
    owner = np.repeat(np.arange(len(windows)), windows)[late]
    place = begin[late] - first[owner]
    for k, a, b in zip(several.tolist(), np.searchsorted(owner, np.arange(len(windows))).tolist(), np.searchsorted(owner, np.arange(1, len(windows) + 1)).tolist()):
        none[k] = place[a:b]
    return none


def _spans(places: np.ndarray) -> list[dict]:
    """Runs of consecutive windows."""
    if not len(places):
        return []
    edge = np.flatnonzero(np.diff(places) != 1) + 1
    return [{"a": int(a), "b": int(b) + 1} for a, b in zip(places[np.append(0, edge)], places[np.append(edge - 1, len(places) - 1)])]


def _content() -> Column:
    return F.xxhash64(F.lit(1), F.col("words"))


def _contents(segments: DataFrame) -> DataFrame:
    """The different segments (h, k), their first place (``doc_id``, ``at``) and how many there are."""
    folded = segments.groupBy("h", _content().alias("k")).agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count("*").alias("times"), F.min("words").alias("words"))
    return folded.select("h", "k", "f.doc_id", "f.at", "times", "words")


def _indexed(contents: DataFrame, rows: int, window: int) -> DataFrame:
    """(h, k, doc_id, at, times, spans): of every segment the windows of its first place that
    stand earlier too, by the FM-indexes of shards of anchors."""
    shards = max(1, -(-rows * 3 * window // (2 * SHARD_WORDS)))
    schema = T.StructType([contents.schema[c] for c in ("h", "k", "doc_id", "at", "times")] + [T.StructField("spans", T.ArrayType(_SPAN))])
    kinds = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def shard(table: pa.Table) -> pa.Table:
        spans = [_spans(x) for x in repeated_windows(table, window)]
        return table.select(["h", "k", "doc_id", "at", "times"]).append_column("spans", pa.array(spans, kinds))

    return contents.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInArrow(shard, schema)


def _by_window(contents: DataFrame, window: int) -> DataFrame:
    """The same for segments of an anchor with too many for a shard: by their single windows."""
    words = F.array_join(F.slice("word", F.col("i") + 1, window), " ")
    count = F.size("word") - window + 1
    cut = contents.withColumn("word", F.split("words", " ")).withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    cut = cut.select("h", "k", "doc_id", "at", "times", "i", F.xxhash64(words).alias("x"), F.xxhash64(F.lit(1), words).alias("y"))
    place = F.struct(F.col("doc_id"), (F.col("at") + F.col("i")).alias("at"))
    firsts = cut.groupBy("x", "y").agg(F.min(place).alias("first"))
    late = cut.join(firsts, ["x", "y"]).withColumn("span", F.when(F.col("first") < place, F.struct(F.col("i").cast("bigint").alias("a"), (F.col("i") + 1).cast("bigint").alias("b"))))
    return late.groupBy("h", "k", "doc_id", "at", "times").agg(F.collect_list("span").alias("spans"))  # of one segment


def _verdicts(segments: DataFrame, window: int, hot: int) -> DataFrame:
    """For every different segment (h, k) that has something to report: its first place
    (``doc``, ``begin``) and the spans of its windows there that stand earlier too."""
    contents = written(_contents(segments))
    crowded = contents.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h")  # a row for ``hot`` contents at most
    crowded = written(crowded)
    found = _indexed(contents.join(crowded, "h", "left_anti"), contents.count(), window)
    if not crowded.isEmpty():
        found = found.unionByName(_by_window(contents.join(crowded, "h", "left_semi"), window))
    return written(found.where((F.size("spans") > 0) | (F.col("times") > 1)).withColumnsRenamed({"doc_id": "doc", "at": "begin"}))


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc_id, __a, __b, spans): by document the windows [a, b) that stand earlier too.
    ``docs`` have one row of every different text, with keys ``__a`` and ``__b``."""
    segments = written(_candidates(docs, window).select(*_KEY, "h", "at", "n", "words"))
    verdicts = _verdicts(segments, window, hot).drop("times")
    first = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("at") == F.col("begin"))
    own = F.transform("spans", lambda x: F.struct((x["a"] + F.col("at")).alias("a"), (x["b"] + F.col("at")).alias("b")))
    whole = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")))
    joined = segments.select(*_KEY, "h", _content().alias("k"), "at", "n").join(verdicts, ["h", "k"]).withColumn("s", F.when(first, own).otherwise(whole))
    listed = joined.where(F.size("s") > 0).groupBy(*_KEY).agg(F.flatten(F.collect_list("s")).alias("spans"))  # of one text
    return listed.mapInArrow(_merged, listed.schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of spans with those that touch as one."""
    for batch in batches:
        lists = batch.column("spans")
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        spans = lists.flatten()
        a, b = spans.field("a").to_numpy(), spans.field("b").to_numpy()
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], b[order]
        fresh = np.ones(len(a), dtype=bool)  # spans of a text do not overlap: windows are in one segment
        fresh[1:] = (row[1:] != row[:-1]) | (a[1:] > b[:-1])
        first = np.flatnonzero(fresh)
        merged = pa.StructArray.from_arrays([pa.array(a[first]), pa.array(b[np.append(first[1:], len(a)) - 1])], names=["a", "b"])
        bounds = pa.array(np.searchsorted(row[first], np.arange(len(lists) + 1)).astype(np.int32))
        yield batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.ListArray.from_arrays(bounds, merged))


def _covered(piece: _Words, place: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of a piece are in the spans of words [a, b) of the rows ``owner``."""
    n = np.diff(piece.first)
    low, high = (np.clip(x - place[owner], 0, n[owner]) + piece.first[owner] for x in (a, b))
    change = np.bincount(low, minlength=len(piece.starts) + 1) - np.bincount(high, minlength=len(piece.starts) + 1)
    return np.cumsum(change)[: len(piece.starts)] > 0


def _without(part: pa.RecordBatch, window: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(texts, words, removed words) of rows with ``text``, ``__copy`` and ``__spans``."""
    rows, texts = part.num_rows, part.column("text")
    whole = rows != 1 or len(texts[0].as_py() or "") <= SLICE_BYTES // 4
    pieces = list(_pieces(texts, 1, hashed=False)) if whole else None  # a long row is read twice
    total = sum(np.diff(piece.first) for piece, _ in pieces or _pieces(texts, 1, hashed=False)) + np.zeros(rows, dtype=np.int64)
    lists = part.column("__spans")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    spans = lists.flatten()
    copies = np.flatnonzero(part.column("__copy").to_numpy(zero_copy_only=False).astype(bool) & (total >= window))
    owner = np.concatenate([np.repeat(np.arange(rows), sizes), copies])
    a = np.concatenate([spans.field("a").to_numpy(), np.zeros(len(copies), dtype=np.int64)])
    b = np.concatenate([spans.field("b").to_numpy() + window - 1, total[copies]])
    removed, out = np.zeros(rows, dtype=np.int64), [[] for _ in range(rows)]
    for piece, place in pieces or _pieces(texts, 1, hashed=False):
        gone = _covered(piece, place, owner, a, b)
        data = piece.bytes[np.repeat(~gone, piece.ends - piece.starts + 1)].tobytes()
        edges = np.concatenate([[0], np.cumsum(np.where(gone, 0, piece.ends - piece.starts + 1))])[piece.first].tolist()
        removed += np.bincount(np.repeat(np.arange(rows), np.diff(piece.first))[gone], minlength=rows)
        for k, (x, y) in enumerate(zip(edges, edges[1:])):
            if y > x:
                out[k].append(data[x : y - 1].decode())
    null = texts.is_null().to_pylist()
    return [None if n else " ".join(x) for x, n in zip(out, null)], total, removed


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``docs`` with ``text`` cut to the words, joined by one space, that no window covers
    whose words also start earlier; and ``n_words`` (before) and ``n_removed``. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged. A null text stays null."""
    docs = docs.drop("n_words", "n_removed")
    keyed = docs.withColumns({"__a": F.xxhash64("text"), "__b": F.xxhash64(F.lit(1), F.col("text"))})
    several = keyed.where(F.col("text").isNotNull()).groupBy("__a", "__b").agg(F.min(F.struct("doc_id")).alias("__first"), F.count("*").alias("n"))
    several = written(several.where(F.col("n") > 1).drop("n"))
    later = F.col("__first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("__first.doc_id"))
    marked = keyed.join(_sized(several, several.count(), BROADCAST_TEXTS), ["__a", "__b"], "left").withColumn("__copy", later)
    spans = written(repeated_spans(marked.where(~F.col("__copy") & F.col("text").isNotNull()).select(*_KEY, "text"), window=window, hot=hot))
    entries = spans.agg(F.sum(F.size("spans") + 2)).first()[0] or 0
    there = spans.withColumnsRenamed({c: f"_{c}" for c in _KEY} | {"spans": "__spans"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("__a") == F.col("___a")) & (F.col("__b") == F.col("___b"))
    names = [*docs.columns, "__copy", "__spans"]
    joined = marked.join(_sized(there, entries, BROADCAST_SPANS), same, "left").select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches):
        for part in passes(batches):
            texts, total, removed = _without(part, window)
            kept = [pa.array(texts, part.schema.field("text").type) if c == "text" else part.column(c) for c in docs_columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total), pa.array(removed)], names=schema.names)

    docs_columns = docs.columns
    return map_batches(joined, cut, schema)


def digest(done: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
