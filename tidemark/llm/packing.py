"""Best-fit packing of token sequences by large-item matching.

Texts are tokenized once; a row for each piece (length and checksum, no ids) is kept. A
packing depends only on how many pieces there are of each length, at most
``capacity`` numbers however large the corpus, so the plan is made from that histogram:
pieces above one third of the capacity pair by greedy matching (each, from the largest
down, with the largest that still fits), at most two to a sequence; smaller pieces, from
the largest down, best-fit the remaining gaps. The plan names, for every length, which of
its pieces go to which sequence; pieces get their number within a length from salted
groups, so no length is ever in one task.

Defined cases: a null or empty text is the end token alone; equal rows are packed each; a
null doc_id is packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, passes, written

CAPACITY, END = 1024, 2

#: Pieces of one length that are numbered together, about; groups of a length at most.
GROUP, GROUPS = 2000, 256

#: White space runs this long are more than the faster encoder's split pattern can take.
LONG_RUN = 100_000

#: The characters that a split pattern's white space class holds.
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from text to its ids, for a byte-level BPE file of ``tokenizers``, as that
    library gives them with ``add_special_tokens=False``: the string of a special token in
    a text is that token.

    The file's vocabulary and split pattern run on tiktoken's encoder, several times faster.
    A white space run is one word of the pattern, without its last character if text
    follows; very long ones are cut out at these places and encoded by ``tokenizers``."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    vocabulary = stored["model"]["vocab"]
    byte_of = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if all(c in byte_of for c in piece)}
    special = {x["content"]: x["id"] for x in stored["added_tokens"]}
    for content in special:
        ranks.pop(content.encode(), None)
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else re.compile("(?!)")
    long_run = re.compile(f"{_WHITE}{{{LONG_RUN},}}")

    def parts(text: str):
        for piece in marks.split(text):
            at = 0
            for run in long_run.finditer(piece):
                end = run.end() - (run.end() < len(piece))
                yield fast.encode_to_numpy(piece[at : run.start()], allowed_special="all")
                own = Tokenizer.from_file(path)  # seldom needed, and large
                yield np.array(own.encode(piece[run.start() : end], add_special_tokens=False).ids, dtype="<u4")
                at = end
            yield fast.encode_to_numpy(piece[at:], allowed_special="all")

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and long_run.search(text):
            return np.concatenate(list(parts(text)))
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: a
    printable Latin-1 character is itself, the others follow from code point 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end``, cut into
    pieces of ``capacity`` ids where longer; the first piece takes what is left over."""
    rows = docs.select("doc_id", "text")
    schema = rows.selectExpr("doc_id", "0 AS piece", "0L AS start", "0L AS length", "0L AS ids_crc32").schema

    def scan(batches):
        encode = tokenizer(path)
        for part in passes(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                cuts = list(range(len(ids) % capacity, len(ids) + 1, capacity))
                cuts = cuts if cuts[0] == 0 else [0, *cuts]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=schema.names,
            )

    return map_batches(rows, scan, schema)


@dataclass
class Bin:
    """``count`` sequences with pieces of the same lengths."""

    lengths: list[int]
    gap: int
    count: int


@dataclass
class Plan:
    """Slots by length: ``slots[length]`` lists (pieces before, first sequence, offset)."""

    sequences: int
    slots: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)


def match(counts: dict[int, int], capacity: int) -> list[Bin]:
    """Greedy matching of the pieces above a third of the capacity."""
    left = {length: n for length, n in counts.items() if 3 * length > capacity and n}
    bins = []
    for length in sorted(left, reverse=True):
        while n := left[length]:
            other = max((x for x, m in left.items() if m and x <= min(length, capacity - length) and (x != length or n > 1)), default=None)
            if other is None:
                bins.append(Bin([length], capacity - length, n))
                left[length] = 0
                continue
            m = n // 2 if other == length else min(n, left[other])
            bins.append(Bin([length, other], capacity - length - other, m))
            left[length] -= m
            left[other] -= m
    return bins


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length. Equal sequences are handled together,
    so the work depends on the lengths and not on the number of pieces."""
    by_gap: dict[int, list[Bin]] = {}
    for b in match(counts, capacity):
        by_gap.setdefault(b.gap, []).append(b)
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        n = counts[length]
        while n:
            gap = min((g for g, bins in by_gap.items() if bins and g >= length), default=None)
            b = Bin([], capacity, -(-n // (capacity // length))) if gap is None else by_gap[gap].pop()
            each = b.gap // length
            full = min(b.count, n // each)
            for k, count in ((each, full), (n - full * each, 1)):
                if count and 0 < k <= each and b.count >= count:
                    by_gap.setdefault(b.gap - k * length, []).append(Bin(b.lengths + [length] * k, b.gap - k * length, count))
                    b.count -= count
                    n -= k * count
            if b.count:
                by_gap.setdefault(b.gap, []).append(b)
    plan = Plan(0)
    used: dict[int, int] = {}
    for bins in by_gap.values():
        for b in bins:
            at = 0
            for length in b.lengths:
                plan.slots.setdefault(length, []).append((used.get(length, 0), plan.sequences, at))
                used[length] = used.get(length, 0) + b.count
                at += length
            plan.sequences += b.count
    return plan


def packed(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.
    The pieces are a written table, so that a lost executor cannot number them anew."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity=capacity, end=end))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = pack({x: n for x, n in counts.items() if x < capacity}, capacity)
    numbered = cut.withColumn("__row", F.monotonically_increasing_id())
    whole = numbered.where(F.col("length") == capacity).select(*cut.columns, (F.lit(plan.sequences) + F.col("__row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    groups = spark.createDataFrame([(x, max(1, min(GROUPS, n // GROUP))) for x, n in counts.items()], "length bigint, groups int")  # capacity rows at most
    parts = numbered.where(F.col("length") < capacity).join(F.broadcast(groups), "length")
    parts = parts.select(*cut.columns, "__row", F.pmod(F.xxhash64("__row"), "groups").cast("int").alias("__group"))
    sizes = {(r["length"], r["__group"]): r["count"] for r in parts.groupBy("length", "__group").count().collect()}
    before, running = [], {}
    for (length, group), n in sorted(sizes.items()):
        before.append((length, group, running.get(length, 0)))
        running[length] = running.get(length, 0) + n
    sent = spark.sparkContext.broadcast((before, plan.slots))
    schema = parts.drop("__row", "__group").selectExpr("*", "0L AS sequence_id", "0L AS offset").schema

    def place(batches):
        first, slots = {(x, g): n for x, g, n in sent.value[0]}, {x: np.array(s, dtype=np.int64) for x, s in sent.value[1].items()}
        key, seen = None, 0
        for batch in batches:
            length, group = batch.column("length").to_numpy(), batch.column("__group").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(length) != 0) | (np.diff(group) != 0)) + 1).tolist(), len(length)]
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                now = (int(length[a]), int(group[a]))
                key, seen = now, seen if now == key else 0
                rank = first[now] + seen + np.arange(b - a)
                own = slots[now[0]]
                at = np.searchsorted(own[:, 0], rank, side="right") - 1
                sequence[a:b] = own[at, 1] + rank - own[at, 0]
                offset[a:b] = own[at, 2]
                seen += b - a
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-2]), pa.array(sequence), pa.array(offset)], names=schema.names)

    dealt = parts.repartition("length", "__group").sortWithinPartitions("length", "__group", "__row").select(*schema.names[:-2], "__group")
    return whole.unionByName(map_batches(dealt, place, schema))
