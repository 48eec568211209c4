"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed once (XXH64 of 4-word shingles, bit majority) and copies are
folded to one row for each different fingerprint. All-pairs tiles over the whole table would
be quadratic, so tiles are formed inside buckets that no link can leave: fingerprints within
``radius`` bits agree on all but ``radius`` blocks of any division into blocks (pigeonhole),
and rows are dealt to a bucket for every choice of agreeing blocks. A bucket is compared
exactly, with numpy exclusive-or and bit counts; one of up to ``tile`` rows is a single
tile, a larger one is cut into tiles by population count, tile pairs whose population counts
differ by more than ``radius`` are skipped, and the other pairs are spread over tasks. A
tile pair emits a spanning forest, strip by strip, never all links. Components are found by
rounds of minimum labels, each round a written table.

Defined cases: a null or empty text has no words and fingerprint zero, which links like any
other; fewer than 4 words make one shingle; texts over ``SLICE_BYTES`` are hashed in slices,
with the same result; a null doc_id takes part, but names a component only if no other
document is in it; rows with equal doc_id are separate documents; an empty table gives an
empty result; other columns, whatever their names, are not read, and
``drop_near_duplicates`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_BYTE, SLICE_BYTES, SPACE_BYTE, cuts, map_batches, passes, runs, text_bytes, written

SHINGLE, SEED, RADIUS = 4, 42, 4

#: Fingerprints of a tile, about.
TILE = 4096

#: Rows that may be broadcast.
BROADCAST_ROWS = 500_000

_HASH_CHUNK = 1 << 19


def shingle_hashes(text: bytes, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, space-joined, A-Z lower-cased."""
    data = LOWER_BYTE[np.frombuffer(text, dtype=np.uint8)]
    starts, ends = runs(~SPACE_BYTE[data], np.array([0, len(data)]))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts + 1
    total = int(sizes.sum())
    joined = np.full(total, 0x20, dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    inside = np.ones(total, dtype=bool)
    inside[begin + sizes - 1] = False
    joined[inside] = data[~SPACE_BYTE[data]]
    n = max(1, len(starts) - words + 1)
    first, last = begin[:n], (begin + sizes - 1)[min(words, len(starts)) - 1 :]
    body, digest = joined.tobytes(), xxhash.xxh64_intdigest
    out = np.empty(n, dtype=np.uint64)
    for a in range(0, n, _HASH_CHUNK):
        b = min(n, a + _HASH_CHUNK)
        out[a:b] = np.fromiter((digest(body[s:e], seed) for s, e in zip(first[a:b].tolist(), last[a:b].tolist())), dtype=np.uint64, count=b - a)
    return out


def fingerprint(text: np.ndarray, words: int = SHINGLE, seed: int = SEED, size: int = SLICE_BYTES) -> int:
    """The bits that are set in over half of the hashes of a text's shingles. A slice of a
    long text begins with the last words of the one before."""
    count, total = np.zeros(64, dtype=np.int64), 0
    before: list[bytes] = []  # words that the next shingles begin with
    for a, b in cuts(text, size, whole=True):
        part = b" ".join([*before, text[a:b].tobytes()])
        if b < len(text) or total:
            own = part.split()  # at ASCII white space, as the words are
            before = own[max(0, len(own) - words + 1) :]
            if len(own) < words:
                if b < len(text) or total:
                    continue
        hashes = shingle_hashes(part, words, seed)
        count += bit_counts(hashes)
        total += len(hashes)
    return sum(1 << int(k) for k in np.flatnonzero(2 * count > total))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    count = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), _HASH_CHUNK):
        part = np.ascontiguousarray(hashes[a : a + _HASH_CHUNK])
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return count


def with_fingerprint(docs: DataFrame, name: str = "fp", *, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with the fingerprint of every text as a signed 64-bit number."""
    schema = docs.withColumn(name, F.lit(0).cast("bigint")).schema

    def scan(batches):
        for part in passes(batches):
            data, offsets = text_bytes(part.column("text"))
            prints = [fingerprint(data[a:b], words, seed) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=schema.names)

    return map_batches(docs, scan, schema)


def fingerprints(docs: DataFrame, *, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row."""
    return with_fingerprint(docs.select("doc_id", "text"), words=words, seed=seed).select("doc_id", "fp")


def block_masks(count: int, radius: int = RADIUS) -> list[int]:
    """Masks of 64 bits, signed: two numbers that differ in at most ``radius`` bits agree
    under one of them. The fewer the rows, the fewer and the shorter the masks."""
    parts = radius + 1
    while count > 256 << (64 * (parts - radius) // parts) and parts < 2 * radius:
        parts += 1
    edges = [64 * k // parts for k in range(parts + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _ones(column: str) -> Column:
    return F.bit_count(F.col(column)).cast("int")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def tiled(nodes: DataFrame, masks: list[int], radius: int, tile: int) -> DataFrame:
    """(mask, part, pair, side, fp): the rows of every tile pair that has to be compared.
    Side 0 is compared with itself if it is alone, else with side 1."""
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks)]))
    rows = nodes.select("fp", parts.alias("x")).select("fp", "x.mask", "x.part").withColumn("band", F.floor(_ones("fp") / max(1, radius)).cast("int"))
    by_band = rows.groupBy("mask", "part", "band").agg(F.count("*").alias("n"))
    cut = F.transform(
        F.collect_list(F.struct("band", "n")), lambda x: F.struct(x["band"].alias("band"), F.ceil(x["n"] / tile).cast("int").alias("tiles"))
    )
    large = written(by_band.groupBy("mask", "part").agg(F.sum("n").alias("n"), cut.alias("cut")).where(F.col("n") > tile).select("mask", "part", "cut"))
    joined = rows.join(_sized(large), ["mask", "part"], "left")
    tiles_here = F.filter("cut", lambda x: x["band"] == F.col("band"))[0]["tiles"]
    joined = joined.withColumn("own", F.pmod(F.xxhash64("fp"), tiles_here).cast("int"))

    def others(x: Column) -> Column:
        def pair(k: Column) -> Column:
            other, own = F.struct(x["band"].alias("band"), k.alias("tile")), F.struct(F.col("band").alias("band"), F.col("own").alias("tile"))
            low, high = F.least(own, other), F.greatest(own, other)
            return F.struct(low.alias("low"), high.alias("high"), (own > other).cast("int").alias("side"))

        return F.transform(F.sequence(F.lit(0), x["tiles"] - 1), pair)

    near = F.filter("cut", lambda x: F.abs(x["band"] - F.col("band")) <= 1)
    tile_type = F.struct(F.lit(-1).alias("band"), F.lit(-1).alias("tile"))
    alone = F.array(F.struct(tile_type.alias("low"), tile_type.alias("high"), F.lit(0).alias("side")))
    pairs = F.when(F.col("cut").isNull(), alone).otherwise(F.flatten(F.transform(near, others)))
    out = joined.select("mask", "part", "fp", F.explode(pairs).alias("p"))
    return out.select("mask", "part", F.col("p.low").alias("low"), F.col("p.high").alias("high"), F.col("p.side").alias("side"), "fp")


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with at most ``radius`` differing bits, strip by strip. Both are sorted
    by population count; strips whose counts differ by more than ``radius`` are not
    compared."""
    ones_a, ones_b = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    for s in range(0, len(a), 256):
        e = min(len(a), s + 256)
        low, high = np.searchsorted(ones_b, [ones_a[s] - radius, ones_a[e - 1] + radius + 1])
        i, j = np.nonzero(np.bitwise_count(a[s:e, None] ^ b[None, low:high]) <= radius)
        yield i + s, j + low


def forest(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value linked to a smaller one, the smallest it can reach, as places (value,
    smallest); links by place, values in order."""
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    linked = np.flatnonzero(label != np.arange(len(values)))
    return linked, label[linked]


def _compare(values: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(np.bitwise_count(values.view(np.uint64)), kind="stable")
    values, side = values[order], side[order]
    bits = values.view(np.uint64)
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if side.any() else a
    place = np.argsort(np.argsort(values, kind="stable"), kind="stable")  # in order of the values
    ordered = np.sort(values)
    u, v = [], []
    for i, j in near_pairs(bits[a], bits[b], radius) if len(a) else ():
        x, y = forest(ordered, place[a[i]], place[b[j]])  # a forest of the strip's links
        u.append(x)
        v.append(y)
    if not u:
        return values[:0], values[:0]
    x, y = forest(ordered, np.concatenate(u), np.concatenate(v))
    return ordered[x], ordered[y]


def links(tiles: DataFrame, radius: int) -> DataFrame:
    """(u, v) with v < u: a spanning forest of the links inside every tile pair."""
    key = ["mask", "part", "low", "high"]
    dealt = tiles.repartition(*key).sortWithinPartitions(*key)
    dealt = dealt.select(F.xxhash64(*key).alias("key"), "mask", "part", F.struct("low", "high").cast("string").alias("pair"), "side", "fp")

    def scan(batches):
        held: list[pa.RecordBatch] = []

        def compared(table: pa.Table):
            side, fp = table.column("side").to_numpy().astype(np.int8), table.column("fp").to_numpy()
            edges = _edges(table)
            u, v = [], []
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    x, y = _compare(fp[a:b], side[a:b], radius)
                    u.append(x)
                    v.append(y)
            if u and sum(map(len, u)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            edges = _edges(table)
            yield from compared(table.slice(0, edges[-2]))
            held = table.slice(edges[-2]).to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    return map_batches(dealt, scan, "u bigint, v bigint").distinct()


def _edges(table: pa.Table) -> list[int]:
    """Where the groups of a sorted table begin, and its end."""
    n = table.num_rows
    change = np.zeros(n, dtype=bool)
    for name in ("key", "mask", "part"):
        x = table.column(name).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return [0, *np.flatnonzero(change).tolist(), n]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (u, v), the smallest node it can reach.

    Large-star and small-star rounds: every node's larger, then its smaller neighbours are
    tied to the smallest one it knows, until nothing changes. Each round is one aggregation
    of minima and one join, whose hot side Spark splits."""
    edges = written(edges)
    before = None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before:
        before = now
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u > v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(docs: DataFrame, *, radius: int = RADIUS, words: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, root, component_id), a row for every row of ``docs``."""
    prints = written(fingerprints(docs, words=words))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    masks = block_masks(nodes.count(), radius)
    roots = components(links(tiled(nodes.select("fp"), masks, radius, tile), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_print = placed.join(named, "root").select("fp", "root", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, words: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row for every document: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest doc_id that links of at most ``radius`` bits reach."""
    return grouped(docs, radius=radius, words=words, tile=tile).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component, one with the smallest doc_id."""
    found = written(grouped(docs, radius=radius, words=words))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    several = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__several")))
    same = F.col("doc_id").eqNullSafe(F.col("__several"))
    gone = written(found.where(~first).select(F.col("doc_id").alias("__gone")))
    if several.isEmpty():
        return docs.join(_sized(gone), F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
    # A doc_id of several rows may stay in one component and go in another.
    single = docs.join(several, same, "left_anti").join(gone, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
    stays = found.join(several, same, "left_semi").where(first).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__own"), "root").distinct()
    shared = with_fingerprint(docs.join(several, same, "left_semi"), "__fp", words=words)
    shared = shared.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__own"))).dropDuplicates(["root"])
    return single.unionByName(shared.select(*[F.col(f"`{c}`") for c in docs.columns]))
