"""Sharding by sampled splitters.

Rows are keyed by a hash of their text, so equal texts lie side by side. A sample drawn in
proportion to size (a row's chance is its share of all bytes) gives quantile boundaries of
the keys; the boundaries cut the rows into many ranges, a key that fills several quantiles
being a range of its own. Exact sizes of all ranges, at most a few thousand numbers, show
those that are overfull; they are subdivided by a second hash of the key, or by row where
one text alone fills the range. The pieces of overfull ranges go, largest first, to the
emptiest shard, and the other ranges fill the shards in key order up to an equal share.
Slots follow from the counts of what is before a piece. A piece of many rows, such as a hot
short text, is numbered in parts, dealt by row, which change nothing about its shard.

Law ``bytes``: shards hold nearly equal sizes. Equal texts share a shard unless their group
has more than an equal share of all bytes, which no shard can hold alone.

Defined cases: a null text has size 1, no checksum, and is a group of its own like an empty
text; equal rows count each; a null doc_id is placed like any other; an empty table gives
an empty result; other columns are not read, and kept by ``write_shards``, but for one named
``shard``, which the result replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, written

SHARDS = 16

#: Ranges, and sampled keys for each range.
RANGES, SAMPLES = 4096, 8

#: A range is overfull above this share of a shard; copies of one text are parted only where
#: they exceed the second, a whole shard. Parts have about so many rows.
OVERFULL, PARTED, UNIT_ROWS = 0.05, 1.0, 1_000_000

LAW = "bytes"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, spread, row): what sharding needs to know of a row."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def splitters(rows: DataFrame, total: int, ranges: int = RANGES) -> list[int]:
    """Boundaries (a range ends with its boundary) from a size-weighted sample."""
    wanted = ranges * SAMPLES
    chance = F.pmod(F.xxhash64("row", "key", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    expected = F.col("size") * (wanted / max(1, total))
    # A row larger than a sampling step counts once for every step that it surely fills.
    times = F.floor(expected) + (chance < expected - F.floor(expected)).cast("int")
    drawn = rows.select("key", F.least(times, F.lit(wanted)).cast("int").alias("times")).where("times > 0").groupBy("key").agg(F.sum("times").alias("times"))
    sample = drawn.toArrow()  # about ``wanted`` rows at most
    order = np.argsort(sample.column("key").to_numpy())
    keys, times = sample.column("key").to_numpy()[order], sample.column("times").to_numpy()[order]
    if not len(keys):
        return []
    at = np.cumsum(times)
    quantiles = np.searchsorted(at, at[-1] * np.arange(1, ranges) / ranges)
    cuts, fills = np.unique(keys[np.minimum(quantiles, len(keys) - 1)], return_counts=True)
    cuts = set(cuts.tolist())
    heavy = keys[times >= SAMPLES].tolist()
    return sorted(cuts | {k for x in heavy for k in (x, x - 1) if k >= -(1 << 63)})


def with_range(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """``rows`` with ``range``, the number of boundaries below their ``key``."""
    schema = rows.withColumn("range", F.lit(0)).schema
    held = np.array(bounds, dtype=np.int64)  # some thousand numbers

    def scan(batches):
        for part in batches:
            found = np.searchsorted(held, part.column("key").to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=schema.names)

    return map_batches(rows, scan, schema)


@dataclass
class Unit:
    """A range, or a piece of an overfull one: it has one shard. ``parts`` number its rows."""

    range: int
    piece: int
    size: int
    rows: int
    heavy: bool
    shard: int = 0
    first: int = 0

    @property
    def parts(self) -> int:
        return max(1, math.ceil(self.rows / UNIT_ROWS))


def place(units: list[Unit], shards: int) -> list[Unit]:
    """Gives every unit a shard and its first slot: the pieces of overfull ranges to the
    emptiest shard, largest first, the others in key order up to an equal share."""
    load = [0] * shards
    for u in sorted((u for u in units if u.heavy), key=lambda u: (-u.size, u.range, u.piece)):
        u.shard = min(range(shards), key=lambda k: (load[k], k))
        load[u.shard] += u.size
    light = sorted((u for u in units if not u.heavy), key=lambda u: (u.range, u.piece))
    left, k = sum(u.size for u in light), 0
    for u in light:
        while k < shards - 1 and load[k] + u.size / 2 > (left + sum(load[k:])) / (shards - k):
            k += 1
        u.shard = k
        load[k] += u.size
        left -= u.size
    rows = [0] * shards
    for u in sorted(units, key=lambda u: (u.range, u.piece)):
        u.first = rows[u.shard]
        rows[u.shard] += u.rows
    return units


@dataclass
class Split:
    """How an overfull range is subdivided: into how many pieces, and whether its copies of
    one text are dealt by row (else texts are dealt)."""

    pieces: int
    by_row: bool


def with_unit(rows: DataFrame, bounds: list[int], splits: dict[int, Split]) -> DataFrame:
    """``rows`` (key, row) with ``range`` and ``piece``."""
    known = rows.sparkSession.createDataFrame([(r, x.pieces, x.by_row) for r, x in splits.items()], "range int, pieces int, by_row boolean")
    ranged = with_range(rows, bounds).join(F.broadcast(known), "range", "left")  # a row for a range at most
    split = F.when(F.col("by_row"), F.xxhash64("key", "row")).otherwise(F.xxhash64("key", F.lit(5)))
    return ranged.withColumn("piece", F.coalesce(F.pmod(split, F.col("pieces")), F.lit(0)).cast("int")).drop("pieces", "by_row")


def splitting(rows: DataFrame, shards: int) -> tuple[list[int], dict[int, Split]]:
    """Boundaries, and how the overfull ranges are subdivided."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds = splitters(rows, total)
    most, parted = max(1, total * OVERFULL / shards), total * PARTED / shards
    sums = with_range(rows, bounds).groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), (F.min("key") == F.max("key")).alias("alone"))
    splits = {}
    for r in sums.where(F.col("size") > most).collect():
        # Copies of one text stay together, or in as few shards as can hold them.
        copies = 1 if r["size"] <= parted else math.ceil(1.05 * r["size"] / parted)
        splits[r["range"]] = Split(min(copies if r["alone"] else math.ceil(r["size"] / most), r["rows"]), r["alone"])
    return bounds, splits


def units_of(placed: DataFrame, splits: dict[int, Split], shards: int) -> list[Unit]:
    """Every unit with its shard; a piece that no row was dealt to has a shard too."""
    found = {(r["range"], r["piece"]): (r["size"], r["rows"]) for r in placed.groupBy("range", "piece").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}
    for r, split in splits.items():
        for piece in range(split.pieces):
            found.setdefault((r, piece), (0, 0))
    return place([Unit(r, p, size, n, r in splits) for (r, p), (size, n) in found.items()], shards)


def numbered(placed: DataFrame, units: list[Unit]) -> DataFrame:
    """``placed`` (range, piece, row) with ``shard`` and ``slot``."""
    spark = placed.sparkSession
    parts = spark.createDataFrame([(u.range, u.piece, u.parts) for u in units], "range int, piece int, parts int")
    rows = placed.join(F.broadcast(parts), ["range", "piece"])  # a row for each unit: some thousand
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(7)), F.col("parts")).cast("int")).drop("parts")
    counts = {(u.range, u.piece, 0): u.rows for u in units if u.parts == 1}
    if several := [u for u in units if u.parts > 1]:
        large = spark.createDataFrame([(u.range, u.piece) for u in several], "range int, piece int")
        counts |= {(r["range"], r["piece"], r["part"]): r["count"] for r in rows.join(F.broadcast(large), ["range", "piece"]).groupBy("range", "piece", "part").count().collect()}
    where = []
    for u in units:
        before = u.first
        for part in range(u.parts):
            where.append((u.range, u.piece, part, u.shard, before))
            before += counts.get((u.range, u.piece, part), 0)
    at = spark.createDataFrame(where, "range int, piece int, part int, shard int, first bigint")
    number = F.row_number().over(W.partitionBy("range", "piece", "part").orderBy("row"))
    joined = rows.withColumn("number", number).join(F.broadcast(at), ["range", "piece", "part"])  # a row for UNIT_ROWS rows
    return joined.withColumn("slot", (F.col("first") + F.col("number") - 1).cast("bigint"))


def assigned(docs: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for every row."""
    rows = written(sized(docs))
    bounds, splits = splitting(rows, shards)
    placed = with_unit(rows, bounds, splits)
    return numbered(placed, units_of(placed, splits, shards)).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS) -> None:
    """Writes the documents as Parquet under ``path``, a folder ``shard=k`` for each shard.
    The shard of a row follows from its text (and, for copies of a parted text, from any
    number), so the documents are neither numbered twice nor shuffled."""
    docs = docs.drop("shard")
    rows = written(sized(docs))
    bounds, splits = splitting(rows, shards)
    units = units_of(with_unit(rows, bounds, splits), splits, shards)
    where = docs.sparkSession.createDataFrame([(u.range, u.piece, u.shard) for u in units], "range int, piece int, shard int")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"))
    with_unit(keyed, bounds, splits).join(F.broadcast(where), ["range", "piece"]).select("doc.*", "shard").write.partitionBy("shard").parquet(path)
