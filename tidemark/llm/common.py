"""Helpers that the corpus operators share.

Texts reach Python as Arrow batches; the helpers here look at a whole batch as one byte
array with row offsets, so that the work inside a task is numpy over bytes and never a
loop over characters.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one numpy pass looks at. A longer single text is a pass of its own.
PASS_BYTES = 1 << 20

#: Bytes of a slice of a longer text, about. Operators add up what they find in the slices.
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch between Spark and Python, about.
BATCH_BYTES = 4 << 20

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte to byte, A-Z lower-cased.
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32

#: ASCII white space: the space and 0x09-0x0D.
SPACE_BYTE = np.zeros(256, dtype=bool)
SPACE_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing and the master is local, a temporary folder serves
    (tests); on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_columns(docs: DataFrame, names: list[str], work) -> DataFrame:
    """``work(docs)`` with exactly the columns of ``docs``, also where some of them have the
    ``names`` (in any case) that ``work`` gives its own results."""
    taken = {n.lower() for n in names}
    aside = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c.lower() in taken}
    done = work(docs.withColumnsRenamed(aside))
    return done.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def map_batches(df: DataFrame, scan, schema) -> DataFrame:
    """``mapInArrow`` with Arrow batches bounded in bytes: by default a batch has 10,000 rows
    whatever their size. The bound is a setting of the session, which plans take up when they
    are run, so it stays set; where the session has a bound of its own that one is kept."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(scan, schema)


def lower_ascii(column):
    """A-Z lower-cased, every other character kept. ``lower`` is faster and equal where a
    text is ASCII, or holds only ASCII and lower-case letters."""
    plain = (F.octet_length(column) == F.length(column)) | ~column.rlike(r"[^\x00-\x7F\p{Ll}]")
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def passes(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``size`` bytes of ``column`` each; a row of more than
    ``SLICE_BYTES`` is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(lengths) - lengths) // size
        alone = lengths > SLICE_BYTES
        change = (np.diff(group) != 0) | alone[1:] | alone[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the offsets of its rows in them. Null: empty."""
    array = pc.fill_null(array, "")
    array = array if array.type == pa.large_string() else array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(array) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def seamed(texts: pa.Array, reach: int, size: int | None = None) -> Iterator[tuple[np.ndarray, pa.Array, int]]:
    """(row of every part, parts, sign): all rows up to ``size`` bytes at once, then every
    longer row in slices, so that no numpy pass is much larger than a slice. For what is
    added up over bytes, words and their neighbours within ``reach`` bytes or one word, the
    signed sum over the parts is that of the whole text: every slice begins with the last
    words of the one before, which are then taken off again."""
    size = SLICE_BYTES if size is None else size
    texts = pc.fill_null(texts, "")
    long = pc.binary_length(texts).to_numpy(zero_copy_only=False) > size
    if not long.all():
        short = np.flatnonzero(~long)
        yield short, texts if not long.any() else texts.take(pa.array(short)), 1
    one = lambda part: pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(part)], dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(part)))
    for row in np.flatnonzero(long).tolist():
        data, _ = text_bytes(texts.slice(row, 1))
        held = 0
        for a, b in cuts(data, size, whole=True):
            yield np.array([row]), one(data[held:b]), 1
            if held < a:
                yield np.array([row]), one(data[held:a]), -1
            # From the start of the last word that ends ``reach`` bytes before the cut or earlier.
            word = b - reach
            while word > a and SPACE_BYTE[data[word - 1]]:
                word -= 1
            while word > a and not SPACE_BYTE[data[word - 1]]:
                word -= 1
            held = max(a, word)


def cuts(data: np.ndarray, size: int = SLICE_BYTES, stop: np.ndarray = SPACE_BYTE, *, whole: bool = False) -> Iterator[tuple[int, int]]:
    """Begin and end of the slices of a UTF-8 text, behind the last ``stop`` byte in each.
    Where a slice has none it ends at the last whole character or, with ``whole``, behind
    the next stop byte: it then is a single word longer than ``size``."""
    a = 0
    while a < len(data):
        b = min(len(data), a + size)
        if b < len(data):
            for reach in (4096, size):  # the last one is near the end, as a rule
                at = np.flatnonzero(stop[data[max(a, b - reach) : b]])
                if len(at):
                    b = max(a, b - reach) + int(at[-1]) + 1
                    break
            else:
                if whole:
                    while b < len(data) and not len(at := np.flatnonzero(stop[data[b : b + size]])):
                        b = min(len(data), b + size)
                    b = min(len(data), b + int(at[0]) + 1) if b < len(data) else b
                else:
                    while b > a + 1 and data[b] & 0xC0 == 0x80:
                        b -= 1
        yield a, b
        a = b


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``inside``; a run ends with its row."""
    n = len(inside)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(name)
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.full(max(n, PASS_BYTES + 1), base, dtype=np.uint64)
            known[0] = 1
            known = np.multiply.accumulate(known)
        if len(known) <= 4 * PASS_BYTES:
            _POWERS[name] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 well-spread bits (a fixed bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


#: A random-looking value for each byte, fixed.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, the same wherever the span stands. Texts can
    be made whose spans have equal hashes: where that may not be, compare the bytes."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * _powers("odd", _ODD, n), out=total[1:])
        value = (total[ends] - total[starts]) * _powers("inverse", _ODD_INVERSE, n + 1)[starts]
        return mixed(value + (ends - starts).astype(np.uint64))


def long_hash(data: np.ndarray) -> np.uint64:
    """``span_hashes`` of one span of any length, which is all of ``data``, part by part."""
    value, shift = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for a in range(0, len(data), PASS_BYTES):
            part = data[a : a + PASS_BYTES]
            powers = _powers("odd", _ODD, len(part))
            value = value + shift * (BYTE_VALUE[part] * powers).sum(dtype=np.uint64)
            shift = shift * powers[-1] * _ODD
        return mixed(np.array([value + np.uint64(len(data))]))[0]


def gram_buckets(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A bucket of ``bits`` bits for the ``order`` bytes from each place of ``data`` on; as
    many as there are such places. Orders up to 7."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    key = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        key = (key << np.uint64(8)) | data[k : k + n]
    with np.errstate(over="ignore"):
        key *= _ODD
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def gram_rows(offsets: np.ndarray, order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end place of every row's grams; none where the row is shorter."""
    first = np.minimum(offsets[:-1], max(n, 0))
    return first, np.maximum(first, np.minimum(offsets[1:] - order + 1, max(n, 0)))


def row_sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values[first:end]`` for every row, in float64 (values: n, or n by k)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[end] - total[first]


def remainder(column: str, modulus: int):
    """crc32 of the column as text, modulo ``modulus``; null for null."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % modulus).cast("int")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: dict | int, max_chars: int) -> list[tuple]:
    """(doc_id, label, text) of a bounded sample, in order: of each label value the
    ``per_class`` documents whose hashed doc_id is smallest, texts over ``max_chars`` left
    out. Labels first, so that only the sample's texts are moved."""
    known = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.withColumn("order", F.xxhash64("doc_id"))
    counts = known.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n")).collect()  # a row for each label
    most = lambda x: per_class if isinstance(per_class, int) else per_class.get(x, 0)
    # The smallest hashes are below a cut that leaves half as many again as are wanted.
    bounds = [(r["label"], most(r["label"]), min(1.0, (1.5 * most(r["label"]) + 50) / r["n"])) for r in counts if most(r["label"])]
    if not bounds:
        return []
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(bounds, T.StructType([known.schema["label"], T.StructField("most", T.IntegerType()), T.StructField("share", T.DoubleType())])))
    part = (F.col("order").cast("double") + 2.0**63) / 2.0**64
    known = known.where(part <= max(x for _, _, x in bounds)).groupBy("doc_id", "order").agg(F.max("label").alias("label"))
    place = F.row_number().over(W.partitionBy("label").orderBy("order", "doc_id"))
    chosen = known.join(wanted, "label").where(part <= F.col("share")).withColumn("place", place).where("place <= most")
    chosen = chosen.select("doc_id", "label").toArrow()  # bounded by the parameter
    if not chosen.num_rows:
        return []
    few = spark.createDataFrame(chosen)
    found = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(few), "doc_id")
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).toArrow().to_pylist()
    return sorted((r["doc_id"], r["label"], r["text"]) for r in rows)


def without_copies(sample: list[tuple], size: int = 16) -> list[tuple]:
    """The (label, text) pairs of a bounded sample without copies and near copies of an
    earlier one: at least half of a text's ``size`` smallest word-trigram hashes were seen."""
    seen: set[int] = set()
    kept = []
    for label, text in sample:
        words = words_hashed(text)
        grams = words if len(words) < 3 else mixed(mixed(mixed(words[:-2]) + words[1:-1]) + words[2:])
        sketch = np.unique(grams)[:size].tolist()
        if sketch and 2 * sum(x in seen for x in sketch) >= len(sketch):
            continue
        seen.update(sketch)
        kept.append((label, text))
    return kept


def words_hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = runs(~SPACE_BYTE[data], np.array([0, len(data)]))
    return span_hashes(data, starts, ends)
