"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles, hashes.

Images are decoded row by row inside tasks; a resize reads an integral image only at the
rows and columns that it needs, in strips, so a large image costs no more than a strip of
it. Tiles are stored as NPY bytes beside a 64-bit difference hash.

Defined cases: a null image, bytes that are no image of these kinds, and an image whose
header claims more samples than there are bytes, or whose samples exceed its own maximum,
have null results; a
null text is stored like an empty one; equal bytes have equal results; an empty table gives
an empty result; other columns are kept, except those that have the name of a result column,
which the result replaces.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, passes

#: Samples in a row of a stored text, and the side of a tile.
WIDTH, TILE = 64, 16

_STRIP = 1 << 22


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit samples (rows by columns) as a raw portable graymap."""
    rows, columns = samples.shape
    return b"P5\n%d %d\n255\n" % (columns, rows) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit gray (rows by columns) or RGB (rows by columns by 3) samples as BMP."""
    rows, columns = samples.shape[:2]
    gray = samples.ndim == 2
    line = (columns * (1 if gray else 3) + 3) // 4 * 4
    palette = b"".join(bytes([k, k, k, 0]) for k in range(256)) if gray else b""
    at = 54 + len(palette)
    out = np.zeros((rows, line), dtype=np.uint8)
    flat = samples if gray else samples[:, :, ::-1].reshape(rows, -1)
    out[:, : flat.shape[1]] = flat[::-1]
    head = b"BM" + struct.pack("<IHHI", at + out.size, 0, 0, at)
    return head + struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, 8 if gray else 24, 0, out.size, 0, 0, 256 if gray else 0, 0) + palette + out.tobytes()


_SPACE_OR_NOTE = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])+")


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` numbers behind the two-letter mark, and where the samples begin."""
    at, found = 2, []
    while len(found) < count:
        if gap := _SPACE_OR_NOTE.match(data, at):
            at = gap.end()
        digits = re.compile(rb"\d+").match(data, at)
        if not digits:
            raise ValueError("a number is missing in the header")
        found.append(int(digits[0]))
        at = digits.end()
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as samples: rows by columns, by 3 for colour; bitmaps have 1 for black."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap, colour = kind in (b"P1", b"P4"), kind in (b"P3", b"P6")
    numbers, at = _header(data, 2 if bitmap else 3)
    columns, rows = numbers[:2]
    most = 1 if bitmap else numbers[2]
    depth = 3 if colour else 1
    # A sample takes a bit at least, so a size that the bytes cannot hold stops here.
    if not 0 < most < 65_536 or not rows or not columns or rows * columns * depth > 8 * len(data):
        raise ValueError("bad header")
    shape = (rows, columns, 3) if colour else (rows, columns)
    if kind == b"P4":
        line = -(-columns // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, rows * line, at).reshape(rows, line), axis=1)
        return bits[:, :columns]
    if kind in (b"P5", b"P6"):
        sample = np.dtype("u1") if most < 256 else np.dtype(">u2")
        return _checked(np.frombuffer(data, sample, rows * columns * depth, at).reshape(shape).astype(sample.newbyteorder("=")), most)
    body = re.sub(rb"#[^\n\r]*", b" ", data[at - 1 :])
    values = re.findall(rb"[01]", body) if kind == b"P1" else body.split()
    if len(values) < rows * columns * depth:
        raise ValueError("samples are missing")
    if any(len(v) > 9 for v in values[: rows * columns * depth]):
        raise ValueError("a sample is out of range")
    return _checked(np.array(values[: rows * columns * depth], dtype=np.int64).reshape(shape), most).astype(np.uint8 if most < 256 else np.uint16)


def _checked(image: np.ndarray, most: int) -> np.ndarray:
    if image.min() < 0 or image.max() > most:
        raise ValueError("a sample is out of range")
    return image


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits: gray palettes as rows by columns, else RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    at, size, columns, rows, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    used = struct.unpack_from("<I", data, 46)[0]
    if packed or bits not in (1, 4, 8, 24, 32) or columns <= 0 or not rows or columns * abs(rows) * bits > 8 * len(data):
        raise ValueError("BMP kind not supported")
    line = (columns * bits + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, abs(rows) * line, at).reshape(abs(rows), line)
    body = body[::-1] if rows > 0 else body
    if bits >= 24:
        return body[:, : columns * bits // 8].reshape(abs(rows), columns, bits // 8)[:, :, 2::-1].copy()
    palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = body
    else:
        shifts = np.arange(8 - bits, -1, -bits)
        index = ((body[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(abs(rows), -1)
    image = palette[index[:, :columns]]
    gray = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return image[:, :, 0] if gray else image


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def integral_rows(image: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The integral image at the ``wanted`` rows (0 to all): sums of what is above and left."""
    rows, columns = image.shape[:2]
    out = np.zeros((len(wanted), columns + 1, *image.shape[2:]))
    above = np.zeros(image.shape[1:])
    step = max(1, _STRIP // max(1, columns))
    for a in range(0, rows, step):
        sums = above + np.cumsum(image[a : a + step], axis=0, dtype=np.float64)
        inside = (wanted > a) & (wanted <= a + len(sums))
        out[inside, 1:] = sums[wanted[inside] - a - 1]
        above = sums[-1]
    return np.cumsum(out, axis=1)


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The mean of the area of ``image`` under each of ``rows`` by ``columns`` equal cells."""
    h, w = image.shape[:2]
    y, x = np.arange(rows + 1) * h / rows, np.arange(columns + 1) * w / columns
    y0, x0 = np.minimum(y.astype(np.int64), h - 1), np.minimum(x.astype(np.int64), w - 1)
    wanted = np.unique(np.concatenate([y0, y0 + 1]))
    table = integral_rows(image, wanted)
    shape = (-1, *([1] * (image.ndim - 1)))
    top, low = table[np.searchsorted(wanted, y0)], table[np.searchsorted(wanted, y0 + 1)]
    lines = top + (low - top) * (y - y0).reshape(shape)
    left, right = lines[:, x0], lines[:, x0 + 1]
    corners = left + (right - left) * (x - x0).reshape((1, -1, *([1] * (image.ndim - 2))))
    areas = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return areas * (rows * columns / (h * w))


def gray(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: whether each of 8 by 9 cells is darker than the next in its row."""
    cells = np.round(area_resize(gray(image), 8, 9), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.save(held, image, allow_pickle=False)
    return held.getvalue()


def tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image area-resized to a square, 8 or 16 bits as it was, as NPY bytes."""
    return npy(np.rint(area_resize(image, side, side)).astype(image.dtype))


_TILES = [T.StructField("rows", T.IntegerType()), T.StructField("columns", T.IntegerType()), T.StructField("npy", T.BinaryType()), T.StructField("dhash", T.StringType())]


def media_tiles(df: DataFrame, column: str = "image", *, side: int = TILE) -> DataFrame:
    """``df`` with ``rows`` and ``columns`` of the image in the binary ``column``, its tile as
    ``npy`` and its difference hash ``dhash``."""
    df = df.drop(*(f.name for f in _TILES))
    schema = T.StructType([*df.schema.fields, *_TILES])

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(data)
        except (ValueError, TypeError, struct.error, IndexError, OverflowError, MemoryError):
            return None, None, None, None
        return image.shape[0], image.shape[1], tile(image, side), difference_hash(image)

    def scan(batches):
        for part in passes(batches, column):
            rows, columns, tiles, hashes = zip(*map(one, part.column(column).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(tiles, pa.binary()), pa.array(hashes, pa.string())], names=schema.names)

    return map_batches(df, scan, schema)


def payload(text: bytes) -> np.ndarray:
    """The bytes, padded with 0 up to a positive multiple of the row width, in rows."""
    rows = max(1, -(-len(text) // WIDTH))
    return np.frombuffer(text.ljust(rows * WIDTH, b"\0"), dtype=np.uint8).reshape(rows, WIDTH)


def text_media(docs: DataFrame, *, keep: bool = True) -> DataFrame:
    """Every text stored as a graymap and read back: (doc_id, media, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tile_sha256), the
    features from the bytes read back; ``keep=False`` leaves the stored ``media`` out."""
    rows = docs.select("doc_id", "text")
    schema = T.StructType([
        rows.schema["doc_id"],
        *([T.StructField("media", T.BinaryType())] if keep else []),
        T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()), T.StructField("tile_sha256", T.StringType()),
    ])
    kinds = [pa.binary()] * keep + [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def one(text: bytes) -> tuple:
        stored = encode_pgm(payload(text))
        image = decode(stored)
        back = image.tobytes()
        facts = (
            len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(stored),
            hashlib.sha256(stored).hexdigest(), difference_hash(image), hashlib.sha256(tile(image)).hexdigest(),
        )
        return (stored, *facts) if keep else facts

    def scan(batches):
        for part in passes(batches):
            found = zip(*(one((x or "").encode()) for x in part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(found, kinds))], names=schema.names)

    return map_batches(rows, scan, schema)
