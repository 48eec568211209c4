"""Toxicity by compression distance.

zstandard's trainer makes separate dictionaries from toxic and from ordinary text. A text is
cut into short windows at white space, every window is compressed with both, and the bytes
that the toxic dictionary saves are the distance. A toxic document is mostly ordinary prose,
so the dictionaries are trained in rounds: the first round takes windows of all of a class's
text, the following ones only the windows on which the toxic dictionary of the *other* half
of the documents saved most - in toxic documents to learn from, in ordinary ones as counter
examples. Both are laid before one large dictionary of ordinary text, so that ordinary
windows compress alike with either. A logistic layer over the counts of windows that save at
least 1, 2, ... bytes is calibrated on documents that had no part in the dictionaries they
were compressed with, and set so that 0.7 is the threshold that served best there.

Texts over ``SLICE_BYTES`` are windowed slice by slice; slices end where a window does, so
the windows are those of the whole text.

Defined cases: a null or empty text has no window and gets the score of no savings;
documents without label, or with a null doc_id, are scored and not learned from; of several
labels for a doc_id the largest counts; without labels of both kinds every score is 0; with
too little text for zstandard's trainer the text itself is the dictionary; equal texts have
equal scores; an empty table gives an empty result; other columns are kept, except
``score``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_BYTE, SLICE_BYTES, SPACE_BYTE, labelled_texts, map_batches, passes, text_bytes, without_copies

#: Bytes of a window that is scored and of one that is learned from; compression level.
WINDOW, LEARNED, LEVEL = 128, 64, 9

#: Bytes of the two separate dictionaries and of the ordinary one behind both.
OWN, BASE = 8192, 1 << 20

#: The trainer's segment and substring size.
SEGMENT, SUBSTRING = 32, 8

#: Share of the windows that each round after the first learns from; windows of ordinary
#: text for each toxic one, half of them for the base; folds of the calibration.
ROUNDS, ORDINARY, FOLDS = (0.2, 0.08), 4, 2

#: Documents of each label value, and characters of one, that training may use.
PER_CLASS, MAX_CHARS = {0: 5000, 1: 3000}, 40_000

THRESHOLD = 0.7

#: Savings are told apart from -1 (and less) to 12 (and more) bytes.
_LOW, _HIGH = -1, 12


def slices(texts: pa.Array, size: int | None = None, window: int = WINDOW) -> Iterator[tuple[np.ndarray, pa.Array, int, bool]]:
    """(row of every part, parts, phase, whether it ends its text): all rows up to ``size``
    bytes at once, longer ones in slices. Slices part where a window begins: at the first
    white space from a multiple of ``window`` on, the text having a space before it."""
    size = SLICE_BYTES if size is None else size
    texts = pc.fill_null(texts, "")
    long = pc.binary_length(texts).to_numpy(zero_copy_only=False) > size
    if not long.all():
        short = np.flatnonzero(~long)
        yield short, texts if not long.any() else texts.take(pa.array(short)), 0, True
    for row in np.flatnonzero(long).tolist():
        data, _ = text_bytes(texts.slice(row, 1))
        a = 0
        while a < len(data):
            b, at = len(data) + 1, (a + max(size, window)) // window * window - 1
            while a <= at < len(data):
                space = np.flatnonzero(SPACE_BYTE[data[at : at + size]])
                if len(space):
                    b = at + int(space[0]) + 1
                    break
                at += size
            if len(data) - b < 2 * window:  # a short rest belongs to the window before it
                b = len(data) + 1
            part = np.ascontiguousarray(data[a : b - 1])
            yield np.array([row]), pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(part)], dtype=np.int64)), pa.py_buffer(part)), a % window, b > len(data)
            a = b


def windows(texts: pa.Array, size: int = WINDOW, phase: int = 0, final: bool = True) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, spans, row): lower-cased texts with a space before and behind each, and the
    windows (place, length) of about ``size`` bytes that begin and end with a space. A slice
    of a text begins ``phase`` bytes behind a multiple of ``size`` and may not be ``final``."""
    data, offsets = text_bytes(texts)
    n, rows = len(data), len(texts)
    joined = np.full(n + rows + 1, 0x20, dtype=np.uint8)
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    plain = LOWER_BYTE[data]
    plain[SPACE_BYTE[plain]] = 0x20
    joined[np.arange(n) + row_of + 1] = plain
    first = offsets + np.arange(rows + 1)
    spaces = np.flatnonzero(joined == 0x20)
    count = -(-(np.diff(first) - 1 + phase) // size)
    row = np.repeat(np.arange(rows), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = spaces[np.searchsorted(spaces, first[row] + np.maximum(0, within * size - phase))] if len(row) else np.zeros(0, dtype=np.int64)
    keep = start < first[row + 1]
    keep[1:] &= (start[1:] != start[:-1]) | (row[1:] != row[:-1])
    start, row = start[keep], row[keep]
    if len(start) and final:  # a short rest belongs to the window before it
        short = np.append(row[1:] != row[:-1], True) & (first[row + 1] - start < size // 2)
        short[0] = False
        short[1:] &= row[1:] == row[:-1]
        start, row = start[~short], row[~short]
    end = np.empty_like(start)
    if len(start):
        end[:-1] = start[1:]
        last = np.append(row[1:] != row[:-1], True)
        end[last] = first[row[last] + 1]
    return joined.tobytes(), np.stack([start, end + 1 - start], axis=1).astype("<u8"), row


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes by zstandard's trainer."""
    try:
        return zs.train_dictionary(size, samples, k=SEGMENT, d=SUBSTRING, f=20, accel=1, split_point=1.0).as_bytes()
    except (zs.ZstdError, ValueError):  # too few samples, or too short ones
        return b"".join(samples)[:size]


@dataclass
class Pair:
    """The separate dictionaries, and the one of ordinary text that is laid behind both."""

    toxic: bytes
    ordinary: bytes
    base: bytes

    def compressors(self, size: int = WINDOW) -> list[zs.ZstdCompressor]:
        """The toxic and the ordinary compressor, for windows of about ``size`` bytes. Two
        dictionaries end to end have no common header, so they are loaded as content."""
        found = []
        for content in (self.toxic + self.base, self.ordinary + self.base):
            how = zs.ZstdCompressionParameters.from_level(LEVEL, source_size=size, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
            held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=how)
            found.append(zs.ZstdCompressor(dict_data=held, compression_params=how))
        return found

    def savings(self, texts: pa.Array, compressors: list[zs.ZstdCompressor], phase: int = 0, final: bool = True) -> np.ndarray:
        """For every text, how many windows the toxic dictionary saves so many bytes of."""
        kinds = _HIGH - _LOW + 1
        body, spans, row = windows(texts, WINDOW, phase, final)
        saved = np.clip(saved_bytes(compressors, body, spans), _LOW, _HIGH) - _LOW
        return np.bincount(row * kinds + saved, minlength=len(texts) * kinds).reshape(len(texts), kinds).astype(float)


def saved_bytes(compressors: list[zs.ZstdCompressor], body: bytes, spans: np.ndarray) -> np.ndarray:
    """Bytes that the first compressor saves against the second, for every window."""
    if not len(spans):
        return np.zeros(0, dtype=np.int64)
    held = zs.BufferWithSegments(body, np.ascontiguousarray(spans).tobytes())
    toxic, ordinary = (np.fromiter(map(len, c.multi_compress_to_buffer(held, threads=1)), dtype=np.int64, count=len(spans)) for c in compressors)
    return ordinary - toxic


@dataclass
class Windows:
    """Windows to learn from; ``half`` parts them by document."""

    body: bytes
    spans: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Windows:
        body, spans, row = windows(pa.array(texts, pa.string()), LEARNED)
        return Windows(body, spans, row % 2)

    def samples(self, which: np.ndarray) -> list[bytes]:
        return [self.body[a : a + size] for a, size in self.spans[which].astype(int).tolist()]

    def most_saving(self, pairs: list[list[zs.ZstdCompressor]], among: np.ndarray, share: float) -> np.ndarray:
        """The ``share`` of the windows ``among`` all that save most (and at least a byte)
        with the compressors from the other half of the documents."""
        saved = np.empty(len(among))
        for half, compressors in enumerate(pairs):
            other = self.half[among] != half
            saved[other] = saved_bytes(compressors, self.body, self.spans[among[other]])
        return among[saved >= max(1.0, np.quantile(saved, 1 - share))] if len(among) else among


def dictionaries(toxic: list[str], ordinary: list[str], *, rounds: tuple = ROUNDS, seed: int = 3) -> Pair:
    """The dictionaries from toxic and ordinary texts."""
    bad, good = Windows.of(toxic), Windows.of(ordinary)
    order = np.random.default_rng(seed).permutation(len(good.spans))[: max(1, ORDINARY * len(bad.spans))]
    pool = np.sort(order[len(order) // 2 :])
    base = trained(good.samples(order[: len(order) // 2]), BASE)
    from_bad, from_good = np.arange(len(bad.spans)), pool
    for share in rounds:
        pairs = []
        for half in (0, 1):
            own = Pair(trained(bad.samples(from_bad[bad.half[from_bad] == half]), OWN), trained(good.samples(from_good[good.half[from_good] == half]), OWN), base)
            pairs.append(own.compressors(LEARNED))
        from_bad, from_good = bad.most_saving(pairs, np.arange(len(bad.spans)), share), good.most_saving(pairs, pool, share)
    return Pair(trained(bad.samples(from_bad), OWN), trained(good.samples(from_good), OWN), base)


def _layer_input(savings: np.ndarray) -> np.ndarray:
    n = savings.sum(axis=1, keepdims=True)
    tail = savings[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1 - _LOW :]
    return np.hstack([np.log1p(n), tail / np.sqrt(np.maximum(n, 1)), np.log1p(tail)])


@dataclass
class Model:
    pair: Pair
    centre: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array, compressors: list[zs.ZstdCompressor]) -> np.ndarray:
        counts = np.zeros((len(texts), _HIGH - _LOW + 1))
        for row, part, phase, final in slices(texts):
            np.add.at(counts, row, self.pair.savings(part, compressors, phase, final))
        x = _layer_input(counts) - self.centre
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray, float]:
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - centre) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return centre, w[:-1] / spread, float(w[-1])


def train(sample: list[tuple[int, str]], *, folds: int = FOLDS, threshold: float = THRESHOLD) -> Model:
    """A model from (label, text) pairs in a fixed order."""
    y = np.array([label for label, _ in sample], dtype=float)
    kinds = 2 * _HIGH + 1
    if not 0 < y.sum() < len(y):
        return Model(Pair(b"", b"", b""), np.zeros(kinds), np.zeros(kinds), -30.0)
    # Deal each label value over the folds in turn.
    fold = np.empty(len(y), dtype=int)
    for value in (0, 1):
        own = np.flatnonzero(y == value)
        fold[own] = np.arange(len(own)) % folds
    texts = np.array([t for _, t in sample], dtype=object)
    savings = np.zeros((len(y), _HIGH - _LOW + 1))
    for k in range(folds):
        inside, outside = fold != k, fold == k
        if outside.any():
            pair = dictionaries(list(texts[inside & (y == 1)]), list(texts[inside & (y == 0)]))
            savings[outside] = pair.savings(pa.array(texts[outside], pa.string()), pair.compressors())
    x = _layer_input(savings)
    centre, weight, bias = _logistic(x, y)
    logit = (x - centre) @ weight + bias
    # The threshold with the best balance (F1) on documents new to the dictionaries.
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    best = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + y.sum())))
    cut = (logit[order[best]] + logit[order[min(best + 1, len(y) - 1)]]) / 2
    pair = dictionaries(list(texts[y == 1]), list(texts[y == 0]))
    return Model(pair, centre, weight, bias - cut + math.log(threshold / (1 - threshold)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, per_class: dict = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """A model from the labels whose row satisfies ``learn``."""
    sample = labelled_texts(docs, labels.where(learn), "toxic", per_class, max_chars)
    return train(without_copies([(y, t) for _, y, t in sample]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, higher where label 1 is likelier; 0.7 is the threshold."""
    docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the dictionaries: about a megabyte

    def scan(batches):
        model = sent.value
        compressors = model.pair.compressors()
        for part in passes(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(part.column("text"), compressors))], names=schema.names)

    return map_batches(docs, scan, schema)
