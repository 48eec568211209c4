"""Quality classifier: supervised subword embeddings.

Words, byte n-grams and repeats of the word before are hashed to buckets; every bucket has
a learned vector; a document is the average of its vectors, and a softmax layer tells its
class. Vectors and layer are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled documents. For scoring, vectors and layer fold into a number
for each bucket, so a task reads a small table, however many documents it has. Texts over
``SLICE_BYTES`` are read in slices whose sums are those of the whole text.

Defined cases: a null or empty text has no feature and gets the score of the layer's bias;
documents without label, or with a null doc_id, are scored and not learned from; of several
labels for a doc_id the largest counts; without any learnable label every score is 1/2; an
empty table gives an empty result; other columns are kept, except ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_BYTE, gram_buckets, gram_rows, labelled_texts, map_batches, passes, row_sums, runs, seamed, span_hashes, text_bytes, without_copies

BITS, ORDERS, DIM, EPOCHS, RATE = 18, (3, 5), 8, 12, 8.0

#: Documents of each label value, and characters of one, that training may use.
PER_CLASS, MAX_CHARS = {0: 1500, 1: 2500}, 40_000

THRESHOLD = 0.3

_REPEAT, _FRESH = 0, 1


def features(texts: pa.Array, bits: int = BITS, orders: tuple[int, ...] = ORDERS):
    """Yields (buckets, first, end): the buckets of one kind of feature and each row's part."""
    data, offsets = text_bytes(texts)
    for order in orders:
        buckets = gram_buckets(data, order, bits)
        yield (buckets, *gram_rows(offsets, order, len(buckets)))
    starts, ends = runs(~SPACE_BYTE[data], offsets)
    words = span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    yield (words >> np.uint64(64 - bits)).astype(np.int64), at[:-1], at[1:]
    again = np.full(len(words), _FRESH, dtype=np.int64)
    if len(words):
        again[1:][words[1:] == words[:-1]] = _REPEAT
        again[at[:-1][at[:-1] < len(words)]] = _FRESH
    yield again, at[:-1], at[1:]


@dataclass
class Model:
    """``table``: what each bucket adds to the log odds; ``bias``: the log odds of no text."""

    table: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        bits = len(self.table).bit_length() - 1
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for row, part, sign in seamed(texts, max(ORDERS)):
            for buckets, first, end in features(part, bits):
                total[row] += sign * row_sums(self.table[buckets], first, end)
                count[row] += sign * (end - first)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def _rows(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every text its buckets and their shares."""
    out = []
    for text in texts:
        found = np.concatenate([b[a:e] for b, (a,), (e,) in features(pa.array([text]), bits)])
        buckets, count = np.unique(found, return_counts=True)
        out.append((buckets, (count / max(1, len(found))).astype(np.float32)))
    return out


def train(sample: list[tuple[int, str]], *, prior: float | None = None, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """A model from (label, text) pairs. ``prior``: the share of label 1 among all labelled
    documents, where the sample was drawn by class."""
    labels = np.array([y for y, _ in sample], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << bits, dtype=np.float32), 0.0)
    rows = _rows([t for _, t in sample], bits)
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << bits, dim), dtype=np.float32)) - 0.5) / dim
    layer = ((rng.random((dim, 2)) - 0.5)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, share = rows[k]
            now = rate * (1 - step / steps)
            step += 1
            own = vectors[buckets]
            mean = share @ own
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = layer @ p
            layer -= 0.02 * now * np.outer(mean, p)
            bias -= 0.002 * now * p
            vectors[buckets] = own - now * share[:, None] * back
    turn = layer[:, 1] - layer[:, 0]
    shift = 0.0
    if prior is not None:
        drawn = labels.mean()
        shift = np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))
    return Model((vectors @ turn).astype(np.float32), float(bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, per_class: dict = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """A model from the labels whose row satisfies ``learn``."""
    usable = labels.where(learn)
    sample = labelled_texts(docs, usable, "quality", per_class, max_chars)
    share = usable.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return train(without_copies([(y, t) for _, y, t in sample]), prior=None if share is None else float(np.clip(share, 0.01, 0.99)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    docs = docs.drop("score")
    schema = docs.withColumn("score", F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for part in passes(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sent.value.scores(part.column("text")))], names=schema.names)

    return map_batches(docs, scan, schema)
