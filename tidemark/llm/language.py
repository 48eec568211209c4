"""Language identification by hierarchical discrimination.

First the family of the language, then, inside the family, one-versus-one linear support
vector machines between its languages. Features are hashed byte n-grams and words, A-Z
lower-cased; the machines are trained in numpy by averaged stochastic subgradient steps on
a bounded sample. All machines fold into one table with a row for each, so scoring is one
pass over a text; texts over ``SLICE_BYTES`` are read in slices whose sums are those of the whole text.
The model grows with the number of languages, none of which is left out.

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with
score 1; a row with a null lang or doc_id is predicted and not learned from; with a single
learned language every text with a letter is that language; with none every text is
``und``; an empty table gives an empty result; other columns are kept, except
``lang_pred`` and ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import LOWER_BYTE, gram_buckets, gram_rows, labelled_texts, map_batches, passes, row_sums, runs, seamed, span_hashes, text_bytes

BITS, ORDERS, EPOCHS, PENALTY = 16, (3,), 20, 1e-4

#: Documents of each language, and characters of one, that training may use.
PER_LANGUAGE, MAX_CHARS = 600, 40_000

UNKNOWN = "und"

# Language codes by family. A language that is not listed is its own family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "lb", "fy", "fo"],
    "romance": ["es", "fr", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "gd", "cy", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "pa", "gu"],
    "semitic": ["ar", "he", "am", "mt"],
}

FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_WORD = _LETTER.copy()
_WORD[0x80:] = True


def family(language: str) -> str:
    return FAMILY_OF.get(language, language)


def features(texts: pa.Array, bits: int = BITS, orders: tuple[int, ...] = ORDERS):
    """Yields (buckets, first, end): the buckets of one kind of feature and each row's part."""
    data, offsets = text_bytes(texts)
    data = LOWER_BYTE[data]
    for order in orders:
        buckets = gram_buckets(data, order, bits)
        yield (buckets, *gram_rows(offsets, order, len(buckets)))
    starts, ends = runs(_WORD[data], offsets)
    at = np.searchsorted(starts, offsets)
    yield (span_hashes(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int64), at[:-1], at[1:]


def has_letter(texts: pa.Array) -> np.ndarray:
    found = np.zeros(len(texts), dtype=bool)
    for row, part, _ in seamed(texts, 0):
        data, offsets = text_bytes(part)
        here = row_sums(_LETTER[data].astype(np.float32), offsets[:-1], offsets[1:]) > 0
        for i in np.flatnonzero(~here & ~found[row] & (np.diff(offsets) > 0)).tolist():
            here[i] = any(c.isalpha() for c in part[i].as_py())
        found[row] |= here
    return found


@dataclass
class Model:
    """Languages, families, and the linear machines as rows of ``table`` plus ``bias``:
    one for each family against the others, then one for each pair of languages of a
    family (positive: the first)."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    table: np.ndarray
    bias: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        letters = has_letter(texts)
        n = len(texts)
        if not self.languages:
            return [UNKNOWN] * n, np.ones(n)
        bits = self.table.shape[1].bit_length() - 1
        total, count = np.zeros((n, len(self.table))), np.zeros(n)
        for row, part, sign in seamed(texts, max(ORDERS)):
            for buckets, first, end in features(part, bits):
                for column, weights in enumerate(self.table):
                    total[row, column] += sign * row_sums(weights[buckets], first, end)
                count[row] += sign * (end - first)
        margin = total / np.maximum(count, 1)[:, None] + self.bias
        sure = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
        k = len(self.families)
        by_family = sure[:, :k] / np.maximum(sure[:, :k].sum(axis=1, keepdims=True), 1e-12)
        best = margin[:, :k].argmax(axis=1)
        votes, strength = np.zeros((n, len(self.languages))), np.ones((n, len(self.languages)))
        for column, (a, b) in enumerate(self.pairs, start=k):
            p = sure[:, column]
            votes[:, a] += (p >= 0.5) + 1e-3 * p
            votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
            strength[:, a] = np.minimum(strength[:, a], p)
            strength[:, b] = np.minimum(strength[:, b], 1 - p)
        family_of = np.array([self.families.index(family(x)) for x in self.languages])
        votes[family_of[None, :] != best[:, None]] = -1
        chosen = votes.argmax(axis=1)
        score = by_family[np.arange(n), best] * strength[np.arange(n), chosen]
        return [self.languages[c] if ok else UNKNOWN for c, ok in zip(chosen.tolist(), letters.tolist())], np.where(letters, score, 1.0)


def machine(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, bits: int, epochs: int, penalty: float, seed: int) -> tuple[np.ndarray, float]:
    """A linear support vector machine: hinge loss, averaged subgradient steps. ``rows`` are
    buckets and shares; the classes count alike however many rows each has."""
    rng = np.random.default_rng(seed)
    weight, late = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = late_bias = 0.0
    scale = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, share = rows[k]
            step += 1
            now = 20.0 / (1 + 20.0 * penalty * step)
            if sign[k] * (share @ weight[buckets] + bias) < 1:
                weight[buckets] += now * scale[k] * sign[k] * share
                late[buckets] += step * now * scale[k] * sign[k] * share
                bias += 0.01 * now * scale[k] * sign[k]
                late_bias += step * 0.01 * now * scale[k] * sign[k]
    return weight - late / max(1, step), bias - late_bias / max(1, step)


def train(sample: list[tuple[str, str]], *, bits: int = BITS, epochs: int = EPOCHS, penalty: float = PENALTY) -> Model:
    """A model from (language, text) pairs."""
    languages = sorted({x for x, _ in sample})
    families = sorted({family(x) for x in languages})
    tongue = np.array([languages.index(x) for x, _ in sample], dtype=np.int64)
    kin = np.array([families.index(family(x)) for x, _ in sample], dtype=np.int64)
    rows = []
    for _, text in sample:
        found = np.concatenate([b[a:e] for b, (a,), (e,) in features(pa.array([text]), bits)])
        buckets, count = np.unique(found, return_counts=True)
        rows.append((buckets, count / max(1, len(found))))
    columns, pairs = [], []
    for k in range(len(families)):
        columns.append(machine(rows, np.where(kin == k, 1, -1), bits, epochs, penalty, k) if len(families) > 1 else (np.zeros(1 << bits), 0.0))
    for a, b in combinations(range(len(languages)), 2):
        if family(languages[a]) == family(languages[b]):
            own = np.flatnonzero((tongue == a) | (tongue == b))
            columns.append(machine([rows[i] for i in own], np.where(tongue[own] == a, 1, -1), bits, epochs, penalty, len(columns)))
            pairs.append((a, b))
    table = np.stack([w for w, _ in columns]).astype(np.float32) if columns else np.zeros((0, 1 << bits), dtype=np.float32)
    return Model(languages, families, pairs, table, np.array([b for _, b in columns]))


def fit(docs: DataFrame, learn: Column, *, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model:
    """A model from the rows with a lang that satisfy ``learn``."""
    usable = docs.where(learn & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    sample = labelled_texts(docs, usable, "lang", per_language, max_chars)
    return train([(x, t) for _, x, t in sample])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        for part in passes(batches):
            language, score = sent.value.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(language, pa.string()), pa.array(score)], names=schema.names)

    return map_batches(docs, scan, schema)
