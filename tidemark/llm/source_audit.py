"""How far the sources of a language diverge, term by term: a heavy-light split.

The tasks count terms by (language, source) and add up before anything is shuffled; a term's
counts meet as a posting list, one entry for each source that has it. Shares are whole numbers
of parts in a thousand million, and every division is a whole-number division, so all sums are
exact in any order.

A pair's value is a sum over all kept terms, most of which most sources lack. Sources of a
language are dealt into blocks of ``TILE`` and terms into chunks of about ``CHUNK``; a task
works on one chunk of one pair of blocks. Heavy terms, in more than ``LIGHT`` sources, are
rows of a dense numpy tile of shares, and the tile adds up their values for all pairs at once.
A light term is in few sources, and for all others its share is the one of a count of 0: so
what all pairs have in common is one product, what a source's own count changes against every
source without the term depends on that count alone and is folded by it, and only pairs that
both have the term are corrected by the pairs of its short posting list. Dense and sparse
partial sums are added.

Defined cases: null text, language and source are empty strings; documents are rows, so equal
rows count each; a language without a kept term gives its pairs the value 0; a language with
one source has no pair; texts of any length are read in slices; an empty table gives an empty
result; columns other than ``text``, ``lang`` and ``source`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER_BYTE, SLICE_BYTES, cuts, map_batches, passes, runs, text_bytes, written

MIN_DOCS, TOP_TERMS = 3, 200

#: Parts that shares are counted in.
SCALE = 1_000_000_000

#: Sources of a block, terms of a chunk (about), and sources of a light term at most.
TILE, CHUNK, LIGHT = 128, 2048, 6

#: Text that a task counts at once, in bytes, about.
HELD_BYTES = 16 << 20

_TERM_BYTE = np.zeros(256, dtype=bool)
_TERM_BYTE[0x41:0x5B] = _TERM_BYTE[0x61:0x7B] = _TERM_BYTE[0x80:] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number, terms): the terms of some rows in order, as numbers of different terms."""
    inside = _TERM_BYTE[data]
    starts, ends = runs(inside, offsets)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(LOWER_BYTE[data[inside]]))
    coded = words.dictionary_encode()
    return np.searchsorted(offsets, starts, side="right") - 1, coded.indices.to_numpy(), coded.dictionary


def _counted(row: np.ndarray, number: np.ndarray, terms: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, term, occurrences, rows) for every occurring pair of a row's group and a term."""
    own, times = np.unique(row * terms + number, return_counts=True)
    pair, which = np.unique(group[own // max(1, terms)] * terms + own % max(1, terms), return_inverse=True)
    n = np.bincount(which, weights=times, minlength=len(pair)).astype(np.int64)
    return pair // max(1, terms), pair % max(1, terms), n, np.bincount(which, minlength=len(pair))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``HELD_BYTES`` of text, about; a very long row is one of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in passes(batches, size=HELD_BYTES):
        own = part.column("text").nbytes
        if held and size + own > HELD_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        if part.num_rows == 1 and own > SLICE_BYTES:
            yield part
        else:
            held, size = [*held, part], size + own
    if held:
        yield pa.concat_batches(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up in the tasks."""
    names = ["lang", "source", "term", "n", "docs"]

    def scan(batches):
        for part in _gathered(batches):
            data, offsets = text_bytes(part.column("text"))
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            long = part.num_rows == 1 and len(data) > SLICE_BYTES
            seen = pa.array([], pa.large_string())
            for a, b in cuts(data, SLICE_BYTES, ~_TERM_BYTE, whole=True) if long else [(0, len(data))]:
                row, number, terms = _terms(data[a:b], np.array([0, b - a]) if long else offsets)
                g, t, n, rows = _counted(row.astype(np.int64), number, len(terms), group)
                if long:  # its documents are counted behind its last slice
                    seen, rows = pc.unique(pa.concat_arrays([seen, terms])), 0 * rows
                where = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary)))]
                yield pa.RecordBatch.from_arrays([*where, terms.take(pa.array(t)).cast(pa.string()), pa.array(n), pa.array(rows)], names=names)
            if long:
                once = [pa.array([part.column(c)[0].as_py()] * len(seen), pa.string()) for c in ("lang", "source")]
                yield pa.RecordBatch.from_arrays([*once, seen.cast(pa.string()), pa.array(np.zeros(len(seen), dtype=np.int64)), pa.array(np.ones(len(seen), dtype=np.int64))], names=names)

    known = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return map_batches(known, scan, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, n, posts): the terms in at least ``min_docs`` documents of the language,
    with the sources that have them."""
    summed = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    posts = F.collect_list(F.struct("source", "n")).alias("posts")  # an entry for each source
    return summed.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), posts).where(F.col("docs") >= min_docs).drop("docs")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); 1 without terms."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(SCALE)
    return F.when(terms > 0, 1 + F.call_function("div", wide, (total + terms).cast("decimal(20,0)"))).otherwise(F.lit(1)).cast("bigint")


def groups_of(docs: DataFrame, kept: DataFrame, tile: int, chunk: int) -> DataFrame:
    """A row for every (lang, source): its number ``g`` and block, and what shares need."""
    entries = kept.select("lang", F.explode("posts").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    every = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    full = every.join(entries, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0)
    lang = W.partitionBy("lang")
    full = full.withColumns({"g": F.row_number().over(lang.orderBy("source")) - 1, "sources": F.count("*").over(lang)})
    return full.withColumns(
        {
            "block": F.floor(F.col("g") / tile).cast("int"),
            "blocks": F.ceil(F.col("sources") / tile).cast("int"),
            "chunks": F.greatest(F.lit(1), F.ceil(F.col("terms") / chunk)).cast("int"),
            "base": share(F.lit(0), F.col("total"), F.col("terms")),
        }
    )


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tile_sums(block: np.ndarray, base: np.ndarray, terms: int, term: np.ndarray, at: np.ndarray, p: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Sums for all pairs of a tile's sources over a chunk of terms. Sources have a ``block``
    and a ``base`` share of terms that they lack; ``terms`` are those that are counted here
    as if all lacked them. Entries (``term``, source ``at``, share ``p``), ``heavy`` or not,
    replace that by what the term is worth."""
    size = len(base)
    common = _gap(base[:, None], base[None, :])
    out = common * terms
    sides = [(np.arange(size), np.arange(size))]
    if block[0] != block[-1]:
        first, second = np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])
        sides = [(first, second), (second, first)]
    # Dense: a row of shares for every heavy term.
    names, row = np.unique(term[heavy], return_inverse=True)
    out -= common * len(names)
    shares = np.tile(base, (len(names), 1))
    shares[row, at[heavy]] = p[heavy]
    for a, b in sides:
        step = max(1, (1 << 20) // max(1, len(a) * len(b)))
        for k in range(0, len(names), step):
            part = shares[k : k + step]
            out[np.ix_(a, b)] += _gap(part[:, a, None], part[:, None, b]).sum(axis=0)
    # Sparse: what a source's own count changes against all that lack the term, by share.
    own = np.stack([at[~heavy], p[~heavy]], axis=1)
    own, times = np.unique(own, axis=0, return_counts=True)
    for (g, q), n in zip(own.tolist(), times.tolist()):
        out[g, :] += n * (_gap(np.int64(q), base) - common[g, :])
        out[:, g] += n * (_gap(base, np.int64(q)) - common[:, g])
    # Sparse: pairs that both have the term.
    order = np.argsort(term[~heavy], kind="stable")
    term, at, p = term[~heavy][order], at[~heavy][order], p[~heavy][order]
    for d in range(1, LIGHT):
        k = np.flatnonzero(term[d:] == term[:-d])
        for x, y in ((k, k + d), (k + d, k)):
            g, h = at[x], at[y]
            np.add.at(out, (g, h), _gap(p[x], p[y]) - _gap(p[x], base[h]) - _gap(base[g], p[y]) + common[g, h])
    return out


def _tile(rows: pa.Table) -> pa.Table:
    """The sums of one chunk of one pair of blocks, as rows (lang, g, h, value)."""
    g, block, p, heavy, common = (rows[c].to_numpy() for c in ("g", "block", "p", "heavy", "common"))
    alone = rows["term"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    known = np.flatnonzero(alone)[np.argsort(g[alone], kind="stable")]
    entry = np.flatnonzero(~alone)
    term = pc.dictionary_encode(rows["term"].combine_chunks().take(pa.array(entry))).indices.to_numpy().astype(np.int64)
    at = np.searchsorted(g[known], g[entry])
    out = tile_sums(block[known], p[known], int(common[known].max(initial=0)), term, at, p[entry], heavy[entry].astype(bool))
    apart = block[known][:, None] != block[known][None, :]
    wanted = apart if apart.any() else ~np.eye(len(known), dtype=bool)
    x, y = np.nonzero(wanted)
    return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(x), pa.string()), "g": pa.array(g[known][x]), "h": pa.array(g[known][y]), "value": pa.array(out[x, y])})


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value): for all ordered pairs of a language's sources."""
    entries = kept.select("lang", "term", (F.size("posts") > LIGHT).alias("heavy"), F.explode("posts").alias("e")).select("lang", "term", "heavy", "e.source", "e.n")
    entries = entries.join(groups, ["lang", "source"])
    chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")
    shares = entries.select("lang", "term", "heavy", "g", "block", "blocks", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.lit(0).cast("bigint").alias("common"), chunk.alias("chunk"))
    # A row without a term for every source in every chunk: its share of terms it lacks. The
    # first chunk answers for all terms as if no source had them.
    bases = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    first = F.when(F.col("chunk") == 0, F.col("terms")).otherwise(F.lit(0).cast("bigint"))
    bases = bases.select("lang", F.lit(None).cast("string").alias("term"), F.lit(False).alias("heavy"), "g", "block", "blocks", F.col("base").alias("p"), first.alias("common"), "chunk")
    dealt = shares.unionByName(bases).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
    sums = dealt.groupBy("lang", "low", "high", "chunk").applyInArrow(_tile, "lang string, g int, h int, value bigint")
    return sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the
    language, by the sum over its kept terms of floor((p - q)^2 / q), p and q the shares of
    both. Part ``term``: the ``top`` terms that the source has more of than its language."""
    kept = written(kept_terms(docs, min_docs))
    groups = written(groups_of(docs, kept, tile, chunk))
    names = groups.select("lang", "g", "source")
    sums = pair_sums(kept, groups).join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    entries = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("posts").alias("e")).select("lang", "term", "lang_n", "e.source", "e.n")
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = entries.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "part", "item", F.expr("((p - q) * (p - q)) div q").alias("value")).withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
