"""Line dedup with DataFrame functions only.

Lines are normalised and hashed once (two independent 64-bit hashes, with their positions),
as a written table of arrays sorted by hash, so that a document's repeats of a line stand
side by side and count once. One aggregation of the exploded hashes counts the documents of
each and takes the largest doc_id. The lines of hashes over the threshold go back to the
documents as lists of positions, one list per affected text, and a text is put together
again, by position, from the lines that stay: set difference and lookups, linear in its
lines. Texts are moved only where those lists outgrow a broadcast of a checked size.

Defined cases: a null or empty text is one empty line; a line that a document repeats
counts once for it and all its copies have the same fate; a document is a row, so equal
rows count each; rows with equal doc_id share decisions; a null doc_id is smaller than any
other, and the largest where no other has the line; an empty table gives an empty result;
other columns are kept, except ``n_lines`` and ``n_dropped``, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, written

MIN_CHARS, MIN_DOCS = 40, 5

#: Rows of hashes, and positions in drop lists, that may be broadcast (some 40 bytes each).
BROADCAST_ROWS = 500_000

_SPACE = " \t\n\x0b\f\r"


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _hash(line: Column, place: Column, min_chars: int) -> Column:
    """The hashes of a line's key and its place; null if the key is shorter than ``min_chars``."""
    bare = F.trim(line, F.lit(_SPACE))
    key = lower_ascii(bare)
    return F.when(F.length(bare) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"), place.alias("place")))


def _keys() -> list[Column]:
    """What a row is known by: equal texts of a doc_id have the same fate."""
    return [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__t"), F.xxhash64(F.lit(1), F.col("text")).alias("__u")]


def hashed_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """(__id, __t, __u, lines): for every row with such lines its (a, b, place), sorted."""
    found = F.array_sort(F.array_compact(F.transform(_lines(), lambda x, i: _hash(x, i, min_chars))))
    return docs.select(*_keys(), found.alias("lines")).where(F.size("lines") > 0)


def repeated_lines(hashed: DataFrame, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """(a, b, last): hashes of the lines in at least ``min_docs`` documents, and the largest
    doc_id that has the line."""
    ab = F.transform("lines", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    once = F.filter(F.col("ab"), lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("ab", i - 1)))
    rows = hashed.select("__id", ab.alias("ab")).select("__id", F.explode(once).alias("h")).select("__id", "h.a", "h.b")
    counted = rows.groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("__id").alias("last"))
    return counted.where(F.col("docs") >= min_docs).select("a", "b", "last")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def dropped_places(hashed: DataFrame, repeated: DataFrame) -> DataFrame:
    """(__id, __t, __u, __drop): the places of the lines that a text loses."""
    rows = hashed.select("__id", "__t", "__u", F.explode("lines").alias("h")).select("__id", "__t", "__u", "h.a", "h.b", "h.place")
    hits = rows.join(_sized(repeated, repeated.count()), ["a", "b"]).where(~F.col("__id").eqNullSafe(F.col("last")))
    return hits.groupBy("__id", "__t", "__u").agg(F.collect_set("place").alias("__drop"))  # of one text


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines dropped from ``text`` whose key has at least ``min_chars``
    code points and is in at least ``min_docs`` documents, except in the largest doc_id
    that holds the key; and ``n_lines`` (before) and ``n_dropped``. A key is the line
    without ASCII white space at both ends, A-Z lower-cased."""
    docs = docs.drop("n_lines", "n_dropped")
    hashed = written(hashed_lines(docs, min_chars=min_chars))
    lists = written(dropped_places(hashed, written(repeated_lines(hashed, min_docs=min_docs))))
    entries = lists.agg(F.sum(F.size("__drop") + 2)).first()[0] or 0
    own = [F.col("doc_id"), F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))]
    same = own[0].eqNullSafe(F.col("__id")) & (own[1] == F.col("__t")) & (own[2] == F.col("__u"))
    joined = docs.join(_sized(lists, entries), same, "left").withColumn("n_lines", _newlines("text") + 1)
    places = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), "__drop")
    lines = F.when(F.col("__drop").isNotNull(), F.struct(_lines().alias("all"), places.alias("kept")))
    joined = joined.withColumn("__lines", lines)
    kept = F.array_join(F.transform("__lines.kept", lambda i: F.get("__lines.all", i)), "\n")
    out = joined.withColumn("n_dropped", F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("bigint"))
    out = out.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped")


def _newlines(column: str) -> Column:
    text = F.coalesce(F.col(column), F.lit(""))
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def digest(done: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
