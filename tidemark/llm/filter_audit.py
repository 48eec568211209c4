"""What filters do to each other: an audit of every order of some filters by the subset-zeta
transform.

One pass turns every document into a mask of the filters that it fails. A filter of the kind
"repeats an earlier document" is one aggregation by hash of the text: the rows of a text are
first added up by document and facts, then by facts, so that a text which a third of the rows
share is folded in the tasks, and the least doc_id of each text tells its rows apart. What is
left are counts of masks for every part, a few rows for each. The transform turns those into
the survivors of every subset of the filters: Z[X] = sum of the counts of masks inside X, and
a subset T of filters leaves Z[complement of T]. Every step of every order is the difference
of two neighbouring subsets, likewise for documents with a label; a filter's share over all
orders weighs those differences by how many orders pass through them.

Defined cases: a null text is empty; a null part is the empty string; a null doc_id is no
smaller than any other, so its rows repeat nothing and nothing repeats them; rows of equal
doc_id and text do not repeat each other; of several label rows of a doc_id the largest value
counts, null labels count as none; an empty table gives an empty result; columns other than
``doc_id``, ``text`` and the part are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER

#: Name of the filter that fails documents whose text a smaller doc_id has.
REPEAT = "E"

_SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def _words(text: Column) -> Column:
    """ASCII white space splits; a single blank does, which Spark splits at without a pattern."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def text_failures() -> dict[str, Column]:
    """The failure conditions of the filters A to D, over the column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = _words(text)
    upper = F.octet_length(text) - F.octet_length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < 65 * F.size(words).cast("bigint"),
        "C": 100 * upper.cast("bigint") > 5 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, *, part: str = "source", failures: dict[str, Column] | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of failed filters, bit k for
    the k-th of ``failures``, the highest for ``REPEAT``; and those with a label."""
    failures = text_failures() if failures is None else failures
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures.values())), F.lit(0))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), bits.alias("mask"), F.sha2(text.cast("binary"), 256).alias("t"))
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max(c) == 1, F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "bad"))])
    facts = ["t", "part", "mask", "good", "bad"]
    known = rows.join(flags, "doc_id", "left").fillna(False, ["good", "bad"])
    documents = known.groupBy("doc_id", *facts).agg(F.count("*").alias("n"))
    folded = documents.groupBy(*facts).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("f"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("alone"))
    # A text's rows are as many as it has parts and labels here, not as it has documents.
    own = F.col("f.doc_id") == F.min("f.doc_id").over(W.partitionBy("t"))
    folded = folded.withColumn("first", F.col("alone") + F.when(own, F.col("f.n")).otherwise(0))
    times = F.explode(F.array(F.struct(F.lit(0).alias("bit"), F.col("first").alias("n")), F.struct(F.lit(1 << len(failures)).alias("bit"), (F.col("n") - F.col("first")).alias("n"))))
    split = folded.select("part", "mask", "good", "bad", times.alias("x")).select("part", (F.col("mask") + F.col("x.bit")).alias("mask"), "good", "bad", F.col("x.n").alias("n"))
    label = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), label("good").alias("good"), label("bad").alias("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """By subset of filters (bits of the last axis' index), how many documents it leaves, from
    the counts of masks: the zeta transform over subsets, read at the complements."""
    z, size = counts.copy(), counts.shape[-1]
    for bit in range(size.bit_length() - 1):
        view = z.reshape(*z.shape[:-1], -1, 2, 1 << bit)
        view[..., 1, :] += view[..., 0, :]
    return z[..., ::-1]


def order_steps(counts: np.ndarray, names: str) -> dict[str, np.ndarray | list]:
    """All steps of all orders of the filters ``names`` from the counts of masks, of all, good
    and toxic documents (3 by masks)."""
    k, full = len(names), (1 << len(names)) - 1
    left = survivors(counts)
    orders = list(permutations(range(k)))
    which = np.array(orders, dtype=np.int64).reshape(-1, k)
    after = np.cumsum(1 << which, axis=1)
    before = after - (1 << which)
    lost = left[:, before] - left[:, after]
    fails = left[0, 0] - left[0, 1 << np.arange(k)]
    share = []
    for f in range(k):
        others = [s for s in range(full + 1) if not s >> f & 1]
        share.append(sum(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * int(left[0, s] - left[0, s | 1 << f]) for s in others))
    return {
        "filter_order": ["".join(names[f] for f in o) for o in orders for _ in range(k)],
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
        "kept": left[0, after].ravel(),
        "removed": lost[0].ravel(),
        "redundant": (fails[which] - lost[0]).ravel(),
        "unique_fails": counts[0, 1 << which].ravel(),
        "good_lost": lost[1].ravel(),
        "toxic_lost": lost[2].ravel(),
        "shapley": np.array(share, dtype=np.int64)[which].ravel(),
    }


def audit(docs: DataFrame, labels: DataFrame, *, part: str = "source", failures: dict[str, Column] | None = None) -> DataFrame:
    """A row for every part, order of the filters (``failures`` and then ``REPEAT``) and step:
    documents ``kept`` after it and ``removed`` by it, ``redundant`` ones that fail its filter
    but were removed before, ``unique_fails`` of its filter only, ``good_lost`` and
    ``toxic_lost`` of the removed ones, and ``shapley``, what its filter removes in all orders
    together. All orders are listed, so keep the filters few."""
    names = "".join(text_failures() if failures is None else failures) + REPEAT
    counts = mask_counts(docs, labels, part=part, failures=failures)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))  # a row for each mask

    def steps(batches):
        for batch in batches:
            for own, rows in zip(batch.column("part").to_pylist(), batch.column("c").to_pylist()):
                table = np.zeros((3, 1 << len(names)), dtype=np.int64)
                for r in rows:
                    table[:, r["mask"]] = r["n"], r["good"], r["toxic"]
                done = order_steps(table, names)
                arrays = [pa.array(v) for v in done.values()]
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(arrays[0]), pa.string()), *arrays], names=["part", *done])

    return parts.mapInArrow(steps, _SCHEMA)
