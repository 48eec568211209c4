"""A corpus pipeline in five stages, each one operator over all that the stage before kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the folder that driver and executors share and reads it again as
the next stage's documents. All stages but the last return the columns of ``documents``,
those of clashing names with their own values.

Defined cases, beside those of the operators: a null or empty text has no feature and is
kept or rejected by the classifier's bias, like any other; without labels every document is
kept; rows with a null doc_id or one that repeats pass all stages as documents of their own;
an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, linededup, packing, quality, simhash
from tidemark.llm.common import kept_columns, table, written
from tidemark.llm.queries import bpe_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. All labels are learned from."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return kept_columns(docs, ["score"], lambda d: quality.score(d, model).where(F.col("score") >= quality.THRESHOLD))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; ``n_chars`` follows the text."""

    def work(rows: DataFrame) -> DataFrame:
        done = linededup.dedup_lines(rows)
        if "n_chars" not in rows.columns:
            return done
        kind = rows.schema["n_chars"].dataType
        return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))

    return kept_columns(docs, ["n_lines", "n_dropped"], work)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    return packing.packed(docs, bpe_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("best-fit packing", packing_stage),
]

#: A trained classifier and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
