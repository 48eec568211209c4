"""The pipeline against stage-by-stage brute force, and the registered queries' shape."""

import re

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, linededup, quality, simhash
from tidemark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages_and_queries():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(SQL) < set(QUERIES)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(linededup.written(stage(spark, found[-1], SF)))
    return found


def test_each_stage_does_its_work(spark, stages):
    docs, good, lined, single, clean, packed = stages
    assert all(d.columns == docs.columns for d in stages[:-1])
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = ids(docs) - ids(good)
    assert gone and sum(labels.get(d, 0) for d in gone) == 0
    assert ids(good) == ids(lined)
    from tests.llm.test_operators import brute_fingerprint, brute_lines, roots

    want = {doc: text for doc, _, _, text in brute_lines([tuple(r) for r in good.select("doc_id", "text").collect()])}
    got = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert want == got
    order = sorted(got)
    root = roots([brute_fingerprint(got[d]) for d in order])
    assert ids(single) == {order[r] for r in root}
    marked = decontaminate.contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(clean) == ids(marked.where("n_hit = 0")) and ids(clean) < ids(single)
    assert ids(packed) == ids(clean)


def test_run_equals_the_stages(spark, stages):
    rows = lambda d: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in d.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1])


def test_quality_reads_no_other_column(spark):
    """Scores depend on the text alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.F.lit(True))
    a = quality.score(docs, model).select("doc_id", "score")
    b = quality.score(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "0 AS n_chars"), model).select("doc_id", "score")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_simhash_stage_is_registered_with_whole_tables():
    assert simhash.RADIUS == 4 and linededup.MIN_DOCS == 5
