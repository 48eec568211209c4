"""Every registered corpus query, called whole on a small folder of awkward tables, against
brute force or, where there is one, its SQL in DuckDB."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_contamination, brute_fingerprint, brute_lines, roots, sentence
from tidemark.llm import linededup, media, quality, simhash, toxicity
from tidemark.llm.queries import QUERIES, SQL, bpe_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    line = "The same long line stands in many of the documents here."
    rude = ["worthlessness", "disgustingly", "stupidheaded"]
    rows, labels = [], []
    for k in range(150):
        words = sentence(r, r.randint(3, 150)).split()
        bad, toxic = k % 5 == 0, k % 4 == 1
        if toxic:
            for _ in range(5):
                words.insert(r.randrange(len(words)), r.choice(rude))
        text = " !!&& ".join(words).upper() if bad else " ".join(words)
        if k % 7 == 0:
            text = f"{text}\n  {line} \n{sentence(r, 4)}\n{line}"
        rows.append((k, text, ("en", "de", "fr")[k % 3], "s", len(text)))
        labels.append((k, int(not bad), int(toxic)))
    rows += [(200 + k, rows[3][1], "en", "s", 1) for k in range(6)]
    rows += [(300, None, "en", "s", 1), (301, "", None, "s", 0), (302, " \n\t ", "de", "s", 1), (303, "x <|endoftext|> y" * 90, "en", "s", 1), (304, "12 34", "en", "s", 5)]
    rows += [rows[7], rows[7], (None, rows[14][1], "fr", "s", 1), (305, "z" * 3000 + " " + sentence(r, 3000), "en", "s", 1)]
    labels += [(None, 1, 1), (301, None, None), (7, 0, 0)]
    items = [(1, rows[8][1][:120]), (2, " ".join(rows[9][1].split()[:6])), (10, rows[305 - 305 + 11][1]), (3, None), (None, rows[12][1][:90]), (4, rows[8][1][:120])]
    turns = [(c, t, ("user", "assistant", None)[(c + t) % 3], sentence(r, 4) if (c * t) % 5 else None) for c in range(40) for t in range(c % 6)]
    turns += [(500, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(400)] + [(None, 0, "user", "lost"), turns[5], turns[5]]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path, rows, items


def in_duckdb(path, sql):
    db = duckdb.connect()
    for name in ("documents", "labels", "benchmark", "conversations"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    return Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, folder, name):
    rows = QUERIES[name](spark, folder[0])
    found = Counter(tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect())
    assert found == in_duckdb(folder[0], SQL[name])


def test_op1(spark, folder):
    path, rows, items = folder
    want = Counter()
    for doc, text, *_ in rows:
        n, hit, found = brute_contamination(text, items)
        want[doc, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0] += 1
    found = QUERIES["op1_decontaminate"](spark, path).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(map(tuple, found.collect())) == want


def test_op2(spark, folder):
    path, rows, _ = folder
    want = Counter()
    for doc, text, *_ in rows:
        data = (text or "").encode()
        full = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        stored = b"P5\n64 %d\n255\n" % (len(full) // 64) + full
        image = np.frombuffer(full, dtype=np.uint8).reshape(-1, 64)
        facts = (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        want[(doc, *facts, media.difference_hash(image), hashlib.sha256(media.tile(image)).hexdigest())] += 1
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
    assert Counter(map(tuple, QUERIES["op2_media"](spark, path).select(columns).collect())) == want


@pytest.mark.parametrize(("name", "modulus", "rest", "threshold"), [("op3_quality", 5, 0, quality.THRESHOLD), ("op10_toxicity", 3, 1, toxicity.THRESHOLD)])
def test_op3_and_op10(spark, folder, name, modulus, rest, threshold):
    path, rows, _ = folder
    found = QUERIES[name](spark, path).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, *_ in rows)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    score = {r["doc_id"]: r["score"] for r in found}
    assert abs(score[3] - score[203]) < 1e-9  # equal texts
    truth = (lambda k: k % 5 != 0) if name == "op3_quality" else (lambda k: k % 4 == 1)
    assert np.mean([(score[k] >= threshold) == truth(k) for k in range(150)]) > 0.8


def test_scores_do_not_see_held_out_labels(spark, folder, tmp_path):
    """Turning every held-out label around changes no score."""
    path, _, _ = folder
    for name, label, modulus, rest in (("op3_quality", "quality", 5, 0), ("op10_toxicity", "toxic", 3, 1)):
        other = str(tmp_path / name)
        spark.read.parquet(f"{path}/documents.parquet").selectExpr("doc_id", "text", "'zz' AS lang", "'other' AS source", "n_chars").write.parquet(f"{other}/documents.parquet")
        turned = f"CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % {modulus} = {rest} THEN 1 - {label} ELSE {label} END AS {label}"
        spark.read.parquet(f"{path}/labels.parquet").selectExpr("doc_id", turned).write.parquet(f"{other}/labels.parquet")
        rows = lambda p: sorted((str(r["doc_id"]), r["score"]) for r in QUERIES[name](spark, p).collect())
        assert rows(path) == rows(other)


def test_op4(spark, folder):
    from tokenizers import Tokenizer

    path, rows, _ = folder
    exact = Tokenizer.from_file(bpe_path())
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    found = QUERIES["op4_packing"](spark, path).toPandas()
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert got == want
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 1024
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 1024) * 1.1 + 1


def test_op5(spark, folder):
    path, rows, _ = folder
    found = QUERIES["op5_sharding"](spark, path).collect()
    want = Counter((d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    for shard in {r["shard"] for r in found}:
        own = [r["slot"] for r in found if r["shard"] == shard]
        assert 0 <= shard < 16 and sorted(own) == list(range(len(own)))


def test_op7(spark, folder):
    path, rows, _ = folder
    text = dict((d, t) for d, t, *_ in rows)
    for r in QUERIES["op7_language"](spark, path).collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        has = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in ("en", "de", "fr") if has else r["lang_pred"] == "und")


@pytest.mark.parametrize("tile", [2, 4096])
def test_op8(spark, folder, tile, monkeypatch):
    """With a small tile every bucket is cut and the tile filter does the work."""
    path, rows, _ = folder
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    root = roots(prints)
    want = Counter((rows[k][0], f"{prints[k]:016x}", min((rows[i][0] for i in range(len(rows)) if root[i] == root[k] and rows[i][0] is not None), default=None)) for k in range(len(rows)))
    if tile == 4096:
        found = QUERIES["op8_simhash"](spark, path)
    else:
        found = simhash.near_duplicates(spark.read.parquet(f"{path}/documents.parquet").withColumnRenamed("source", "fingerprint"), tile=tile)
    assert Counter(map(tuple, found.select("doc_id", "fingerprint", "component_id").collect())) == want


def test_op9(spark, folder):
    path, rows, _ = folder
    want = Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute_lines([r[:2] for r in rows]))
    assert Counter(map(tuple, QUERIES["op9_line_dedup"](spark, path).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want
    assert sum(k * n for (_, _, k, _), n in want.items()) > 20


def test_pipeline_on_awkward_and_empty_tables(spark, folder, tmp_path):
    """Nulls, repeated rows and clashing names pass every stage; so do empty tables."""
    from pyspark.sql import functions as F

    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clashing = docs.withColumns({c: F.lit("mine") for c in ("score", "n_hit", "n_lines", "fp", "component_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        clashing = linededup.written(stage(spark, clashing, path))
        assert clashing.columns[: len(docs.columns)] == docs.columns and {r["n_hit"] for r in clashing.select("n_hit").distinct().collect()} <= {"mine"}
    assert 0 < clashing.count() < docs.count()
    assert corpus_pipeline.run(spark, path).count() >= clashing.count()
    empty = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
