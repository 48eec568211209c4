"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, filter_audit, language, linededup, media, packing, preference, quality, sharding, simhash, source_audit, substrings, toxicity
from tidemark.llm.common import remainder, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


OP1_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', 0, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), item_windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS window_text
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM words WHERE side = 'b' AND len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS window_text
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE side = 'd' AND len(w) >= size)
), found AS (
  SELECT rid, d.size, i, item_id FROM doc_windows d JOIN item_windows b USING (size, window_text)
), hits AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM found)) GROUP BY rid
), listed AS (
  SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid
)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (rid) LEFT JOIN listed USING (rid) WHERE side = 'd'
"""


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"), keep=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), bpe_path())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.digest(preference.format_pairs(preference.reply_pairs(table(spark, sf_dir, "conversations"))))


OP6_SQL = """
WITH turns AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, 'unknown'), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), placed AS (
  SELECT conv_id, t, coalesce(list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')), 0) AS last FROM turns
), pairs AS (
  SELECT a.conv_id AS pair_id,
    CASE WHEN a.last > 0 THEN a.t[1 : a.last] ELSE a.t END AS c,
    list_concat(CASE WHEN a.last > 0 THEN a.t[1 : a.last - 1] ELSE a.t END, CASE WHEN b.last > 0 THEN b.t[b.last : b.last] ELSE [] END) AS r
  FROM placed a LEFT JOIN placed b ON b.conv_id = xor(a.conv_id, 1)
), split AS (
  SELECT pair_id, c, r, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)) - 1, len(c)) AS k FROM pairs
), parts AS (
  SELECT pair_id, k,
    list_transform(c[1 : k], lambda x: '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10) || replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)) AS p,
    list_transform(c[k + 1 :], lambda x: struct_pack(role := x.role, head := '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10), body := replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10))) AS c,
    list_transform(r[k + 1 :], lambda x: struct_pack(role := x.role, head := '<|im_start|>' || replace(x.role, '<|', '< |') || chr(10), body := replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10))) AS r
  FROM split
)
SELECT pair_id, CAST(k AS BIGINT) AS prompt_turns, sha256(coalesce(array_to_string(p, ''), '')) AS prompt_sha256,
  sha256(coalesce(array_to_string(list_transform(c, lambda x: x.head || x.body), ''), '')) AS chosen_sha256,
  sha256(coalesce(array_to_string(list_transform(r, lambda x: x.head || x.body), ''), '')) AS rejected_sha256,
  coalesce(array_to_string(list_transform(c, lambda x: '0:' || length(x.head) || ',' || CASE WHEN x.role = 'assistant' THEN '1:' ELSE '0:' END || length(x.body)), ','), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(r, lambda x: '0:' || length(x.head) || ',' || CASE WHEN x.role = 'assistant' THEN '1:' ELSE '0:' END || length(x.body)), ','), '') AS rejected_mask
FROM parts
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    return language.identify(docs.drop("lang"), model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP9_SQL = """
WITH lines AS (
  SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT rid, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rid) >= 5
), marked AS (
  SELECT rid, doc_id, line, pos, repeated.k IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
marked AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM docs JOIN firsts USING (text)
), flags AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS toxic
  FROM marked LEFT JOIN flags USING (doc_id) GROUP BY part, mask
), filters AS (SELECT unnest(range(5)) AS f),
orders AS (
  SELECT a.f AS a, b.f AS b, c.f AS c, d.f AS d, e.f AS e FROM filters a, filters b, filters c, filters d, filters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT chr(65 + a::INT) || chr(65 + b::INT) || chr(65 + c::INT) || chr(65 + d::INT) || chr(65 + e::INT) AS filter_order, s AS step,
    1 << ([a, b, c, d, e][s])::INT AS own, list_sum(list_transform([a, b, c, d, e][: s - 1], lambda x: 1 << x::INT)) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS s)
), done AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (WHERE mask & (coalesce(earlier, 0)::INT | own) = 0) AS kept,
    sum(n) FILTER (WHERE mask & coalesce(earlier, 0)::INT = 0 AND mask & own > 0) AS removed,
    sum(n) FILTER (WHERE mask & coalesce(earlier, 0)::INT > 0 AND mask & own > 0) AS redundant,
    sum(n) FILTER (WHERE mask = own) AS unique_fails,
    sum(good) FILTER (WHERE mask & coalesce(earlier, 0)::INT = 0 AND mask & own > 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & coalesce(earlier, 0)::INT = 0 AND mask & own > 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM done
"""


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), counted AS (SELECT rid, lang, source, term, count(*) AS n FROM (SELECT rid, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term HAVING count(*) >= 3),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
parts AS (SELECT DISTINCT lang, source FROM docs),
posts AS (SELECT c.lang, c.source, c.term, sum(c.n) AS n FROM counted c JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT p.lang, p.source, coalesce(sum(n), 0) AS total FROM parts p LEFT JOIN posts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(p.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(p.n, 0) + 1)) // (t.total + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS whole
  FROM totals t JOIN vocabulary v USING (lang) JOIN kept k USING (lang) LEFT JOIN posts p ON p.lang = t.lang AND p.source = t.source AND p.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((a.p - b.p) * (a.p - b.p)) // b.p), 0) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM parts a JOIN parts b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - whole) * (p - whole)) // whole FROM shares WHERE n > 0 AND p > whole
), placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM placed WHERE part = 'pair' OR rank <= 200
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, struct_pack(known := doc_id IS NOT NULL, doc := coalesce(doc_id, 0), start := i) AS place, i, array_to_string(w[i : i + 19], ' ') AS k
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)
), firsts AS (SELECT k, min(place) AS first FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT p) AS p FROM (SELECT rid, unnest(range(i, i + 20)) AS p FROM windows JOIN firsts USING (k) WHERE place > first) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(p, j)), lambda j: w[j]) END, ' '), '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (rid)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_preference": op6_preference,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_audit": op12_source_audit,
    "op13_substring_dedup": op13_substring_dedup,
}

SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op6_preference": OP6_SQL, "op9_line_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_source_audit": OP12_SQL, "op13_substring_dedup": OP13_SQL}
