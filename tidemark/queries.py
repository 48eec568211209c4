"""The registered queries over ranking logs and experiments, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import round_columns
from tidemark.operators import analytics, candidates as C, causal as K, experiments as X, features as E, models as M, ranking as R
from tidemark.plans.workflows import ABLATIONS
from tidemark.session import dealt, stored
from tidemark.sources import driver_tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, its doubles rounded to 6 places."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: round_columns(f(spark, folder))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def logged(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates as a written table: what reads them several times derives them once."""
    return stored(D.candidates(spark, folder))


def market_panel(spark: SparkSession, folder: str) -> DataFrame:
    return stored(D.panel(spark, folder))


def analytics_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = logged(spark, folder)
    return C.analytics_candidates(dealt(rows, rows.count(), "article_id"), D.articles(spark, folder), D.history(spark, folder, rows))


def article_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = logged(spark, folder)
    return C.with_articles(dealt(rows, rows.count(), "article_id"), D.articles(spark, folder))


ROWS = (
    D.with_tables("articles", "candidates", "history")
    + """,
lengths AS (SELECT user_id, max(len(article_id_fixed)) AS history_length FROM history GROUP BY user_id),
rows AS (
  SELECT c.*, published_time, category, premium, coalesce(history_length, 0) AS history_length,
    epoch_us(impression_time)::DOUBLE / 86400000000.0 - epoch_us(published_time)::DOUBLE / 86400000000.0 AS article_age_days
  FROM candidates c LEFT JOIN articles USING (article_id) LEFT JOIN lengths USING (user_id)
)
"""
)


@query(
    ROWS
    + """SELECT count(DISTINCT impression_id) AS impressions, count(*) AS candidates, sum(label)::BIGINT AS clicks,
  round(sum(label)::DOUBLE / nullif(count(*), 0), 6) AS ctr, count(DISTINCT user_id) AS active_users, round(avg(candidate_count)::DOUBLE, 6) AS mean_candidates
FROM rows"""
)
def kpi_summary(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.kpi_summary(D.candidates(spark, folder))


@query(
    ROWS
    + """, counts AS (SELECT count(DISTINCT user_id) AS u, count(DISTINCT impression_id) AS i, count(*) AS n, sum(label)::BIGINT AS c FROM rows)
SELECT 'active_users' AS stage, u AS units, 1.0::DOUBLE AS rate_from_previous FROM counts
UNION ALL SELECT 'impressions', i, round(i::DOUBLE / nullif(u, 0), 6) FROM counts
UNION ALL SELECT 'candidates', n, round(n::DOUBLE / nullif(i, 0), 6) FROM counts
UNION ALL SELECT 'clicks', c, round(c::DOUBLE / nullif(n, 0), 6) FROM counts"""
)
def exposure_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.exposure_funnel(D.candidates(spark, folder))


@query(
    ROWS
    + """, segmented AS (
  SELECT 'device_type' AS segment, coalesce(device_type, 'unknown') AS value, impression_id, label FROM rows
  UNION ALL SELECT 'candidate_position', CAST(candidate_position AS VARCHAR), impression_id, label FROM rows
  UNION ALL SELECT 'candidate_count', CASE WHEN candidate_count <= 5 THEN '01-05' WHEN candidate_count <= 10 THEN '06-10' ELSE '11+' END, impression_id, label FROM rows
  UNION ALL SELECT 'history_length', CASE WHEN history_length = 0 THEN '0' WHEN history_length <= 3 THEN '1-3' WHEN history_length <= 9 THEN '4-9' ELSE '10+' END, impression_id, label FROM rows
  UNION ALL SELECT 'freshness', CASE WHEN article_age_days < 1 THEN '<1d' WHEN article_age_days < 7 THEN '1-7d' ELSE '7d+' END, impression_id, label FROM rows
)
SELECT segment, value, count(DISTINCT impression_id) AS units, count(*) AS candidates, sum(label)::BIGINT AS clicks,
  round(sum(label)::DOUBLE / nullif(count(*), 0), 6) AS ctr, count(DISTINCT impression_id) < 5 AS low_support
FROM segmented GROUP BY segment, value"""
)
def segment_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.segment_kpis(analytics_rows(spark, folder), min_cell_count=5)


_RATES = "\n".join(
    f"UNION ALL SELECT 'null_{c}_rate', round(count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / nullif(count(*), 0), 6), NULL FROM rows"
    for c in ("impression_id", "user_id", "article_id", "impression_time", "published_time", "label")
)


@query(
    ROWS
    + f"""SELECT 'candidate_rows' AS metric, count(*)::DOUBLE AS numeric_value, NULL::VARCHAR AS text_value FROM rows
UNION ALL SELECT 'impression_rows', count(DISTINCT impression_id)::DOUBLE, NULL FROM rows
UNION ALL SELECT 'unique_users', count(DISTINCT user_id)::DOUBLE, NULL FROM rows
UNION ALL SELECT 'duplicate_impression_article', (count(*) - count(DISTINCT (impression_id, article_id)))::DOUBLE, NULL FROM rows
UNION ALL SELECT 'impression_candidate_count_mismatch', count(*)::DOUBLE, NULL FROM (
  SELECT impression_id FROM rows GROUP BY impression_id HAVING count(*) <> min(candidate_count) OR min(candidate_count) <> max(candidate_count))
UNION ALL SELECT 'invalid_label_rows', count(*) FILTER (WHERE label IS NULL OR label NOT IN (0, 1))::DOUBLE, NULL FROM rows
UNION ALL SELECT 'missing_article_metadata', count(*) FILTER (WHERE published_time IS NULL)::DOUBLE, NULL FROM rows
UNION ALL SELECT 'future_article_rows', count(*) FILTER (WHERE published_time > impression_time)::DOUBLE, NULL FROM rows
{_RATES}
UNION ALL SELECT 'min_impression_time', NULL, CAST(min(impression_time) AS VARCHAR) FROM rows
UNION ALL SELECT 'max_impression_time', NULL, CAST(max(impression_time) AS VARCHAR) FROM rows"""
)
def data_quality(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.data_quality(article_rows(spark, folder))


@query(
    D.with_tables("activity")
    + """, weeks AS (SELECT DISTINCT user_id, CAST(date_trunc('week', impression_time) AS DATE) AS w FROM activity_log),
eligible AS (SELECT * FROM weeks WHERE (SELECT count(DISTINCT w) FROM weeks) >= 2),
cohort AS (SELECT user_id, min(w) AS cohort_week FROM eligible GROUP BY user_id),
sizes AS (SELECT cohort_week, count(*) AS cohort_users FROM cohort GROUP BY cohort_week),
retained AS (
  SELECT cohort_week, CAST(date_diff('week', cohort_week, w) AS BIGINT) AS week_offset, count(DISTINCT user_id) AS active_users
  FROM eligible JOIN cohort USING (user_id) GROUP BY 1, 2
)
SELECT CAST(cohort_week AS VARCHAR) AS cohort_week, week_offset, cohort_users, active_users, round(active_users::DOUBLE / nullif(cohort_users, 0), 6) AS retention_rate
FROM retained JOIN sizes USING (cohort_week)"""
)
def user_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.user_cohorts(D.activity(spark, folder))


@query(
    D.with_tables("candidates")
    + """, slates AS (
  SELECT impression_id, user_id, impression_time, list(article_id ORDER BY candidate_position) AS inview,
    list(article_id ORDER BY candidate_position) FILTER (WHERE label = 1) AS clicked FROM candidates GROUP BY ALL
)
SELECT impression_id, user_id, CAST(i - 1 AS INTEGER) AS candidate_position, inview[i] AS article_id,
  CASE WHEN list_contains(coalesce(clicked, []), inview[i]) THEN 1 ELSE 0 END AS label, CAST(len(inview) AS INTEGER) AS candidate_count
FROM (SELECT *, unnest(range(1, len(inview) + 1)) AS i FROM slates)"""
)
def candidate_expansion(spark: SparkSession, folder: str) -> DataFrame:
    return C.expand_candidates(D.behaviors(spark, folder)).select("impression_id", "user_id", "candidate_position", "article_id", "label", "candidate_count")


@query(
    D.with_tables("articles", "candidates")
    + """, logged AS (
  SELECT impression_id, impression_time, list(article_id ORDER BY candidate_position) AS seen, coalesce(list(article_id ORDER BY candidate_position) FILTER (WHERE label = 1), []) AS clicked
  FROM candidates GROUP BY impression_id, impression_time
), spoilt AS (
  SELECT impression_id, impression_time,
    CASE WHEN impression_id % 83 = 0 THEN [] WHEN impression_id % 89 = 0 THEN list_concat(seen, seen[1:1]) WHEN impression_id % 101 = 0 THEN list_concat(seen, [-1]) ELSE seen END AS seen,
    CASE WHEN impression_id % 79 = 0 THEN list_concat(clicked, [-7]) ELSE clicked END AS clicked FROM logged
), behaviors AS (SELECT * FROM spoilt UNION ALL SELECT * FROM spoilt WHERE impression_id % 97 = 0),
catalogue AS (SELECT * FROM articles UNION ALL SELECT * FROM articles WHERE article_id % 103 = 0),
shown AS (SELECT impression_id, impression_time, unnest(list_distinct(seen)) AS article_id FROM behaviors)
SELECT 'duplicate_impression' AS "check", impression_id, NULL::BIGINT AS article_id FROM behaviors GROUP BY impression_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_article', NULL, article_id FROM catalogue GROUP BY article_id HAVING count(*) > 1
UNION ALL SELECT 'empty_slate', impression_id, NULL FROM behaviors WHERE len(seen) = 0
UNION ALL SELECT 'duplicate_in_slate', impression_id, NULL FROM behaviors WHERE len(list_distinct(seen)) < len(seen)
UNION ALL SELECT 'click_outside_slate', impression_id, NULL FROM behaviors WHERE len(list_filter(clicked, lambda x: NOT list_contains(seen, x))) > 0
UNION ALL SELECT 'future_article', impression_id, article_id FROM shown JOIN articles USING (article_id) WHERE published_time > impression_time
UNION ALL SELECT 'unknown_article', impression_id, s.article_id FROM shown s LEFT JOIN articles a USING (article_id) WHERE a.article_id IS NULL"""
)
def audit_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of a log with planted errors of every kind."""
    logged, articles = D.behaviors(spark, folder), D.articles(spark, folder)
    every = lambda k: F.col("impression_id") % k == 0
    kind = logged.schema["article_ids_inview"].dataType
    one = lambda v: F.array(F.lit(v)).cast(kind)
    seen = F.col("article_ids_inview")
    spoilt = logged.withColumns(
        {
            "article_ids_inview": F.when(every(83), F.array().cast(kind)).when(every(89), F.concat(seen, F.slice(seen, 1, 1))).when(every(101), F.concat(seen, one(-1))).otherwise(seen),
            "article_ids_clicked": F.when(every(79), F.concat("article_ids_clicked", one(-7))).otherwise(F.col("article_ids_clicked")),
        }
    )
    return C.violations(spoilt.unionByName(spoilt.where(every(97))), articles.unionByName(articles.where(F.col("article_id") % 103 == 0)))


@query(
    D.with_tables("candidates")
    + """SELECT count(DISTINCT user_id) AS users, count(DISTINCT impression_id) AS impressions, count(*) AS candidates, sum(label)::BIGINT AS clicks,
  CAST(min(impression_time) AS VARCHAR) AS min_time, CAST(max(impression_time) AS VARCHAR) AS max_time FROM candidates"""
)
def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = C.audit_summary(D.behaviors(spark, folder))
    return out.withColumns({c: F.col(c).cast("string") for c in ("min_time", "max_time")})


@query(
    D.with_tables("candidates")
    + """, times AS (SELECT impression_time, row_number() OVER (ORDER BY impression_time DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT impression_time FROM candidates)),
cut AS (SELECT impression_time AS t FROM times WHERE r = least(n - 1, greatest(1, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT))))
SELECT CASE WHEN impression_time < t THEN 'train' ELSE 'valid' END AS part, count(*) AS candidates, count(DISTINCT impression_id) AS impressions,
  CAST(min(impression_time) AS VARCHAR) AS first_time, CAST(max(impression_time) AS VARCHAR) AS last_time
FROM candidates, cut GROUP BY 1"""
)
def temporal_split(spark: SparkSession, folder: str) -> DataFrame:
    train, valid = C.temporal_split(logged(spark, folder), valid_fraction=0.2)
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))
    return both.groupBy("part").agg(
        F.count("*").alias("candidates"), F.count_distinct("impression_id").alias("impressions"), F.min("impression_time").cast("string").alias("first_time"), F.max("impression_time").cast("string").alias("last_time")
    )


SPLIT = (
    D.with_tables("articles", "candidates", "history")
    + """, times AS (SELECT impression_time, row_number() OVER (ORDER BY impression_time DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT impression_time FROM candidates)),
cut AS (SELECT impression_time AS t FROM times WHERE r = least(n - 1, greatest(1, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT)))),
train AS (SELECT c.* FROM candidates c, cut WHERE impression_time < t),
valid AS (SELECT c.* FROM candidates c, cut WHERE impression_time >= t),
overall AS (SELECT avg(label)::DOUBLE AS p FROM train),
rates AS (SELECT article_id, (sum(label)::DOUBLE + 20.0::DOUBLE * p) / (count(*)::DOUBLE + 20.0::DOUBLE) AS rate FROM train, overall GROUP BY article_id, p),
scored AS (
  SELECT 'position' AS model, *, -candidate_position::DOUBLE AS score FROM valid
  UNION ALL BY NAME SELECT 'popularity' AS model, v.*, round(coalesce(rate, p), 9) AS score FROM valid v LEFT JOIN rates USING (article_id), overall
)"""
)


def scored_models(spark: SparkSession, folder: str) -> DataFrame:
    """The validation rows scored by both baselines. Scores are rounded, so that engines that
    add in another order rank alike."""
    train, valid = C.temporal_split(logged(spark, folder), valid_fraction=0.2)
    found = R.predict_baselines([R.fit_baseline(kind, train) for kind in ("position", "popularity")], valid)
    return found.withColumn("score", F.round("score", 9))


@query(SPLIT + """SELECT article_id, round(rate, 6) AS rate FROM rates""")
def popularity_rates(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = C.temporal_split(logged(spark, folder), valid_fraction=0.2)
    return R.fit_baseline("popularity", train).rates


@query(
    SPLIT
    + """SELECT impression_id, article_id, round(score, 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, candidate_position) AS INTEGER) AS rank FROM scored WHERE model = 'popularity'
) WHERE rank <= 3"""
)
def top_k_ranking(spark: SparkSession, folder: str) -> DataFrame:
    train, valid = C.temporal_split(logged(spark, folder), valid_fraction=0.2)
    scored = R.predict_baseline(R.fit_baseline("popularity", train), valid).withColumn("score", F.round("score", 9))
    return R.rank_candidates(scored, top_k=3).select("impression_id", "article_id", "score", "rank")


PER_IMPRESSION = (
    SPLIT
    + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, impression_id ORDER BY score DESC, candidate_position) AS rn,
    row_number() OVER (PARTITION BY model, impression_id ORDER BY label DESC) AS ideal_rn,
    rank() OVER (PARTITION BY model, impression_id ORDER BY score) + (count(*) OVER (PARTITION BY model, impression_id, score) - 1) / 2.0::DOUBLE AS mid
  FROM scored
), per AS (
  SELECT model, impression_id, count(*) AS n, sum(label)::BIGINT AS clicks,
    CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(CASE WHEN label = 1 THEN mid END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label)))::DOUBLE END AS auc,
    coalesce(1.0::DOUBLE / min(CASE WHEN label = 1 THEN rn END), 0) AS rr,
    coalesce(sum(CASE WHEN label = 1 AND rn <= 5 THEN 1.0::DOUBLE / log2(rn + 1) ELSE 0 END) / nullif(sum(CASE WHEN label = 1 AND ideal_rn <= 5 THEN 1.0::DOUBLE / log2(ideal_rn + 1) ELSE 0 END), 0), 0) AS "ndcg@5",
    coalesce(sum(CASE WHEN label = 1 AND rn <= 10 THEN 1.0::DOUBLE / log2(rn + 1) ELSE 0 END) / nullif(sum(CASE WHEN label = 1 AND ideal_rn <= 10 THEN 1.0::DOUBLE / log2(ideal_rn + 1) ELSE 0 END), 0), 0) AS "ndcg@10"
  FROM ranked GROUP BY model, impression_id
)"""
)


@query(PER_IMPRESSION + """SELECT model, impression_id, n, clicks, round(auc, 6) AS auc, round(rr, 6) AS rr, round("ndcg@5", 6) AS "ndcg@5", round("ndcg@10", 6) AS "ndcg@10" FROM per""")
def per_impression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return R.per_impression(scored_models(spark, folder))


@query(
    PER_IMPRESSION
    + """SELECT model, round(avg(auc), 6) AS group_auc, round(avg(rr), 6) AS mrr, round(avg("ndcg@5"), 6) AS "ndcg@5", round(avg("ndcg@10"), 6) AS "ndcg@10",
  count(*) AS "groups", count(auc) AS auc_groups, count(*) - count(auc) AS skipped_auc_groups FROM per GROUP BY model"""
)
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return R.leaderboard(R.ranking_metrics(scored_models(spark, folder)))


@query(
    PER_IMPRESSION
    + """, lengths AS (SELECT user_id, max(len(article_id_fixed)) AS history_length FROM history GROUP BY user_id),
facts AS (
  SELECT impression_id, any_value(device_type) AS device_type, any_value(candidate_count) AS cc, coalesce(any_value(history_length), 0) AS hl
  FROM valid LEFT JOIN lengths USING (user_id) GROUP BY impression_id
), cells AS (
  SELECT 'device_type' AS segment, coalesce(device_type, '<missing>') AS value, impression_id FROM facts
  UNION ALL SELECT 'candidate_count', CASE WHEN cc <= 5 THEN 'small' WHEN cc <= 10 THEN 'medium' ELSE 'large' END, impression_id FROM facts
  UNION ALL SELECT 'history_length', CASE WHEN hl <= 0 THEN 'cold' WHEN hl <= 5 THEN 'short' ELSE 'long' END, impression_id FROM facts
)
SELECT segment, value, count(*) AS impressions, sum(n)::BIGINT AS candidates, count(*) < 5 AS low_support,
  round(avg(auc), 6) AS group_auc, round(avg(rr), 6) AS mrr, round(avg("ndcg@5"), 6) AS "ndcg@5", round(avg("ndcg@10"), 6) AS "ndcg@10"
FROM cells JOIN per USING (impression_id) WHERE model = 'popularity' GROUP BY 1, 2"""
)
def segment_ranking(spark: SparkSession, folder: str) -> DataFrame:
    rows = logged(spark, folder)
    lengths = D.history(spark, folder, rows).groupBy("user_id").agg(F.max(F.size("article_id_fixed")).alias("history_length"))
    train, valid = C.temporal_split(rows, valid_fraction=0.2)
    scored = R.predict_baseline(R.fit_baseline("popularity", train), valid).withColumn("score", F.round("score", 9))
    rows = scored.join(lengths, "user_id", "left")
    return R.segment_ranking_metrics(rows.withColumn("history_length", F.coalesce("history_length", F.lit(0))))


@query(
    ROWS
    + """, cells AS (
  SELECT 'candidate_position' AS diagnostic, CAST(candidate_position AS VARCHAR) AS bucket, label FROM rows
  UNION ALL SELECT 'article_freshness', CASE WHEN greatest(article_age_days, 0) < 1 THEN '<24h' WHEN greatest(article_age_days, 0) < 3 THEN '1-3d' WHEN greatest(article_age_days, 0) < 7 THEN '3-7d' ELSE '7d+' END, label FROM rows
)
SELECT diagnostic, bucket, count(*) AS candidates, sum(label)::BIGINT AS clicks, round(sum(label)::DOUBLE / count(*), 6) AS click_rate FROM cells GROUP BY 1, 2"""
)
def candidate_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    rows = article_rows(spark, folder)
    return R.candidate_diagnostics(rows.withColumn("publication_age_hours", F.greatest(F.col("article_age_days") * 24, F.lit(0.0))))


_POISSON = " ".join(f"WHEN u < {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r} THEN {k}" for k in range(12))


@query(
    PER_IMPRESSION
    + f""", draws AS (
  SELECT *, CASE {_POISSON} ELSE 12 END AS times FROM (
    SELECT per.*, s AS replicate, CAST('0x' || substr(md5(CAST(impression_id AS VARCHAR) || ':' || CAST(s // 4 AS VARCHAR) || ':42'), CAST(s % 4 * 8 + 1 AS INTEGER), 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
    FROM per, range(0, 200) t(s))
), replicates AS (
  SELECT model, replicate, sum(auc * times) / sum(CASE WHEN auc IS NOT NULL THEN times END) AS group_auc, sum(rr * times) / sum(times) AS mrr,
    sum("ndcg@5" * times) / sum(times) AS n5, sum("ndcg@10" * times) / sum(times) AS n10
  FROM draws WHERE times > 0 GROUP BY 1, 2
), long AS (
  SELECT model, 'group_auc' AS metric, group_auc AS v FROM replicates UNION ALL SELECT model, 'mrr', mrr FROM replicates
  UNION ALL SELECT model, 'ndcg@5', n5 FROM replicates UNION ALL SELECT model, 'ndcg@10', n10 FROM replicates
)
SELECT model, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper,
  count(v) AS valid_samples, CAST(200 AS BIGINT) AS requested_samples FROM long GROUP BY 1, 2"""
)
def bootstrap_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return R.bootstrap_intervals(R.per_impression(scored_models(spark, folder)), samples=200, how="poisson")


#: The experiment over customers: more returns under treatment, price and quantity guarded.
RCT = X.ExperimentConfig(
    unit_column="user_id",
    variant_column="variant",
    control_label="control",
    treatment_label="treatment",
    expected_allocation={"control": 0.5, "treatment": 0.5},
    primary=X.Metric("click", "binary", "increase"),
    guardrails=(X.Metric("price", "continuous", "non_decrease", -2000.0), X.Metric("quantity", "continuous", "non_increase", 0.5)),
    cuped_covariate="balance",
    pre_treatment_columns=("balance",),
    segment_columns=("segment",),
    alpha=0.05,
    practical_threshold=0.01,
    minimum_segment_units=200,
    confirmatory_segments=("segment",),
)

_ARMS = (
    D.with_tables("experiment")
    + """, arms AS (
  SELECT variant, count(*) AS n, avg(balance) AS x, var_samp(balance) AS vx,
    avg(click) AS m0, var_samp(click) AS v0, covar_samp(click, balance) AS c0, avg(price) AS m1, var_samp(price) AS v1, avg(quantity) AS m2, var_samp(quantity) AS v2
  FROM units GROUP BY variant
), c AS (SELECT * FROM arms WHERE variant = 'control'), t AS (SELECT * FROM arms WHERE variant = 'treatment'),
effects AS (
  SELECT 'click' AS metric, c.n AS cn, t.n AS tn, c.m0 AS cm, t.m0 AS tm, c.v0 AS cv, t.v0 AS tv FROM c, t
  UNION ALL SELECT 'price', c.n, t.n, c.m1, t.m1, c.v1, t.v1 FROM c, t
  UNION ALL SELECT 'quantity', c.n, t.n, c.m2, t.m2, c.v2, t.v2 FROM c, t
)"""
)
_Z = repr(X.normal_quantile(0.975))


def tail_sql(z: str) -> str:
    """The two-sided normal tail at ``z``, by the series of the error function whose terms
    are all positive."""
    term = f"exp(ln(abs({z}) / sqrt(2.0::DOUBLE)) + n * ln({z} * {z}) - (n + 1) * ln(2.0::DOUBLE) - lgamma(n + 1.5::DOUBLE) + 0.5::DOUBLE * ln(pi()))"
    series = f"2 / sqrt(pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 400), lambda n: {term}))"
    return f"CASE WHEN {z} = 0 THEN 1.0::DOUBLE WHEN abs({z}) > 9 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - {series}) END"


def experiment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The units as a written table: the analysis reads them five times and more."""
    return stored(D.experiment(spark, folder))


def arms(spark: SparkSession, folder: str) -> dict:
    return {r["arm"]: r for r in X.arm_moments(D.experiment(spark, folder), RCT).collect()}


def effects_frame(spark: SparkSession, effects: list[X.Effect]) -> DataFrame:
    keys = ("metric", "control_units", "treatment_units", "control_mean", "treatment_mean", "effect", "relative_effect", "standard_error", "ci_lower", "ci_upper")
    kinds = "metric string, control_units bigint, treatment_units bigint, control_mean double, treatment_mean double, effect double, relative_effect double, standard_error double, ci_lower double, ci_upper double"
    return spark.createDataFrame([tuple(getattr(e, k) for k in keys) for e in effects], kinds)


@query(
    D.with_tables("experiment")
    + """SELECT round(sum((n - total * 0.5::DOUBLE) ** 2 / (total * 0.5::DOUBLE)), 6) AS statistic, sum(n)::BIGINT AS units
FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM units GROUP BY variant)"""
)
def sample_ratio(spark: SparkSession, folder: str) -> DataFrame:
    srm = X.sample_ratio_mismatch({a: r["units"] for a, r in arms(spark, folder).items()}, RCT)
    return spark.createDataFrame([(srm.statistic, sum(srm.observed_counts.values()))], "statistic double, units bigint")


@query(
    _ARMS
    + f"""SELECT metric, cn AS control_units, tn AS treatment_units, round(cm, 6) AS control_mean, round(tm, 6) AS treatment_mean, round(tm - cm, 6) AS effect,
  round((tm - cm) / nullif(cm, 0), 6) AS relative_effect, round(sqrt(cv / cn + tv / tn), 6) AS standard_error,
  round(tm - cm - {_Z}::DOUBLE * sqrt(cv / cn + tv / tn), 6) AS ci_lower, round(tm - cm + {_Z}::DOUBLE * sqrt(cv / cn + tv / tn), 6) AS ci_upper FROM effects"""
)
def itt_effects(spark: SparkSession, folder: str) -> DataFrame:
    return effects_frame(spark, X.estimate_itt(arms(spark, folder), RCT))


@query(
    D.with_tables("experiment")
    + f""", fit AS (SELECT covar_samp(click, balance) / var_samp(balance) AS theta, avg(balance) AS x FROM units),
adjusted AS (SELECT variant, click, click - theta * (balance - x) AS y, theta FROM units, fit),
arms AS (SELECT variant, count(*) AS n, avg(y) AS m, var_samp(y) AS v, var_samp(click) AS raw, any_value(theta) AS theta FROM adjusted GROUP BY variant),
c AS (SELECT * FROM arms WHERE variant = 'control'), t AS (SELECT * FROM arms WHERE variant = 'treatment')
SELECT 'click' AS metric, round(t.m - c.m, 6) AS effect, round(sqrt(c.v / c.n + t.v / t.n), 6) AS standard_error, round(c.theta, 6) AS theta,
  round(t.m - c.m - {_Z}::DOUBLE * sqrt(c.v / c.n + t.v / t.n), 6) AS ci_lower, round(t.m - c.m + {_Z}::DOUBLE * sqrt(c.v / c.n + t.v / t.n), 6) AS ci_upper,
  round(sqrt(c.raw / c.n + t.raw / t.n), 6) AS raw_standard_error, round(1 - (c.v / c.n + t.v / t.n) / (c.raw / c.n + t.raw / t.n), 6) AS variance_reduction
FROM c, t"""
)
def cuped_effect(spark: SparkSession, folder: str) -> DataFrame:
    e = X.estimate_cuped(arms(spark, folder), RCT)
    row = (e.metric, e.effect, e.standard_error, e.theta, e.ci_lower, e.ci_upper, e.raw_standard_error, e.variance_reduction)
    return spark.createDataFrame([row], "metric string, effect double, standard_error double, theta double, ci_lower double, ci_upper double, raw_standard_error double, variance_reduction double")


@query(
    D.with_tables("experiment")
    + """, cells AS (SELECT 'segment' AS segment, segment AS value, variant, count(*) AS n, avg(click) AS m, var_samp(click) AS v FROM units GROUP BY ALL)
SELECT c.segment, c.value, c.n + t.n AS units, c.n AS control_units, t.n AS treatment_units, c.n + t.n < 200 AS low_support, round(t.m - c.m, 6) AS effect, round(sqrt(c.v / c.n + t.v / t.n), 6) AS standard_error
FROM cells c JOIN cells t ON c.value = t.value AND c.variant = 'control' AND t.variant = 'treatment'"""
)
def segment_effects(spark: SparkSession, folder: str) -> DataFrame:
    keys = ("segment", "value", "units", "control_units", "treatment_units", "low_support", "effect", "standard_error")
    return X.segment_cells(D.experiment(spark, folder), RCT).select(*keys)


_CELL_Z = " ".join(f"WHEN {k} THEN {X.normal_quantile(1 - 0.05 / k / 2)!r}::DOUBLE" for k in range(1, 21))


@query(
    D.with_tables("experiment")
    + f""", cells AS (SELECT segment AS value, variant, count(*) AS n, avg(click) AS m, var_samp(click) AS v FROM units GROUP BY ALL),
effects AS (
  SELECT c.value, t.m - c.m AS effect, sqrt(c.v / c.n + t.v / t.n) AS se, count(*) OVER () AS tests
  FROM cells c JOIN cells t ON c.value = t.value AND c.variant = 'control' AND t.variant = 'treatment'
), tails AS (SELECT *, effect / se AS z FROM effects), tested AS (SELECT *, {tail_sql("z")} AS p FROM tails),
placed AS (SELECT *, row_number() OVER (ORDER BY p, value) - 1 AS k FROM tested),
stepped AS (
  SELECT *, 0.05::DOUBLE / (tests - k) AS a, max((tests - k) * p) OVER (ORDER BY k) AS worst, CASE tests {_CELL_Z} END AS q,
    bool_and(p <= 0.05::DOUBLE / (tests - k)) OVER (ORDER BY k) AS significant FROM placed
)
SELECT 'segment' AS segment, value, round(p, 6) AS p_value, round(a, 6) AS multiplicity_alpha, round(least(1, worst), 6) AS holm_adjusted_p_value, significant,
  round(effect - q * se, 6) AS ci_lower, round(effect + q * se, 6) AS ci_upper, 'bonferroni' AS interval_method FROM stepped"""
)
def segment_inference(spark: SparkSession, folder: str) -> DataFrame:
    """P-values, Holm's adjustment and Bonferroni intervals of the confirmatory cells."""
    keys = ("segment", "value", "p_value", "multiplicity_alpha", "holm_adjusted_p_value", "significant", "ci_lower", "ci_upper", "interval_method")
    return X.segment_effects(experiment_rows(spark, folder), RCT).select(*keys)


#: An experiment over order lines: odd orders are treated, every part and line parity a cell.
LINES = replace(RCT, unit_column="line", primary=X.Metric("click", "binary", "increase"), guardrails=(), cuped_covariate="quantity", pre_treatment_columns=("quantity",), segment_columns=("cell",), confirmatory_segments=("cell",))


@query(
    f"""WITH cells AS (
  SELECT CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber % 5 AS VARCHAR) AS value, l_orderkey % 2 = 1 AS treated, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS click FROM lineitem
), arms AS (
  SELECT value, count(*) FILTER (WHERE NOT treated) AS cn, count(*) FILTER (WHERE treated) AS tn, avg(click) FILTER (WHERE NOT treated) AS cm, avg(click) FILTER (WHERE treated) AS tm,
    var_samp(click) FILTER (WHERE NOT treated) AS cv, var_samp(click) FILTER (WHERE treated) AS tv FROM cells GROUP BY value
), effects AS (
  SELECT value, CASE WHEN least(cn, tn) >= 2 THEN tm - cm END AS effect, CASE WHEN least(cn, tn) >= 2 THEN sqrt(greatest(cv, 0) / cn + greatest(tv, 0) / tn) END AS se, count(*) OVER () AS tests FROM arms
), tails AS (SELECT *, effect / nullif(se, 0) AS z FROM effects),
tested AS (SELECT *, round(CASE WHEN se = 0 THEN CASE WHEN effect = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN z IS NULL THEN NULL ELSE {tail_sql("z")} END, 9) AS p FROM tails),
placed AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, value) - 1 AS k FROM tested),
stepped AS (
  SELECT *, 0.05::DOUBLE / (tests - k) AS a, max((tests - k) * p) OVER (ORDER BY k) AS worst,
    bool_and(coalesce(p <= 0.05::DOUBLE / (tests - k), false)) OVER (ORDER BY k) AS significant FROM placed
)
SELECT value, round(p, 6) AS p_value, round(a, 6) AS multiplicity_alpha, round(CASE WHEN p IS NOT NULL THEN least(1, worst) END, 6) AS holm_adjusted_p_value, significant FROM stepped"""
)
def holm_by_cell(spark: SparkSession, folder: str) -> DataFrame:
    """Holm's procedure over thousands of cells. P-values are rounded before they are ranked,
    so that engines that add in another order rank alike."""
    lines = D.read(spark, folder, "lineitem").select(
        F.when(F.col("l_orderkey") % 2 == 1, "treatment").otherwise("control").alias("variant"),
        (F.col("l_returnflag") == "R").cast("int").alias("click"),
        F.col("l_quantity").cast("double").alias("quantity"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("-"), (F.col("l_linenumber") % 5).cast("string")).alias("cell"),
    )
    cells = X.segment_cells(lines, LINES).withColumn("p_value", F.round("p_value", 9)).drop("ci_lower", "ci_upper")
    found = X.holm(cells, LINES.alpha)
    return found.select("value", "p_value", "multiplicity_alpha", "holm_adjusted_p_value", "significant")


@query(
    D.with_tables("experiment")
    + """SELECT variant, count(*) AS units, round(avg(click), 6) AS click_mean, round(avg(price), 6) AS price_mean, round(avg(quantity), 6) AS quantity_mean FROM units GROUP BY variant"""
)
def experiment_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = arms(spark, folder)
    rows = [(a, found[a]["units"], *(found[a][f"mean_{k}"] for k in range(3))) for a in RCT.arms]
    return spark.createDataFrame(rows, "variant string, units bigint, click_mean double, price_mean double, quantity_mean double")


@query(
    _ARMS
    + f""", bounds AS (SELECT *, tm - cm - {_Z}::DOUBLE * sqrt(cv / cn + tv / tn) AS low, tm - cm + {_Z}::DOUBLE * sqrt(cv / cn + tv / tn) AS high FROM effects)
SELECT metric, CASE WHEN low >= -2000 THEN 'pass' WHEN high < -2000 THEN 'fail' ELSE 'inconclusive' END AS state FROM bounds WHERE metric = 'price'
UNION ALL SELECT metric, CASE WHEN high <= 0.5 THEN 'pass' WHEN low > 0.5 THEN 'fail' ELSE 'inconclusive' END FROM bounds WHERE metric = 'quantity'"""
)
def guardrail_states(spark: SparkSession, folder: str) -> DataFrame:
    effects = {e.metric: e for e in X.estimate_itt(arms(spark, folder), RCT)}
    rows = [(m.name, X.guardrail_state(effects[m.name].ci_lower, effects[m.name].ci_upper, m)) for m in RCT.guardrails]
    return spark.createDataFrame(rows, "metric string, state string")


@query(
    _ARMS
    + f""", bounds AS (SELECT metric, tm - cm - {_Z}::DOUBLE * sqrt(cv / cn + tv / tn) AS low, tm - cm + {_Z}::DOUBLE * sqrt(cv / cn + tv / tn) AS high FROM effects),
states AS (
  SELECT count(*) FILTER (WHERE (metric = 'price' AND high < -2000) OR (metric = 'quantity' AND low > 0.5)) AS failed,
    count(*) FILTER (WHERE (metric = 'price' AND low >= -2000) OR (metric = 'quantity' AND high <= 0.5)) AS passed FROM bounds
), fit AS (SELECT covar_samp(click, balance) / var_samp(balance) AS theta, avg(balance) AS x FROM units),
adjusted AS (SELECT variant, count(*) AS n, avg(click - theta * (balance - fit.x)) AS m, var_samp(click - theta * (balance - fit.x)) AS v FROM units, fit GROUP BY variant),
gap AS (SELECT t.m - c.m AS effect, sqrt(c.v / c.n + t.v / t.n) AS se FROM adjusted c, adjusted t WHERE c.variant = 'control' AND t.variant = 'treatment'),
ratio AS (SELECT sum((n - total / 2.0::DOUBLE) ** 2 / (total / 2.0::DOUBLE)) AS statistic FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM units GROUP BY variant))
SELECT CASE WHEN statistic > {_Z}::DOUBLE ** 2 THEN 'invalid_experiment' WHEN effect + {_Z}::DOUBLE * se < 0 OR failed > 0 THEN 'do_not_launch'
  WHEN passed = 2 AND effect - {_Z}::DOUBLE * se > 0.01 THEN 'launch' ELSE 'continue_experiment' END AS status FROM states, gap, ratio"""
)
def launch_decision(spark: SparkSession, folder: str) -> DataFrame:
    found = X.make_decision(X.analyze_experiment(experiment_rows(spark, folder), RCT), RCT)
    return spark.createDataFrame([(found.status.value,)], "status string")


@query(
    D.with_tables("experiment")
    + f""", designs AS (SELECT rate, mde FROM (SELECT avg(click) FILTER (WHERE variant = 'control') AS rate FROM units), (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) v(mde)),
sizes AS (
  SELECT mde, CAST(ceil((({_Z}::DOUBLE * sqrt(2 * (rate + mde / 2) * (1 - rate - mde / 2)) + {X.normal_quantile(0.8)!r}::DOUBLE * sqrt(rate * (1 - rate) + (rate + mde) * (1 - rate - mde))) / mde) ** 2) AS BIGINT) AS units_per_arm FROM designs
)
SELECT mde, units_per_arm, CAST(ceil(2 * units_per_arm / 1000.0::DOUBLE) AS BIGINT) AS days FROM sizes"""
)
def sample_size(spark: SparkSession, folder: str) -> DataFrame:
    """Units for each arm and days at 1,000 units a day, from the control arm's click rate."""
    rate = arms(spark, folder)["control"]["mean_0"]
    rows = []
    for mde in (0.01, 0.02, 0.05):
        design = X.ExperimentDesign(rate, mde)
        rows.append((mde, X.required_sample_size(design), X.required_days(design, 1000)))
    return spark.createDataFrame(rows, "mde double, units_per_arm bigint, days bigint")


#: The rollout over nations: quarters as periods, the first quarter of 1999 as the rollout.
ROLLOUT = K.CausalConfig(
    "market_id", "relative_week", "treated_market", "policy_active", "candidate_exposures", "clicks", "ctr", "rate",
    rollout_week=0, reference_week=-1, placebo_week=-8, event_window=(-6, 5), balance_columns=("candidate_exposures", "ctr"), alpha=0.05,
    practical_threshold=0.002, business_exposure_scale=1_000_000, minimum_markets=4, minimum_treated_markets=2, minimum_control_markets=2,
    minimum_pre_weeks=2, minimum_post_weeks=2, maximum_missing_market_week_share=0.9,
)


@query(
    D.with_tables("panel")
    + """SELECT count(DISTINCT market_id) AS markets, count(*) AS "rows", sum(candidate_exposures)::BIGINT AS total_exposure,
  count(DISTINCT CASE WHEN treated_market = 1 THEN market_id END) AS treated_markets, count(DISTINCT CASE WHEN relative_week < 0 THEN relative_week END) AS pre_weeks,
  count(DISTINCT CASE WHEN relative_week >= 0 THEN relative_week END) AS post_weeks, CAST(min(relative_week) AS BIGINT) AS week_min, CAST(max(relative_week) AS BIGINT) AS week_max,
  round(1 - count(*) / (count(DISTINCT market_id) * (max(relative_week) - min(relative_week) + 1))::DOUBLE, 6) AS missing_market_week_share FROM panel"""
)
def panel_integrity(spark: SparkSession, folder: str) -> DataFrame:
    keys = ("markets", "rows", "total_exposure", "treated_markets", "pre_weeks", "post_weeks", "week_min", "week_max", "missing_market_week_share")
    found = K.validate_market_panel(market_panel(spark, folder), ROLLOUT)
    return spark.createDataFrame([tuple(found[k] for k in keys)], ", ".join(f"{k} bigint" for k in keys[:-1]) + ", missing_market_week_share double")


@query(
    D.with_tables("panel")
    + """, means AS (SELECT market_id, any_value(treated_market) AS g, avg(candidate_exposures) AS b0, avg(ctr) AS b1 FROM panel WHERE relative_week < 0 GROUP BY market_id),
long AS (SELECT g, 'candidate_exposures' AS metric, b0 AS v FROM means UNION ALL SELECT g, 'ctr', b1 FROM means),
s AS (SELECT metric, avg(v) FILTER (WHERE g = 1) AS t, avg(v) FILTER (WHERE g = 0) AS c, (var_samp(v) FILTER (WHERE g = 1) + var_samp(v) FILTER (WHERE g = 0)) / 2 AS p,
  count(*) FILTER (WHERE g = 1) AS tn, count(*) FILTER (WHERE g = 0) AS cn FROM long GROUP BY metric)
SELECT metric, round(t, 6) AS treated_mean, round(c, 6) AS control_mean, round((t - c) / sqrt(p), 6) AS standardized_mean_difference,
  round(abs(t - c) / sqrt(p), 6) AS absolute_standardized_mean_difference, tn AS treated_markets, cn AS control_markets FROM s"""
)
def preperiod_balance(spark: SparkSession, folder: str) -> DataFrame:
    return K.preperiod_balance(market_panel(spark, folder), ROLLOUT)


def rollout_sql(rows: str) -> str:
    """The weighted two-way estimate over ``rows`` (m: market, t: week, e: weight, y: outcome,
    d: term) as a table ``found``: both are demeaned by market and week in turn until that
    changes nothing, and the clusters' scores follow from what is left."""
    mean = lambda c, by: f"{c} - sum(e * {c}) OVER (PARTITION BY {by}) / sum(e) OVER (PARTITION BY {by})"
    return D.with_tables("panel").replace("WITH ", "WITH RECURSIVE ", 1) + f""", base AS ({rows}),
turns AS (
  SELECT 0 AS k, * FROM base
  UNION ALL SELECT k + 1, m, t, e, {mean("y", "t")}, {mean("d", "t")} FROM (SELECT k, m, t, e, {mean("y", "m")} AS y, {mean("d", "m")} AS d FROM turns WHERE k < 300)
), within AS (SELECT * FROM turns WHERE k = 300),
slope AS (SELECT sum(e * d * y) / sum(e * d * d) AS b, sum(e * d * d) AS dd, count(*) AS n, count(DISTINCT m) AS g, count(DISTINCT t) AS w FROM within),
scores AS (SELECT m, sum(e * d * (y - b * d)) AS s FROM within, slope GROUP BY m),
found AS (
  SELECT any_value(b) AS effect, any_value(n) AS observations,
    sqrt(any_value(g) / (any_value(g) - 1.0::DOUBLE) * (any_value(n) - 1) / (any_value(n) - any_value(g) - any_value(w)) * sum(s * s)) / any_value(dd) AS se FROM scores, slope
)"""


_ALL_ROWS = "SELECT market_id AS m, relative_week AS t, candidate_exposures::DOUBLE AS e, ctr AS y, policy_active::DOUBLE AS d FROM panel"
_BEFORE = "SELECT market_id AS m, relative_week AS t, candidate_exposures::DOUBLE AS e, ctr AS y, CASE WHEN treated_market = 1 AND relative_week >= -8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d FROM panel WHERE relative_week < 0"
_INTERVAL = f"round(effect - {_Z}::DOUBLE * se, 6) AS ci_lower, round(effect + {_Z}::DOUBLE * se, 6) AS ci_upper"


@query(
    rollout_sql(_ALL_ROWS)
    + f"""SELECT 'policy_active' AS term, round(effect, 6) AS effect, round(se, 6) AS standard_error, round(z, 6) AS statistic, round({tail_sql("z")}, 6) AS p_value, {_INTERVAL}, observations
FROM (SELECT *, effect / se AS z FROM found)"""
)
def did_fixed_effects(spark: SparkSession, folder: str) -> DataFrame:
    row = K.difference_in_differences(market_panel(spark, folder), ROLLOUT)
    keys = ("effect", "standard_error", "statistic", "p_value", "ci_lower", "ci_upper")
    return spark.createDataFrame([(row["term"], *(row[k] for k in keys), row["observations"])], "term string, " + ", ".join(f"{k} double" for k in keys) + ", observations bigint")


@query(
    D.with_tables("panel")
    + """, cells AS (SELECT treated_market AS g, CASE WHEN relative_week >= 0 THEN 1 ELSE 0 END AS post, sum(clicks)::DOUBLE / sum(candidate_exposures) AS rate FROM panel GROUP BY 1, 2)
SELECT round(sum(CASE WHEN g = post THEN rate ELSE -rate END), 6) AS effect, count(*) AS cells FROM cells"""
)
def did_two_by_two(spark: SparkSession, folder: str) -> DataFrame:
    """The exposure-weighted difference of differences of the four cells."""
    cells = market_panel(spark, folder).groupBy("treated_market", (F.col("relative_week") >= 0).cast("int").alias("post")).agg((F.sum("clicks") / F.sum("candidate_exposures")).alias("rate"))
    return cells.agg(F.sum(F.when(F.col("treated_market") == F.col("post"), F.col("rate")).otherwise(-F.col("rate"))).alias("effect"), F.count("*").alias("cells"))


#: Every market has its arm's weeks, so the effect of a week is the difference between two
#: regressions, one for each arm, in which the other weeks have an effect of their own. The
#: week's indicator is demeaned by market and by week, the week and the reference being one.
_EVENT = (
    D.with_tables("panel").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", base AS (SELECT market_id AS m, treated_market AS g, relative_week AS t, candidate_exposures::DOUBLE AS e, ctr AS y FROM panel WHERE relative_week BETWEEN -6 AND 5),
ys AS (
  SELECT 0 AS k, * FROM base
  UNION ALL SELECT k + 1, m, g, t, e, y - sum(e * y) OVER (PARTITION BY g, t) / sum(e) OVER (PARTITION BY g, t)
    FROM (SELECT k, m, g, t, e, y - sum(e * y) OVER (PARTITION BY m) / sum(e) OVER (PARTITION BY m) AS y FROM ys WHERE k < 300)
), xs AS (
  SELECT 0 AS k, w, m, g, t, CASE WHEN t = w THEN -1 ELSE t END AS f, e, CASE WHEN t = w THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM base, (SELECT DISTINCT t AS w FROM base WHERE t <> -1)
  UNION ALL SELECT k + 1, w, m, g, t, f, e, x - sum(e * x) OVER (PARTITION BY w, g, f) / sum(e) OVER (PARTITION BY w, g, f)
    FROM (SELECT k, w, m, g, t, f, e, x - sum(e * x) OVER (PARTITION BY w, m) / sum(e) OVER (PARTITION BY w, m) AS x FROM xs WHERE k < 300)
), joined AS (SELECT w, m, g, t, xs.e, x, base.y, ys.y AS r FROM xs JOIN base USING (m, g, t) JOIN ys USING (m, g, t) WHERE xs.k = 300 AND ys.k = 300),
slopes AS (SELECT w, g, sum(e * x * y) / sum(e * x * x) AS b, sum(e * x * x) AS xx FROM joined GROUP BY w, g),
scores AS (SELECT w, g, m, sum(e * x * r) AS s FROM joined GROUP BY ALL),
size AS (SELECT count(*) AS n, count(DISTINCT m) AS g, 2 * count(DISTINCT t) - 2 AS k FROM base),
found AS (
  SELECT w, any_value(effect) AS effect, sqrt(any_value(c) * sum((s / xx) ** 2)) AS se
  FROM scores JOIN slopes USING (w, g) JOIN (SELECT w, sum(CASE WHEN g = 1 THEN b ELSE -b END) AS effect FROM slopes GROUP BY w) USING (w),
    (SELECT g / (g - 1.0::DOUBLE) * (n - 1) / (n - g - k) AS c FROM size)
  GROUP BY w
)"""
)


@query(
    _EVENT
    + f"""SELECT CAST(w AS INTEGER) AS relative_week, 'event_' || CASE WHEN w < 0 THEN 'm' ELSE 'p' END || abs(w) AS term, round(effect, 6) AS effect, round(se, 6) AS standard_error,
  round(z, 6) AS statistic, round({tail_sql("z")}, 6) AS p_value, {_INTERVAL} FROM (SELECT *, effect / se AS z FROM found)"""
)
def event_study(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = K.event_study(market_panel(spark, folder), ROLLOUT)
    keys = ("effect", "standard_error", "statistic", "p_value", "ci_lower", "ci_upper")
    return spark.createDataFrame([(r["relative_week"], r["term"], *(r[k] for k in keys)) for r in rows], "relative_week int, term string, " + ", ".join(f"{k} double" for k in keys))


@query()
def pretrend_test(spark: SparkSession, folder: str) -> DataFrame:
    """The joint test of the leads: a matrix inverse, which tests hold against published values."""
    _, test = K.event_study(market_panel(spark, folder), ROLLOUT)
    return spark.createDataFrame([(test["statistic"], test["degrees_of_freedom"], test["p_value"], test["passed"])], "statistic double, degrees_of_freedom int, p_value double, passed boolean")


@query(
    rollout_sql(_ALL_ROWS)
    + f"""SELECT CAST(1000000 AS BIGINT) AS scale_exposures, round(1000000 * effect, 2) AS incremental_clicks, round(1000000 * (effect - {_Z}::DOUBLE * se), 2) AS ci_lower_clicks, round(1000000 * (effect + {_Z}::DOUBLE * se), 2) AS ci_upper_clicks FROM found"""
)
def rollout_impact(spark: SparkSession, folder: str) -> DataFrame:
    found = K.business_impact(K.difference_in_differences(market_panel(spark, folder), ROLLOUT), ROLLOUT)
    clicks = ("incremental_clicks", "ci_lower_clicks", "ci_upper_clicks")
    rows = spark.createDataFrame([(found["scale_exposures"], *(found[k] for k in clicks))], "scale_exposures bigint, " + ", ".join(f"{k} double" for k in clicks))
    return rows.select("scale_exposures", *[F.round(k, 2).alias(k) for k in clicks])


@query()
def rollout_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Needs the joint test of the leads, see ``pretrend_test``."""
    return spark.createDataFrame([(K.evaluate_causal_decision(K.analyze_panel(market_panel(spark, folder), ROLLOUT), ROLLOUT).value,)], "status string")


@query(
    rollout_sql(_BEFORE)
    + f"""SELECT round(effect, 6) AS effect, round(se, 6) AS standard_error, {_INTERVAL}, effect - {_Z}::DOUBLE * se <= 0 AND effect + {_Z}::DOUBLE * se >= 0 AS passed FROM found"""
)
def placebo_rollout(spark: SparkSession, folder: str) -> DataFrame:
    row, test = K.placebo(market_panel(spark, folder), ROLLOUT)
    return spark.createDataFrame([(row["effect"], row["standard_error"], row["ci_lower"], row["ci_upper"], test["passed"])], "effect double, standard_error double, ci_lower double, ci_upper double, passed boolean")


def fitted_features(spark: SparkSession, folder: str, names: list[str] = E.NAMES) -> tuple[E.FeatureBuilder, DataFrame, DataFrame]:
    rows = logged(spark, folder)
    train, valid = C.temporal_split(rows, valid_fraction=0.2)
    return E.FeatureBuilder(n_components=8, semantic=not set(names).isdisjoint(E.GROUPS["semantic"]), names=list(names)).fit(D.articles(spark, folder), D.history(spark, folder, rows), train), train, valid


_STRUCTURED = [n for g in ("context", "article", "personalization") for n in E.GROUPS[g]]


@query(
    SPLIT
    + """, cutoff AS (SELECT max(impression_time) AS t FROM train),
codes AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM articles, cutoff WHERE published_time <= t)),
seen AS (SELECT user_id, unnest(article_id_fixed) AS article_id FROM history),
known AS (SELECT user_id, category FROM seen JOIN articles USING (article_id)),
lengths AS (SELECT user_id, count(*)::DOUBLE AS n FROM known GROUP BY user_id),
liked AS (SELECT user_id, category, count(*)::DOUBLE AS c FROM known GROUP BY ALL),
base AS (
  SELECT v.*, a.*, coalesce(code, -1) AS code, coalesce(n, 0) AS n, coalesce(c, 0) AS c,
    greatest((epoch_us(impression_time) - epoch_us(published_time))::DOUBLE / 3600000000.0::DOUBLE, 0) AS age
  FROM valid v JOIN articles a USING (article_id) LEFT JOIN codes ON codes.category = a.category
  LEFT JOIN lengths ON lengths.user_id = v.user_id LEFT JOIN liked ON liked.user_id = v.user_id AND liked.category = a.category
)
SELECT impression_id, article_id, round(sin(2 * pi() * hour(impression_time) / 24), 6) + 0.0::DOUBLE AS hour_sin, round(cos(2 * pi() * hour(impression_time) / 24), 6) + 0.0::DOUBLE AS hour_cos,
  round(sin(2 * pi() * (isodow(impression_time) - 1) / 7), 6) + 0.0::DOUBLE AS weekday_sin, round(cos(2 * pi() * (isodow(impression_time) - 1) / 7), 6) + 0.0::DOUBLE AS weekday_cos,
  0.0::DOUBLE AS device_type, 0.0::DOUBLE AS is_sso_user, 0.0::DOUBLE AS is_subscriber, candidate_position::DOUBLE AS candidate_position, candidate_count::DOUBLE AS candidate_count,
  round(age, 6) AS publication_age_hours, round(ln(1 + age), 6) AS freshness_log_hours, length(title)::DOUBLE AS title_length, length(subtitle)::DOUBLE AS subtitle_length,
  CASE WHEN premium THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS premium, code::DOUBLE AS category_code, 0.0::DOUBLE AS article_type_code, 0.0::DOUBLE AS sentiment_score,
  n AS history_length, round(CASE WHEN n > 0 THEN c / n ELSE 0 END, 6) AS category_affinity
FROM base"""
)
def structured_features(spark: SparkSession, folder: str) -> DataFrame:
    builder, _, valid = fitted_features(spark, folder, _STRUCTURED)
    return builder.transform(valid).select("impression_id", "article_id", *_STRUCTURED)


_SPOILT = """, spoilt AS (
  SELECT * EXCLUDE (device_type), CASE WHEN impression_id % 11 <> 0 THEN (impression_id % 7)::DOUBLE END AS device, CASE WHEN impression_id % 13 <> 0 THEN impression_id % 3 = 0 END AS sso,
    CASE impression_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN '1' ELSE 'maybe' END AS subscriber, (CASE WHEN article_id % 17 <> 0 THEN article_id % 100 END)::DOUBLE / 100 AS sentiment FROM candidates
), raw AS (
  SELECT impression_id, article_id, impression_time, device AS device_type, CASE WHEN sso THEN 1.0::DOUBLE WHEN NOT sso THEN 0.0::DOUBLE END AS is_sso_user,
    CASE WHEN lower(trim(subscriber)) IN ('yes', '1') THEN 1.0::DOUBLE WHEN lower(trim(subscriber)) = 'no' THEN 0.0::DOUBLE END AS is_subscriber, sentiment AS sentiment_score,
    length(title)::DOUBLE AS title_length, candidate_position::DOUBLE AS candidate_position, greatest((epoch_us(impression_time) - epoch_us(published_time))::DOUBLE / 3600000000.0::DOUBLE, 0) AS publication_age_hours
  FROM spoilt JOIN articles USING (article_id)
)"""

_FILLED = ["device_type", "is_sso_user", "is_subscriber", "sentiment_score", "title_length", "candidate_position", "publication_age_hours"]


def spoilt_features(spark: SparkSession, folder: str) -> tuple[E.FeatureBuilder, DataFrame]:
    """Features of a log whose device, flags and sentiment are partly missing or words."""
    rows = logged(spark, folder)
    key = F.col("impression_id") % 4
    spoilt = rows.withColumns(
        {
            "device_type": F.when(F.col("impression_id") % 11 != 0, (F.col("impression_id") % 7).cast("string")),
            "is_sso_user": F.when(F.col("impression_id") % 13 != 0, F.col("impression_id") % 3 == 0),
            "is_subscriber": F.when(key == 0, "Yes").when(key == 1, " no ").when(key == 2, "1").otherwise("maybe"),
        }
    )
    articles = D.articles(spark, folder).withColumn("sentiment_score", F.when(F.col("article_id") % 17 != 0, (F.col("article_id") % 100) / 100.0))
    train, valid = C.temporal_split(spoilt, valid_fraction=0.2)
    return E.FeatureBuilder(n_components=8, semantic=False).fit(articles, D.history(spark, folder, rows), train), valid


@query(
    SPLIT
    + _SPOILT
    + """, medians AS (SELECT """
    + ", ".join(f"median({c}) AS m_{c}" for c in _FILLED)
    + """ FROM raw, cut WHERE impression_time < t)
SELECT impression_id, article_id, """
    + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in _FILLED)
    + """ FROM raw, cut, medians WHERE impression_time >= t"""
)
def imputed_features(spark: SparkSession, folder: str) -> DataFrame:
    """Missing values filled by the medians of the training rows."""
    builder, valid = spoilt_features(spark, folder)
    return builder.transform(valid).select("impression_id", "article_id", *_FILLED)


@query(
    SPLIT
    + _SPOILT
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(median({c}), 6) AS median FROM raw, cut WHERE impression_time < t" for c in _FILLED)
)
def training_medians(spark: SparkSession, folder: str) -> DataFrame:
    builder, _ = spoilt_features(spark, folder)
    return spark.createDataFrame([(c, float(builder.medians[c])) for c in _FILLED], "feature string, median double")


@query()
def semantic_features(spark: SparkSession, folder: str) -> DataFrame:
    """The text similarities come from an iterated factorization, which SQL cannot say."""
    builder, _, valid = fitted_features(spark, folder, E.GROUPS["semantic"])
    return builder.transform(valid).select("impression_id", "article_id", *E.GROUPS["semantic"])


_TERMS = """, cut_off AS (SELECT max(impression_time) AS last FROM train),
visible AS (SELECT article_id FROM articles, cut_off WHERE published_time <= last),
texts AS (SELECT article_id, lower(coalesce(nullif(trim(coalesce(title, '') || ' ' || coalesce(subtitle, '')), ''), 'missing text')) AS text FROM articles),
words AS (SELECT article_id, regexp_extract_all(strip_accents(text), '\\b\\w\\w+\\b') AS w FROM texts),
pieces AS (SELECT article_id, unnest(regexp_extract_all(text, '\\S+')) AS w FROM texts),
terms AS (
  SELECT article_id, 'word' AS block, unnest(w) AS term FROM words
  UNION ALL SELECT article_id, 'word', w[i] || ' ' || w[i + 1] FROM (SELECT article_id, w, unnest(range(1, len(w))) AS i FROM words)
  UNION ALL SELECT article_id, 'char', substr(p, i, n) FROM (SELECT article_id, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM (SELECT article_id, ' ' || w || ' ' AS p, unnest([3, 4, 5]) AS n FROM pieces) WHERE length(p) >= n)
), counts AS (SELECT article_id, block, term, count(*) AS n FROM terms GROUP BY ALL),
totals AS (SELECT block, term, sum(n) AS n, count(*) AS df FROM counts JOIN visible USING (article_id) GROUP BY ALL),
kept AS (
  SELECT block, term, ln((1.0::DOUBLE + (SELECT count(*) FROM visible)) / (1.0::DOUBLE + df)) + 1 AS idf
  FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY n DESC, term) AS r FROM totals) WHERE r <= 12000
), weighed AS (SELECT article_id, block, term, (1 + ln(counts.n::DOUBLE)) * idf AS w FROM counts JOIN kept USING (block, term))
SELECT article_id, block, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY article_id, block)), 6) AS weight FROM weighed"""


@query(SPLIT + _TERMS)
def tfidf_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The weights of word and character terms, by the vocabulary of the visible articles."""
    train, _ = C.temporal_split(logged(spark, folder), valid_fraction=0.2)
    articles = D.articles(spark, folder)
    last = train.agg(F.max("impression_time")).first()[0]
    return E.tfidf_table(articles, articles.where(F.col("published_time") <= F.lit(last).cast("timestamp_ntz")))


@query()
def logistic_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """Five logistic models on sets of features, fitted in the same passes."""
    builder, train, valid = fitted_features(spark, folder)
    return R.ablations(M.fit_logistics(builder.transform(train), ABLATIONS), stored(builder.transform(valid)))


@query()
def logistic_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """A trained model; tests hold it against published quality."""
    builder, train, valid = fitted_features(spark, folder)
    model = M.fit_logistic(builder.transform(train), E.NAMES)
    return R.ranking_metrics(model.score(builder.transform(valid)))


@query()
def lambda_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees, which SQL cannot say; tests hold them against a plain learner, and their
    quality against the published one."""
    builder, train, valid = fitted_features(spark, folder, _STRUCTURED)
    model = M.fit_lambda_trees(builder.transform(train), _STRUCTURED, trees=40)
    return R.ranking_metrics(model.score(builder.transform(valid)))
