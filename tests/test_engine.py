"""The operators over ranking logs, experiments and panels: hand-computed values, contract
errors, published results of seeded inputs, and the jobs end to end."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.errors import ContractError
from tidemark.functions import stats
from tidemark.operators import analytics, candidates as C, causal as K, experiments as X, features as E, models as M, ranking as R
from tidemark.plans import reports, workflows
from tidemark.sources import files, synthetic
from tidemark.sources.bundle import load_bundle
from tidemark.streaming.kpis import windowed_kpis

ARTICLES = "article_id bigint, title string, subtitle string, published_time timestamp_ntz, category int, premium boolean"
BEHAVIORS = "impression_id bigint, user_id bigint, impression_time timestamp_ntz, article_ids_inview array<bigint>, article_ids_clicked array<bigint>, device_type int"

EXPERIMENT = {
    "alpha": 0.05, "control_label": "control", "treatment_label": "treatment", "cuped_covariate": "pre_ctr", "expected_allocation": {"control": 0.5, "treatment": 0.5},
    "guardrails": [
        {"name": "dwell_seconds", "kind": "continuous", "direction": "non_decrease", "non_inferiority_margin": -2.0},
        {"name": "latency_ms", "kind": "continuous", "direction": "non_increase", "non_inferiority_margin": 8.0},
    ],
    "minimum_segment_units": 200, "practical_threshold": 0.008, "pre_treatment_columns": ["pre_ctr"], "primary": {"name": "click", "kind": "binary", "direction": "increase"},
    "segment_columns": ["device_type", "history_segment"], "unit_column": "user_id", "variant_column": "variant",
}

ROLLOUT = {
    "unit_column": "market_id", "time_column": "relative_week", "group_column": "treated_market", "active_column": "policy_active", "exposure_column": "candidate_exposures",
    "click_column": "clicks", "outcome_column": "ctr", "outcome_kind": "rate", "rollout_week": 0, "reference_week": -1, "placebo_week": -8, "event_window": [-12, 8],
    "balance_columns": ["market_size_index", "candidate_exposures", "ctr"], "alpha": 0.05, "practical_threshold": 0.002, "business_exposure_scale": 1000000, "minimum_markets": 20,
    "minimum_treated_markets": 8, "minimum_control_markets": 8, "minimum_pre_weeks": 8, "minimum_post_weeks": 4, "maximum_missing_market_week_share": 0.0,
}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    return synthetic.write_bundle(spark, str(tmp_path_factory.mktemp("bundle") / "data"))


@pytest.fixture
def small(spark):
    at = lambda h, d=1: datetime(2026, 1, d, h)
    articles = spark.createDataFrame([(10 + k, f"t{k}", None, at(8 + k), k + 1, k == 1) for k in range(3)], ARTICLES)
    rows = [(100, 1, at(8, 2), [10, 11], [10], 1), (101, 2, at(9, 2), [11, 12], [12], 2), (102, 1, at(10, 2), [10, 12], [12], 1)]
    history = spark.createDataFrame([(1, [10, 12]), (2, [])], "user_id bigint, article_id_fixed array<bigint>")
    return articles, spark.createDataFrame(rows, BEHAVIORS), history


def scored(spark, labels, scores, groups):
    place = {}
    rows = []
    for y, s, g in zip(labels, scores, groups):
        place[g] = place.get(g, -1) + 1
        rows.append((g, place[g], y, s))
    return spark.createDataFrame(rows, "impression_id string, candidate_position int, label int, score double")


# Candidates ---------------------------------------------------------------------------


def test_expansion_keeps_slates_apart(small):
    rows = C.expand_candidates(small[1]).orderBy("impression_id", "candidate_position").select("impression_id", "article_id", "label", "candidate_position", "candidate_count").collect()
    assert [tuple(r) for r in rows] == [(100, 10, 1, 0, 2), (100, 11, 0, 1, 2), (101, 11, 0, 0, 2), (101, 12, 1, 1, 2), (102, 10, 0, 0, 2), (102, 12, 1, 1, 2)]


def test_audit(small, spark):
    articles, behaviors, history = small
    assert C.audit(behaviors, articles, history)["candidates"] == 6
    cases = [
        (behaviors.withColumn("article_ids_clicked", F.array(F.lit(12).cast("bigint"))), articles, "not present in article_ids_inview"),
        (behaviors, articles.drop("title"), "articles is missing required columns: title"),
        (behaviors, articles.withColumn("published_time", F.lit("2026-01-03").cast("timestamp_ntz")), "published after impression"),
        (behaviors.union(behaviors), articles, "duplicate impression"),
        (behaviors.limit(0), articles, "must not be empty"),
    ]
    for b, a, message in cases:
        with pytest.raises(ContractError, match=message):
            C.audit(b, a, history)


def test_temporal_split(small):
    train, valid = C.temporal_split(C.expand_candidates(small[1]), valid_fraction=0.5)
    assert {r[0] for r in train.select("impression_id").collect()} == {100} and {r[0] for r in valid.select("impression_id").collect()} == {101, 102}
    with pytest.raises(ContractError):
        C.temporal_split(C.expand_candidates(small[1].limit(1)))


def test_scoring_rows_reject_bad_slates(small):
    assert C.expand_scoring_candidates(small[1].drop("article_ids_clicked")).count() == 6
    with pytest.raises(ContractError):
        C.expand_scoring_candidates(small[1].limit(0))


# Metrics ------------------------------------------------------------------------------


def test_hand_computed_metrics(spark):
    got = R.ranking_metrics(scored(spark, [1, 0, 0, 0, 1, 0], [0.9, 0.8, 0.1, 0.9, 0.8, 0.1], "aaabbb")).first()
    want = (1 + 1 / np.log2(3)) / 2
    assert got["mrr"] == 0.75 and got["group_auc"] == 0.75 and got["groups"] == 2
    assert got["ndcg@5"] == pytest.approx(want) and got["ndcg@10"] == pytest.approx(want)


def test_impressions_of_one_class(spark):
    got = R.ranking_metrics(scored(spark, [1, 0, 0, 0], [0.8, 0.2, 0.7, 0.1], "aabb")).first()
    assert (got["group_auc"], got["auc_groups"], got["skipped_auc_groups"], got["mrr"]) == (1.0, 1, 1, 0.5)
    got = R.ranking_metrics(scored(spark, [0, 0, 1, 1], [0.8, 0.2, 0.7, 0.1], "aabb")).first()
    assert got["group_auc"] is None and got["skipped_auc_groups"] == 2


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(0)
    groups = rng.integers(0, 12, 150).astype(str).tolist()
    labels, scores = rng.integers(0, 2, 150).tolist(), rng.integers(0, 5, 150).astype(float).tolist()
    df = scored(spark, labels, scores, groups)
    for r in R.per_impression(df).collect():
        own = [(y, s) for y, s, g in zip(labels, scores, groups) if g == r["impression_id"]]
        up, down = [s for y, s in own if y], [s for y, s in own if not y]
        auc = np.mean([(a > b) + (a == b) / 2 for a in up for b in down]) if up and down else None
        assert r["auc"] == (None if auc is None else pytest.approx(auc))
        order = sorted(range(len(own)), key=lambda k: -own[k][1])
        ranks = [k + 1 for k, i in enumerate(order) if own[i][0]]
        assert r["rr"] == pytest.approx(1 / ranks[0] if ranks else 0)
        ideal = sum(1 / np.log2(k + 1) for k in range(1, min(5, len(ranks)) + 1))
        assert r["ndcg@5"] == pytest.approx(sum(1 / np.log2(k + 1) for k in ranks if k <= 5) / ideal if ranks else 0)


def test_popularity_and_top_k(spark):
    train = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 0)], "article_id bigint, label int")
    rows = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 999)], "impression_id bigint, candidate_position int, article_id bigint")
    got = R.predict_baseline(R.fit_baseline("popularity", train, alpha=2.0), rows)
    by = {r["article_id"]: r["score"] for r in got.collect()}
    assert by[1] > by[999] == 0.5 > by[2]
    assert [r["article_id"] for r in R.rank_candidates(got, top_k=2).orderBy("rank").collect()] == [1, 999]
    with pytest.raises(ValueError):
        R.rank_candidates(got, top_k=0)


def test_bad_rows_stop_the_job(spark, small):
    """Labels, scores, slates, catalogues and segments that break the contract are errors."""
    from pyspark.errors import PySparkException

    good = scored(spark, [1, 0, 1, 0], [0.9, 0.1, 0.8, 0.2], "aabb")
    for bad in (good.withColumn("label", F.lit(2)), good.withColumn("score", F.lit(float("nan"))), good.withColumn("score", F.lit(None).cast("double"))):
        with pytest.raises(PySparkException):
            R.ranking_metrics(bad).collect()
    articles, behaviors, history = small
    with pytest.raises(PySparkException):
        C.expand_candidates(behaviors.withColumn("article_ids_inview", F.lit(None).cast("array<bigint>"))).collect()
    with pytest.raises(PySparkException):
        C.analytics_candidates(C.expand_candidates(behaviors), articles.union(articles), history).collect()
    changing = good.withColumns({"device_type": F.col("candidate_position"), "candidate_count": F.lit(2), "history_length": F.lit(0)})
    with pytest.raises(PySparkException):
        R.segment_ranking_metrics(changing).collect()
    with pytest.raises(ValueError):
        R.bootstrap_replicates(R.per_impression(good.withColumn("model", F.lit("m"))), how="other")


def test_bootstrap_is_paired_and_repeatable(spark):
    good = scored(spark, [1, 0, 1, 0, 0, 1], [0.9, 0.1, 0.8, 0.2, 0.1, 0.9], "aabbcc").withColumn("model", F.lit("good"))
    per = R.per_impression(good.union(good.withColumn("score", -F.col("score")).withColumn("model", F.lit("bad"))))
    for how in ("numpy", "poisson"):
        rows = {(r["model"], r["metric"]): r for r in R.bootstrap_intervals(per, samples=25, seed=7, how=how).collect()}
        again = {(r["model"], r["metric"]): r for r in R.bootstrap_intervals(per, samples=25, seed=7, how=how).collect()}
        assert rows == again
        for m in R.METRICS:
            assert rows["good", m]["mean"] > rows["bad", m]["mean"]


# Features -----------------------------------------------------------------------------


def test_features_do_not_leak(small):
    articles, behaviors, history = small
    rows = C.expand_candidates(behaviors)
    builder = E.FeatureBuilder(2).fit(articles, history, rows)
    got = {(r["impression_id"], r["article_id"]): r for r in builder.transform(rows).collect()}
    assert got[100, 10]["history_length"] == 2 and got[100, 10]["category_affinity"] == 0.5 and got[101, 11]["text_similarity"] == 0
    assert got[100, 10]["publication_age_hours"] == 24.0 and got[100, 10]["subtitle_length"] == 0
    plain = {(r["impression_id"], r["article_id"]): r for r in E.FeatureBuilder(2, semantic=False).fit(articles, history, rows).transform(rows).collect()}
    for key, row in got.items():
        assert all(plain[key][n] == (0.0 if n in E.GROUPS["semantic"] else row[n]) for n in E.NAMES)
    assert builder.medians["candidate_count"] == 2
    with pytest.raises(ContractError, match="999"):
        builder.transform(rows.withColumn("article_id", F.lit(999).cast("bigint")))
    with pytest.raises(ValueError):
        E.select_feature_names(include_groups=["other"])


# Statistics ---------------------------------------------------------------------------


def test_distributions():
    assert stats.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert stats.chi_square_tail(8.8974521498, 11) == pytest.approx(0.6313575012, abs=1e-9)
    assert stats.chi_square_tail(0.7688, 1) == pytest.approx(0.3805885381012786)


def test_published_experiment(spark, tmp_path):
    path = synthetic.write_experiment(spark, str(tmp_path / "units.parquet"))
    with pytest.raises(ValueError, match="already exists"):
        synthetic.write_experiment(spark, path)
    with pytest.raises(ValueError, match="licensed-ebnerd"):
        workflows.run_experiment(spark, path, str(tmp_path / "none"), json.dumps(EXPERIMENT), tiers=[reports.EvidenceTier.LICENSED_EBNERD])
    decision = workflows.run_experiment(spark, path, str(tmp_path / "out"), json.dumps(EXPERIMENT), tiers=[reports.EvidenceTier.LICENSED_EBNERD, reports.EvidenceTier.SYNTHETIC_RCT])
    assert decision.status is X.Decision.LAUNCH
    assert decision.primary.effect == pytest.approx(0.0205157631, abs=1e-9) and decision.primary.theta == pytest.approx(0.9567299496, abs=1e-9)
    lines = (tmp_path / "out" / "effects.csv").read_text().splitlines()
    assert lines[1].startswith("click,binary,10062,9938,0.1216457961,0.1418796539,0.0202338578,0.1663342133,0.0047824887,0.0108603522,0.0296073633,0.0000232839")
    assert json.loads((tmp_path / "out" / "srm.json").read_text())["p_value"] == pytest.approx(0.3805885381012786)
    with pytest.raises(ValueError, match="already exists"):
        workflows.run_experiment(spark, path, str(tmp_path / "out"), json.dumps(EXPERIMENT))


def test_published_rollout(spark, tmp_path):
    path = synthetic.write_panel(spark, str(tmp_path / "panel.parquet"))
    decision = workflows.run_causal_impact(spark, path, str(tmp_path / "out"), json.dumps(ROLLOUT))
    assert decision is K.CausalDecision.SUPPORTS_INCREMENTAL_IMPACT
    did = (tmp_path / "out" / "did_estimate.csv").read_text().splitlines()[1]
    assert did.startswith("policy_active,0.0061232416,0.0002727595,22.4492300884,0.0000000000,0.0055886428,0.0066578405")
    found = json.loads((tmp_path / "out" / "diagnostics.json").read_text())
    assert found["parallel_trends"]["p_value"] == pytest.approx(0.6313575012, abs=1e-8) and found["integrity"]["total_exposure"] == 27886511
    assert (tmp_path / "out" / "placebo_estimate.csv").read_text().splitlines()[1].startswith("placebo_policy_active,-0.0001151303,0.0003333506")
    bad = spark.read.parquet(path).withColumn("clicks", F.col("clicks") + 1)
    with pytest.raises(ValueError):
        K.validate_market_panel(bad, K.CausalConfig.from_json(json.dumps(ROLLOUT)))


PANEL_ERRORS = {
    "no column": lambda d: d.drop("ctr"),
    "text": lambda d: d.withColumn("clicks", F.lit("x")),
    "no rows": lambda d: d.limit(0),
    "null market": lambda d: d.withColumn("market_id", F.when(F.col("relative_week") != 0, F.col("market_id"))),
    "repeated week": lambda d: d.union(d.limit(1)),
    "not finite": lambda d: d.withColumn("ctr", F.when(F.col("relative_week") == 3, F.lit(float("nan"))).otherwise(F.col("ctr"))),
    "half week": lambda d: d.withColumn("relative_week", F.col("relative_week") + 0.5),
    "one arm": lambda d: d.where("treated_market = 1"),
    "changes arm": lambda d: d.withColumn("treated_market", F.when(F.col("relative_week") == 3, 1 - F.col("treated_market")).otherwise(F.col("treated_market"))),
    "too early": lambda d: d.withColumn("policy_active", F.col("treated_market")),
    "no exposure": lambda d: d.withColumn("candidate_exposures", F.lit(0)),
    "clicks over exposures": lambda d: d.withColumn("clicks", F.col("candidate_exposures") + 1),
    "wrong rate": lambda d: d.withColumn("ctr", F.col("ctr") / 2),
    "few markets": lambda d: d.where("market_id < 'market_011'"),
    "few weeks before": lambda d: d.where("relative_week >= -3"),
    "few weeks after": lambda d: d.where("relative_week < 2"),
    "missing week": lambda d: d.where("NOT (relative_week = 3 AND market_id = 'market_001')"),
}


@pytest.fixture(scope="module")
def market_panel(spark):
    return spark.createDataFrame(synthetic.panel_rows(42, 60, 20, 12), synthetic.PANEL_SCHEMA).coalesce(1).persist()


@pytest.mark.parametrize("name", sorted(PANEL_ERRORS))
def test_broken_panels_are_refused(market_panel, name):
    with pytest.raises(ValueError):
        K.validate_market_panel(PANEL_ERRORS[name](market_panel), K.CausalConfig.from_json(json.dumps(ROLLOUT)))


UNIT_ERRORS = {
    "no column": lambda d: d.drop("click"),
    "text": lambda d: d.withColumn("click", F.lit("x")),
    "no rows": lambda d: d.limit(0),
    "null unit": lambda d: d.withColumn("user_id", F.when(F.col("user_id") != 3, F.col("user_id"))),
    "repeated unit": lambda d: d.union(d.limit(1)),
    "null arm": lambda d: d.withColumn("variant", F.when(F.col("user_id") != 3, F.col("variant"))),
    "third arm": lambda d: d.withColumn("variant", F.when(F.col("user_id") == 3, "other").otherwise(F.col("variant"))),
    "one arm": lambda d: d.where("variant = 'control'"),
    "not finite": lambda d: d.withColumn("latency_ms", F.lit(float("inf"))),
    "not binary": lambda d: d.withColumn("click", F.lit(2)),
    "null segment": lambda d: d.withColumn("device_type", F.lit(None).cast("string")),
}


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(synthetic.experiment_rows(42, 300, 0.5), synthetic.EXPERIMENT_SCHEMA).coalesce(1).persist()


@pytest.mark.parametrize("name", sorted(UNIT_ERRORS))
def test_broken_experiments_are_refused(units, name):
    with pytest.raises(ValueError):
        X.validate_experiment(UNIT_ERRORS[name](units), X.ExperimentConfig.from_json(json.dumps(EXPERIMENT)))


@pytest.mark.parametrize(
    "change",
    [{"alpha": 1.5}, {"minimum_markets": 3}, {"event_window": [0, 8]}, {"placebo_week": 0}, {"reference_week": 0}, {"balance_columns": []}, {"outcome_kind": "count"}, {"click_column": "ctr"}, {"maximum_missing_market_week_share": 1.0}],
)
def test_broken_rollout_configurations_are_refused(change):
    with pytest.raises(ValueError):
        K.CausalConfig.from_json(json.dumps(ROLLOUT | change)).check()


@pytest.mark.parametrize(
    "change",
    [{"alpha": 0}, {"expected_allocation": {"control": 0.5, "treatment": 0.6}}, {"control_label": "treatment"}, {"cuped_covariate": "other"}, {"minimum_segment_units": 1}, {"confirmatory_segments": ["other"]}, {"practical_threshold": -1}],
)
def test_broken_experiment_configurations_are_refused(change):
    with pytest.raises(ValueError):
        X.ExperimentConfig.from_json(json.dumps(EXPERIMENT | change))


def test_decisions():
    judge = lambda **k: X.evaluate_decision(**({"srm_passed": True, "primary_lower": 0.01, "primary_upper": 0.02, "practical_threshold": 0.005, "guardrail_states": ["pass"]} | k))
    assert judge() is X.Decision.LAUNCH
    assert judge(srm_passed=False) is X.Decision.INVALID_EXPERIMENT
    assert judge(guardrail_states=["fail"]) is X.Decision.DO_NOT_LAUNCH
    assert judge(primary_lower=-0.02, primary_upper=-0.01) is X.Decision.DO_NOT_LAUNCH
    assert judge(guardrail_states=["inconclusive"]) is X.Decision.CONTINUE_EXPERIMENT
    assert judge(primary_lower=0.001) is X.Decision.CONTINUE_EXPERIMENT


def test_models_learn_a_toy(spark, tmp_path):
    rows = [(i, p, int(p == i % 3), float(p == i % 3) + 0.01 * p, float(i)) for i in range(40) for p in range(3)]
    df = spark.createDataFrame(rows, "impression_id bigint, candidate_position int, label int, useful double, idle double")
    model = M.fit_lambda_trees(df, ["useful", "idle"], trees=2)
    assert R.ranking_metrics(model.score(df)).first()["mrr"] == 1.0 and model.importance()[0][0] == "useful"
    logistic = M.fit_logistic(df, ["useful", "idle"])
    assert R.ranking_metrics(logistic.score(df)).first()["mrr"] == 1.0
    with pytest.raises(ValueError, match="both classes"):
        M.fit_logistic(df.where("label = 1"), ["useful"])


# Jobs ---------------------------------------------------------------------------------


def test_published_analytics(spark, data, tmp_path):
    tables = workflows.run_analytics(spark, data, str(tmp_path / "out"))
    kpis = tables["kpi_summary"][0]
    assert (kpis["impressions"], kpis["candidates"], kpis["clicks"], kpis["active_users"]) == (36, 216, 36, 30)
    position = {r["value"]: r["clicks"] for r in tables["segment_kpis"] if r["segment"] == "candidate_position"}
    assert [position[str(k)] for k in range(6)] == [8, 9, 10, 2, 1, 6] and len(tables["segment_kpis"]) == 12
    assert tables["user_cohorts"] == []
    rows = C.analytics_candidates(*(lambda b: (C.expand_candidates(b.behaviors), b.articles, b.history))(load_bundle(spark, data, split="validation")))
    broken = rows.withColumn("label", F.when((F.col("candidate_position") == 0) & (F.col("impression_id") == F.lit(rows.agg(F.min("impression_id")).first()[0])), 2).otherwise(F.col("label")))
    assert {r["metric"]: r["numeric_value"] for r in analytics.data_quality(broken).collect()}["invalid_label_rows"] == 1


def test_published_benchmark(spark, data, tmp_path):
    board = {r["model"]: r for r in workflows.run_benchmark(spark, data, str(tmp_path / "out"), models=["position", "popularity", "logistic"])}
    want = {"position": (0.6166666667, 0.4870370370, 0.5535159363, 0.6128838008), "popularity": (0.5555555556, 0.4472222222, 0.5414178616, 0.5809964379)}
    for model, values in want.items():
        assert [board[model][m] for m in R.METRICS] == pytest.approx(values, abs=1e-9)
    assert board["logistic"]["ndcg@10"] == pytest.approx(0.7399718911, abs=0.03)
    lines = (tmp_path / "out" / "confidence_intervals.csv").read_text()
    assert "position,ndcg@10,0.6123757306,0.5479198416,0.6791033083" in lines and "popularity,ndcg@10,0.5765286961,0.5088963598,0.6514905709" in lines
    ablations = (tmp_path / "out" / "ablations.csv").read_text().splitlines()
    assert [x.split(",")[0] for x in ablations[1:]] == list(workflows.ABLATIONS)


def test_command_line(spark, data, tmp_path, capsys):
    def run(*args):
        code = cli.main([str(a) for a in args], spark)
        out = capsys.readouterr()
        return code, json.loads(out.out) if code == 0 else out.err

    assert run("audit", "--data", data)[1]["impressions"] == 144
    assert run("train", "--data", data, "--output", tmp_path / "model")[1]["ndcg@10"] == pytest.approx(0.74, abs=0.03)
    code, found = run("rank", "--model", tmp_path / "model" / "model", "--candidates", f"{data}/validation/behaviors.parquet", "--output", tmp_path / "ranked", "--top-k", 2)
    assert code == 0 and found["rows"] == 72 and found["impressions"] == 36
    assert run("experiment-design", "--baseline-rate", 0.1, "--relative-mde", 0.1)[1]["units_per_arm"] > 10_000
    code, error = run("audit", "--data", tmp_path / "nothing")
    assert code == 2 and "missing dataset files" in error
    assert run("analyze", "--data", data, "--output", tmp_path / "analytics")[0] == 0
    run("make-experiment", "--output", tmp_path / "units.parquet", "--users", 3000)
    (tmp_path / "config.json").write_text(json.dumps(EXPERIMENT))
    assert run("experiment", "--input", tmp_path / "units.parquet", "--output", tmp_path / "decision", "--config", tmp_path / "config.json")[0] == 0
    assert len(run("portfolio", "--analytics", tmp_path / "analytics", "--experiment", tmp_path / "decision", "--output", tmp_path / "both")[1]["files"]) == 15


def test_streamed_key_figures_equal_the_batch(spark, data, tmp_path):
    path = f"{data}/train/behaviors.parquet"
    behaviors = spark.read.parquet(path)
    stream = windowed_kpis(spark.readStream.schema(behaviors.schema).parquet(path), window="1 day")
    query = stream.writeStream.format("memory").queryName("kpis").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, want = (sorted(map(tuple, df.collect())) for df in (spark.table("kpis"), windowed_kpis(behaviors, window="1 day")))
    assert got == want and sum(r[1] for r in got) == 144 and all(r[4] == pytest.approx(1 / 6) for r in got)


def test_failed_jobs_leave_nothing(spark, tmp_path):
    with pytest.raises(RuntimeError), files.published(spark, str(tmp_path / "out"), {"a"}) as staging:
        files.write_text(spark, f"{staging}/b", "b")
    assert not list(tmp_path.iterdir())


def test_reports():
    assert reports.evidence_tier("synthetic:train") is reports.EvidenceTier.SYNTHETIC_OBSERVATIONAL
    with pytest.raises(ValueError):
        reports.evidence_tier("other")
    assert [reports.shown(x) for x in (None, float("nan"), True, 3, 0.5, "a|b")] == ["N/A", "N/A", "true", "3", "0.500000", "a\\|b"]
    with pytest.raises(ValueError, match="contain"):
        reports.interval_plot([{"x": 1, "effect": 2.0, "ci_lower": 0.0, "ci_upper": 1.0}], "x", "t")
