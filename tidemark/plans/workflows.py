"""The batch jobs: analytics, training, ranking, benchmark, experiment, rollout, portfolio.

Each reads tables, runs operators as Spark jobs and publishes a folder of small result files
in one rename, or nothing. Only result tables (a row for each metric, segment, model or
week) reach the driver.
"""

from __future__ import annotations

import hashlib
import json
import platform
import time
from collections.abc import Collection
from dataclasses import asdict, dataclass

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidemark.errors import ContractError
from tidemark.operators import analytics, candidates as C, causal as K, experiments as X, features as E, models as M, ranking as R
from tidemark.plans import reports
from tidemark.sources import files
from tidemark.sources.bundle import load_bundle
from tidemark.sources.synthetic import sidecar

# The files of each job.
ANALYTICS_FILES = {"analytics_report.md", "data_quality.csv", "exposure_funnel.csv", "kpi_summary.csv", "segment_kpis.csv", "user_cohorts.csv"}
EXPERIMENT_FILES = {"cuped_effects.csv", "decision_report.md", "effects.csv", "effects.svg", "experiment_config.json", "experiment_summary.csv", "heterogeneous_effects.csv", "run_manifest.json", "srm.json"}
CAUSAL_FILES = {"balance.csv", "business_impact.csv", "causal_report.md", "config_snapshot.json", "diagnostics.json", "did_estimate.csv", "event_study.csv", "event_study.svg", "placebo_estimate.csv", "run_manifest.json"}

#: Feature names of each ablation.
ABLATIONS = {
    "context_only": E.select_feature_names(include_groups=["context"]),
    "no_position": [n for n in E.NAMES if n != "candidate_position"],
    "no_semantic": E.select_feature_names(exclude_groups=["semantic"]),
    "no_personalization": E.select_feature_names(exclude_groups=["personalization"]),
    "full": list(E.NAMES),
}


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def versions() -> dict[str, str]:
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": np.__version__}


# Analytics ----------------------------------------------------------------------------


def run_analytics(spark: SparkSession, data: str, output: str, *, split: str = "validation", min_cell_count: int = 5) -> dict[str, list[dict]]:
    """The five product-analytics tables of a bundle, as CSV, with a report."""
    if min_cell_count < 1:
        raise ValueError("min_cell_count must be positive")
    bundle = load_bundle(spark, data, split=split)
    rows = C.analytics_candidates(C.expand_candidates(bundle.behaviors), bundle.articles, bundle.history).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with files.published(spark, output, ANALYTICS_FILES) as staging:
            frames = {
                "data_quality": analytics.data_quality(rows),
                "kpi_summary": analytics.kpi_summary(rows),
                "exposure_funnel": analytics.exposure_funnel(rows),
                "segment_kpis": analytics.segment_kpis(rows, min_cell_count=min_cell_count),
                "user_cohorts": analytics.user_cohorts(rows),
            }
            tables = {}
            for name, df in frames.items():
                tables[name] = _rows(df)
                files.rows_csv(spark, tables[name], f"{staging}/{name}.csv", df.columns)
            report = reports.analytics_report(reports.evidence_tier(bundle.source_name), tables, files.fingerprint(spark, data), min_cell_count)
            files.write_text(spark, f"{staging}/analytics_report.md", report)
    finally:
        rows.unpersist()
    return tables


# Ranking ------------------------------------------------------------------------------


@dataclass
class Split:
    articles: DataFrame
    history: DataFrame
    train: DataFrame
    valid: DataFrame
    source_name: str


def load_split(spark: SparkSession, data: str, *, valid_fraction: float = 0.2) -> Split:
    """Training and validation candidates: the bundle's own validation folder, which must
    begin after training ends, or else the last timestamps of the training data."""
    bundle = load_bundle(spark, data, split="train")
    train = C.expand_candidates(bundle.behaviors)
    if not files.exists(spark, f"{data.rstrip('/')}/validation"):
        return Split(bundle.articles, bundle.history, *C.temporal_split(train, valid_fraction=valid_fraction), bundle.source_name)
    valid = C.expand_candidates(load_bundle(spark, data, split="validation").behaviors)
    last, first = train.agg(F.max("impression_time")).first()[0], valid.agg(F.min("impression_time")).first()[0]
    if last >= first:
        raise ContractError("training impressions must precede validation impressions")
    return Split(bundle.articles, bundle.history, train, valid, bundle.source_name)


def train_model(spark: SparkSession, data: str, output: str, *, model: str = "logistic", seed: int = 42, text_components: int = 32, valid_fraction: float = 0.2, trees: int = M.boosting.TREES) -> dict:
    """Fits features and a model, evaluates it on later impressions and publishes the model,
    predictions, metrics, importances and a model card."""
    split = load_split(spark, data, valid_fraction=valid_fraction)
    builder = E.FeatureBuilder(text_components, seed).fit(split.articles, split.history, split.train)
    fitted = M.fit_model(model, builder.transform(split.train), E.NAMES, seed=seed, trees=trees)
    scored = fitted.score(builder.transform(split.valid)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        metrics = _rows(R.ranking_metrics(scored))[0] | {"model": model, "seed": seed, "dataset": split.source_name}
        if model == "logistic":
            metrics["log_loss"] = R.log_loss(scored)
        with files.published(spark, output) as staging:
            scored.select("impression_id", "article_id", "label", "score").write.parquet(f"{staging}/predictions.parquet")
            files.write_text(spark, f"{staging}/metrics.json", files.to_json(metrics))
            lines = ["feature,importance", *(f"{n},{v!r}" for n, v in fitted.importance())]
            files.write_text(spark, f"{staging}/feature_importance.csv", "\n".join(lines) + "\n")
            files.write_text(spark, f"{staging}/model_card.md", reports.model_card(reports.evidence_tier(split.source_name), metrics, fitted.importance()))
            M.save_ranker(spark, f"{staging}/model", M.SavedRanker(fitted, builder, list(E.NAMES), {"dataset": split.source_name, "seed": seed}))
    finally:
        scored.unpersist()
    return metrics


def rank_file(spark: SparkSession, model: str, candidates: str, output: str, *, top_k: int | None = None) -> dict:
    """Ranks impressions (slates are expanded) or candidate rows with a saved model."""
    rows = spark.read.parquet(candidates)
    if "article_ids_inview" in rows.columns:
        rows = C.expand_scoring_candidates(rows)
    ranked = M.load_ranker(spark, model).rank(rows, top_k=top_k)
    ranked.write.parquet(output)
    found = spark.read.parquet(output).agg(F.count("*").alias("rows"), F.count_distinct("impression_id").alias("impressions")).first()
    return {"rows": found["rows"], "impressions": found["impressions"], "output": output}


def _timed(work):
    began = time.perf_counter()
    return work(), time.perf_counter() - began


def run_benchmark(spark: SparkSession, data: str, output: str, *, models: list[str], bootstrap_samples: int = 200, seed: int = 42, text_components: int = 32, valid_fraction: float = 0.2, trees: int = M.boosting.TREES, draws: str = "numpy") -> list[dict]:
    """Compares scorers on the same later impressions: leaderboard, paired bootstrap,
    ablations, segments, diagnostics. All models' scores are one long table, so that metrics
    and bootstrap are one job each."""
    if not models or len(set(models)) != len(models) or set(models) - {"position", "popularity", "logistic", "lightgbm"}:
        raise ValueError("models must be different known names")
    split = load_split(spark, data, valid_fraction=valid_fraction)
    builder = E.FeatureBuilder(text_components, seed).fit(split.articles, split.history, split.train)
    train = builder.transform(split.train).persist(StorageLevel.MEMORY_AND_DISK)
    valid = builder.transform(split.valid).persist(StorageLevel.MEMORY_AND_DISK)
    n_valid = valid.count()
    learned, facts, parts = {}, {}, []
    for name in models:
        if name in ("position", "popularity"):
            fitted, fit_seconds = _timed(lambda: R.fit_baseline(name, split.train))
            scored = R.predict_baseline(fitted, valid)
            size = 0
        else:
            fitted, fit_seconds = _timed(lambda: M.fit_model(name, train, E.NAMES, seed=seed, trees=trees))
            scored, learned[name] = fitted.score(valid), fitted
            size = len(files.to_json({k: v for k, v in vars(fitted).items()}))
        _, score_seconds = _timed(lambda: scored.agg(F.sum("score")).collect())
        facts[name] = {"fit_seconds": fit_seconds, "score_ms_per_1000": score_seconds * 1e6 / max(1, n_valid), "model_bytes": size}
        parts.append(scored.select("impression_id", "article_id", "candidate_position", "label", "score").withColumn("model", F.lit(name)))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    R.check_scored(scores)
    per = R.per_impression(scores).persist(StorageLevel.MEMORY_AND_DISK)
    board = [r | facts[r["model"]] for r in _rows(R.leaderboard(per.groupBy("model").agg(*R.averages((5, 10)))))]
    intervals = _rows(R.bootstrap_intervals(per, samples=bootstrap_samples, seed=seed, how=draws))
    if "logistic" not in learned:
        learned["logistic"] = M.fit_logistic(train, E.NAMES)
    ablations = _rows(R.ablations(M.fit_logistics(train, ABLATIONS), valid))
    chosen = learned["logistic"].score(valid)
    if "device_type" in split.valid.columns:
        raw = split.valid.select("impression_id", "candidate_position", "device_type")
        chosen = chosen.drop("device_type").join(raw, ["impression_id", "candidate_position"])
    segments = _rows(R.segment_ranking_metrics(chosen))
    diagnostics = _rows(R.candidate_diagnostics(valid))
    config = {"models": ",".join(models), "seed": seed, "bootstrap_samples": bootstrap_samples, "text_components": text_components, "validation_rows": n_valid, "dataset": split.source_name} | versions()
    with files.published(spark, output) as staging:
        for name, rows in (("leaderboard", board), ("confidence_intervals", intervals), ("ablations", ablations), ("segment_metrics", segments), ("candidate_diagnostics", diagnostics)):
            files.rows_csv(spark, rows, f"{staging}/{name}.csv")
        files.write_text(spark, f"{staging}/benchmark_config.json", files.to_json(config))
        report = reports.benchmark_report(reports.evidence_tier(split.source_name), board, intervals, ablations, segments, diagnostics, config)
        files.write_text(spark, f"{staging}/benchmark_report.md", report)
    for df in (train, valid, per):
        df.unpersist()
    return board


# Experiments and rollouts -------------------------------------------------------------


def _metadata(spark: SparkSession, path: str, tiers: Collection[reports.EvidenceTier]) -> tuple[dict, reports.EvidenceTier]:
    """What the file beside the data says of it, and its tier, which must be one of ``tiers``."""
    try:
        facts = json.loads(files.read_text(spark, sidecar(path)))
    except (OSError, ValueError) as bad:
        raise ContractError(f"metadata cannot be read: {bad}") from None
    allowed = {t.value: t for t in tiers}
    if facts.get("evidence_tier") not in allowed:
        raise ContractError(f"metadata evidence_tier must be {' or '.join(allowed)}")
    return facts, allowed[facts["evidence_tier"]]


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _agree(facts: dict, **found) -> None:
    for name, value in found.items():
        if facts.get(name) != value:
            raise ContractError(f"metadata {name} does not match the data")


def run_experiment(spark: SparkSession, path: str, output: str, config_text: str, *, tiers: Collection[reports.EvidenceTier] = (reports.EvidenceTier.SYNTHETIC_RCT,)) -> X.DecisionResult:
    """Analyses a randomized experiment and publishes effects, report and decision. Data whose
    evidence is of none of the ``tiers`` is refused."""
    (facts, tier), config = _metadata(spark, path, tiers), X.ExperimentConfig.from_json(config_text)
    analysis = X.analyze_experiment(spark.read.parquet(path), config)
    counts = analysis.srm.observed_counts
    _agree(facts, units=sum(counts.values()), allocation=counts)
    decision = X.make_decision(analysis, config)
    provenance = {"input": files.file_sha256(spark, path), "metadata": files.file_sha256(spark, sidecar(path))}
    with files.published(spark, output, EXPERIMENT_FILES) as staging:
        files.rows_csv(spark, analysis.summary, f"{staging}/experiment_summary.csv")
        for name, effects in (("effects", analysis.effects), ("cuped_effects", analysis.cuped_effects), ("heterogeneous_effects", analysis.heterogeneous_effects)):
            files.rows_csv(spark, [asdict(e) for e in effects], f"{staging}/{name}.csv")
        files.write_text(spark, f"{staging}/srm.json", files.to_json(asdict(analysis.srm)))
        files.write_text(spark, f"{staging}/experiment_config.json", config_text)
        files.write_text(spark, f"{staging}/run_manifest.json", files.to_json({"config_sha256": text_sha256(config_text), "evidence_tier": tier.value, "inputs": provenance, "versions": versions(), "status": decision.status.value}))
        files.write_text(spark, f"{staging}/decision_report.md", reports.decision_report(tier, decision, analysis, config, provenance))
        files.write_text(spark, f"{staging}/effects.svg", reports.interval_plot([asdict(e) for e in analysis.effects], "metric", "Effects"))
    return decision


def run_causal_impact(
    spark: SparkSession, path: str, output: str, config_text: str, *, tiers: Collection[reports.EvidenceTier] = (reports.EvidenceTier.SYNTHETIC_QUASI_EXPERIMENT,)
) -> K.CausalDecision:
    """Estimates a market rollout and publishes estimates, diagnostics, report and decision.
    Data whose evidence is of none of the ``tiers`` is refused."""
    config = K.CausalConfig.from_json(config_text)
    analysis = K.analyze_panel(spark.read.parquet(path), config)
    integrity = analysis.diagnostics["integrity"]
    (facts, tier), sha = _metadata(spark, path, tiers), files.file_sha256(spark, path)
    _agree(facts, panel_sha256=sha, **{k: integrity[k] for k in ("rows", "markets", "treated_markets", "pre_weeks", "post_weeks")})
    decision = K.evaluate_causal_decision(analysis, config)
    provenance = {"panel": sha, "metadata": files.file_sha256(spark, sidecar(path))}
    diagnostics = files.canonical(analysis.diagnostics | {"decision": {"status": decision.value}})
    with files.published(spark, output, CAUSAL_FILES) as staging:
        for name, rows in (("did_estimate", [analysis.did_estimate]), ("event_study", analysis.event_study), ("placebo_estimate", [analysis.placebo_estimate]), ("balance", analysis.balance), ("business_impact", [analysis.business_impact])):
            files.rows_csv(spark, rows, f"{staging}/{name}.csv")
        files.write_text(spark, f"{staging}/diagnostics.json", files.to_json(diagnostics))
        files.write_text(spark, f"{staging}/config_snapshot.json", config_text)
        files.write_text(spark, f"{staging}/run_manifest.json", files.to_json({"config_sha256": text_sha256(config_text), "evidence_tier": tier.value, "inputs": provenance, "versions": versions(), "status": decision.value}))
        files.write_text(spark, f"{staging}/causal_report.md", reports.causal_report(tier, decision, analysis, config, provenance))
        files.write_text(spark, f"{staging}/event_study.svg", reports.interval_plot(analysis.event_study, "relative_week", "Effect by week"))
    return decision


def assemble_portfolio(spark: SparkSession, analytics_folder: str, experiment_folder: str, output: str) -> list[str]:
    """The files of an analytics and an experiment run in one folder."""
    wanted = [(analytics_folder, f) for f in sorted(ANALYTICS_FILES)] + [(experiment_folder, f) for f in sorted(EXPERIMENT_FILES)]
    missing = [f"{folder}/{f}" for folder, f in wanted if not files.exists(spark, f"{folder}/{f}")]
    if missing:
        raise ContractError(f"missing artifacts: {', '.join(missing)}")
    with files.published(spark, output, ANALYTICS_FILES | EXPERIMENT_FILES) as staging:
        for folder, f in wanted:
            files.write_text(spark, f"{staging}/{f}", files.read_text(spark, f"{folder}/{f}"))
    return [f for _, f in wanted]
