"""Evidence tiers, Markdown reports and SVG plots over small result tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict
from enum import Enum

from tidemark.operators.causal import CausalAnalysis, CausalConfig, CausalDecision
from tidemark.operators.experiments import DecisionResult, ExperimentAnalysis, ExperimentConfig


class EvidenceTier(str, Enum):
    """What the results of a data set can support."""

    SYNTHETIC_RCT = "synthetic-rct"
    SYNTHETIC_QUASI_EXPERIMENT = "synthetic-quasi-experiment"
    SYNTHETIC_OBSERVATIONAL = "synthetic-observational"
    LICENSED_EBNERD = "licensed-ebnerd"


#: Of each tier, what a reader must be told.
BANNERS = {
    EvidenceTier.SYNTHETIC_RCT: "Simulated randomized experiment: shows that the analysis works, and no lift of a product.",
    EvidenceTier.SYNTHETIC_QUASI_EXPERIMENT: "Simulated rollout: shows that estimators and diagnostics work, and no lift of a product.",
    EvidenceTier.SYNTHETIC_OBSERVATIONAL: "Simulated logs: show that ranking and analytics work, and no quality on real readers.",
    EvidenceTier.LICENSED_EBNERD: "Aggregates of licensed logs: observational, neither a causal estimate nor a lift of a product.",
}


def evidence_tier(source: str) -> EvidenceTier:
    """The tier of a declared source: a tier's own name, or ``synthetic:…`` or ``ebnerd:…``."""
    prefixes = {"synthetic": EvidenceTier.SYNTHETIC_OBSERVATIONAL, "ebnerd": EvidenceTier.LICENSED_EBNERD}
    head, colon, _ = source.partition(":")
    if colon and head in prefixes:
        return prefixes[head]
    try:
        return EvidenceTier(source)
    except ValueError:
        raise ValueError(f"unknown evidence source: {source}") from None


def shown(value) -> str:
    """A table cell: missing and non-finite numbers as N/A, other reals with six places."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "N/A"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value).replace("|", "\\|")


def markdown_table(rows: Sequence[dict], columns: Sequence[str] | None = None) -> str:
    columns = list(columns or (rows[0] if rows else []))
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(shown(r.get(c)) for c in columns) + " |" for r in rows])


def document(title: str, tier: EvidenceTier, *parts: tuple[str, str]) -> str:
    body = "\n\n".join(f"## {head}\n\n{text}" for head, text in parts)
    return f"# {title}\n\n> **Evidence:** `{tier.value}`. {BANNERS[tier]}\n\n{body}\n"


def analytics_report(tier: EvidenceTier, tables: dict[str, list[dict]], fingerprint: str, min_cell_count: int) -> str:
    parts = [("Key figures", markdown_table(tables["kpi_summary"])), ("Funnel", markdown_table(tables["exposure_funnel"]))]
    parts += [(f"Segments (low support: under {min_cell_count} impressions)", markdown_table(tables["segment_kpis"]))]
    retention = markdown_table(tables["user_cohorts"]) if tables["user_cohorts"] else "Retention needs at least two weeks of activity."
    parts += [("Weekly retention", retention), ("Data quality", markdown_table(tables["data_quality"])), ("Provenance", f"Input fingerprint: `{fingerprint}`")]
    method = "Rates are ratios of sums; an impression counts once in every segment it touches; a value missing in the log is a segment of its own. Weeks begin on Monday."
    limits = "Clicks answer the order in which articles were shown. Differences between segments are descriptions, not effects, and small cells vary by chance."
    return document("Product analytics", tier, *parts, ("Method", method), ("Limits", limits))


def model_card(tier: EvidenceTier, metrics: dict, importance: list[tuple[str, float]]) -> str:
    facts = [{"fact": k, "value": v} for k, v in metrics.items()]
    use = "Orders candidates inside one impression. Scores of different impressions are not comparable; raw ids are not features."
    top = [{"feature": n, "importance": float(v)} for n, v in importance[:10]]
    limits = "Trained on clicks under one earlier order, so positions carry over. New articles and readers have median or neutral features. No claim about groups of readers is tested here."
    return document("Model card", tier, ("Use", use), ("Limits", limits), ("Validation", markdown_table(facts)), ("Most important features", markdown_table(top)))


def benchmark_report(tier: EvidenceTier, leaderboard: list[dict], intervals: list[dict], ablations: list[dict], segments: list[dict], diagnostics: list[dict], config: dict) -> str:
    full = next((a for a in ablations if a["ablation"] == "full"), None)
    deltas = [a | {"ndcg@10 against full": a["ndcg@10"] - full["ndcg@10"]} for a in ablations] if full else ablations
    parts = [("Leaderboard", markdown_table(leaderboard)), ("Paired bootstrap intervals", markdown_table(intervals)), ("Ablations", markdown_table(deltas))]
    parts += [("Segments", markdown_table(segments)), ("Position and freshness", markdown_table(diagnostics)), ("Configuration", markdown_table([{"setting": k, "value": v} for k, v in config.items()]))]
    method = "All models score the same later impressions. An interval holds the middle 95 % of weighted means over redrawn impressions, the same draws for every model; an ablation leaves out one group of features and refits. Negative differences mean that the group helped."
    limits = "One split in time and one log: intervals cover the choice of impressions, not that of the period. Segments with few impressions are marked and should not be compared."
    return document("Ranking benchmark", tier, *parts, ("Method", method), ("Limits", limits), ("Timing", "Seconds depend on the machine; clicks are logged under an earlier ranking, so positions bias them."))


def decision_report(tier: EvidenceTier, decision: DecisionResult, analysis: ExperimentAnalysis, config: ExperimentConfig, provenance: dict) -> str:
    p = decision.primary
    verdict = f"**{decision.status.value}**: {p.metric} {p.effect:.6f}, {100 * (1 - config.alpha):g} % interval [{p.ci_lower:.6f}, {p.ci_upper:.6f}], threshold {config.practical_threshold:g}."
    srm = analysis.srm
    integrity = f"Sample ratio: chi-square {srm.statistic:.6f}, p {srm.p_value:.6f}, {'pass' if srm.passed else 'fail'}."
    segments = [asdict(e) for e in analysis.heterogeneous_effects]
    parts = [("Decision", verdict), ("Integrity", integrity), ("Effects", markdown_table([asdict(e) for e in analysis.effects])), ("Guardrails", markdown_table(decision.guardrails))]
    parts += [("Segments", markdown_table(segments) if segments else "None configured."), ("Provenance", markdown_table([{"input": k, "sha256": v} for k, v in provenance.items()]))]
    rules = f"Order of the policy: a failed sample ratio ends it; then harm (the primary interval below 0, or a guardrail wholly beyond its margin); then doubt (a guardrail interval across its margin); launch needs the lower bound above {config.practical_threshold:g}."
    assumptions = "One row for each randomized unit, all analysed in the arm they were dealt to; units do not affect each other; the covariate was measured before the start. Intervals are normal, with unequal variances; the covariate's factor comes from both arms together."
    segments_note = f"Cells under {config.minimum_segment_units} units are marked. Confirmatory cells share the error rate by Holm's steps and have Bonferroni intervals; the others are exploratory and have none of that protection."
    return document("Experiment decision", tier, *parts, ("Rules", rules), ("Assumptions", assumptions), ("Reading the segments", segments_note))


def causal_report(tier: EvidenceTier, decision: CausalDecision, analysis: CausalAnalysis, config: CausalConfig, provenance: dict) -> str:
    did = analysis.did_estimate
    verdict = f"**{decision.value}**: effect {did['effect']:.6f}, interval [{did['ci_lower']:.6f}, {did['ci_upper']:.6f}], threshold {config.practical_threshold:g}."
    tests = [{"diagnostic": k, **{x: y for x, y in v.items() if not isinstance(y, (dict, list))}} for k, v in analysis.diagnostics.items()]
    parts = [("Decision", verdict), ("Estimate", markdown_table([did])), ("Event study", markdown_table(analysis.event_study)), ("Placebo", markdown_table([analysis.placebo_estimate]))]
    parts += [("Diagnostics", "\n\n".join(markdown_table([t]) for t in tests)), ("Balance before the rollout", markdown_table(analysis.balance)), ("Impact", markdown_table([analysis.business_impact]))]
    low, high = config.event_window
    method = f"Least squares weighted by {config.exposure_column}, with an effect for every market and every week, errors clustered by market. The event study compares weeks {low} to {high} with week {config.reference_week}; the placebo moves the rollout to week {config.placebo_week} and uses only earlier rows."
    assumptions = "Without the rollout both groups would have moved in parallel; nobody reacted before it; markets do not affect each other; the rollout did not depend on expected growth. The leads' joint test and the placebo can contradict this, not prove it."
    limits = f"Markets were not randomized, and gaps in the balance table show how the groups differ. The impact scales the estimate to {config.business_exposure_scale} exposures and carries only its sampling error."
    return document("Rollout impact", tier, *parts, ("Method", method), ("Assumptions", assumptions), ("Limits", limits), ("Provenance", markdown_table([{"input": k, "sha256": v} for k, v in provenance.items()])))


def interval_plot(rows: Sequence[dict], label: str, title: str) -> str:
    """An SVG of one interval a row (``effect``, ``ci_lower``, ``ci_upper``) with a line at 0."""
    names = [str(r[label]) for r in rows]
    if not rows or len(set(names)) != len(names):
        raise ValueError("a plot needs rows with different labels")
    for r in rows:
        if not all(isinstance(r[k], (int, float)) and math.isfinite(r[k]) for k in ("effect", "ci_lower", "ci_upper")):
            raise ValueError("plotted values must be finite")
        if not r["ci_lower"] <= r["effect"] <= r["ci_upper"]:
            raise ValueError("an interval must contain its effect")
    low, high = min(0.0, *(r["ci_lower"] for r in rows)), max(0.0, *(r["ci_upper"] for r in rows))
    x = lambda v: 160 + 420 * (v - low) / ((high - low) or 1.0)
    height = 60 + 24 * len(rows)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="640" height="{height}" font-family="sans-serif" font-size="12">', f'<text x="10" y="20">{title}</text>']
    out.append(f'<line x1="{x(0):.2f}" x2="{x(0):.2f}" y1="32" y2="{height - 16}" stroke="#888" stroke-dasharray="4"/>')
    for k, (name, r) in enumerate(zip(names, rows)):
        y = 48 + 24 * k
        out.append(f'<text x="10" y="{y + 4}">{name}</text><line x1="{x(r["ci_lower"]):.2f}" x2="{x(r["ci_upper"]):.2f}" y1="{y}" y2="{y}" stroke="#246"/><circle cx="{x(r["effect"]):.2f}" cy="{y}" r="4" fill="#246"/>')
    return "\n".join([*out, "</svg>"]) + "\n"
