"""The command line: ``python -m tidemark.cli COMMAND …``. Each command prints one JSON line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.operators import candidates as C, experiments as X
from tidemark.plans import workflows
from tidemark.session import session
from tidemark.sources import files, synthetic
from tidemark.sources.bundle import load_bundle


def _design(spark: SparkSession, a: argparse.Namespace) -> dict:
    design = X.ExperimentDesign(a.baseline_rate, a.baseline_rate * a.relative_mde, a.alpha, a.power)
    n = X.required_sample_size(design)
    days = {} if a.daily_units is None else {"required_days": X.required_days(design, a.daily_units)}
    return {"units_per_arm": n, "total_units": 2 * n, "absolute_mde": design.absolute_mde} | days


def _audit(spark: SparkSession, a: argparse.Namespace) -> dict:
    bundle = load_bundle(spark, a.data, split=a.split, check=False)
    return C.audit(bundle.behaviors, bundle.articles, bundle.history) | {"source": bundle.source_name}


def _benchmark(spark: SparkSession, a: argparse.Namespace) -> dict:
    names = [m.strip() for m in a.models.split(",")]
    if not all(names) or len(set(names)) != len(names):
        raise ValueError("--models must be different non-blank names")
    board = workflows.run_benchmark(spark, a.data, a.output, models=names, bootstrap_samples=a.bootstrap_samples, seed=a.seed, text_components=a.text_components, valid_fraction=a.valid_fraction)
    return {"best_model": board[0]["model"], "output": a.output}


# By command: what it does, and its options as (name, type, default); a default of ... is required.
COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], dict], list[tuple]]] = {
    "make-synthetic": (
        lambda s, a: {"output": synthetic.write_bundle(s, a.output, seed=a.seed, users=a.users, articles=a.articles, impressions=a.impressions)},
        [("output", str, ...), ("seed", int, 42), ("users", int, 30), ("articles", int, 80), ("impressions", int, 180)],
    ),
    "audit": (_audit, [("data", str, ...), ("split", ("train", "validation"), "train")]),
    "train": (
        lambda s, a: workflows.train_model(s, a.data, a.output, model=a.model, seed=a.seed, text_components=a.text_components, valid_fraction=a.valid_fraction),
        [("data", str, ...), ("output", str, ...), ("model", ("logistic", "lightgbm"), "logistic"), ("seed", int, 42), ("text-components", int, 32), ("valid-fraction", float, 0.2)],
    ),
    "rank": (
        lambda s, a: workflows.rank_file(s, a.model, a.candidates, a.output, top_k=a.top_k),
        [("model", str, ...), ("candidates", str, ...), ("output", str, ...), ("top-k", int, None)],
    ),
    "benchmark": (
        _benchmark,
        [("data", str, ...), ("output", str, ...), ("models", str, "position,popularity,logistic"), ("bootstrap-samples", int, 200), ("seed", int, 42), ("text-components", int, 32), ("valid-fraction", float, 0.2)],
    ),
    "analyze": (
        lambda s, a: {"kpis": workflows.run_analytics(s, a.data, a.output, split=a.split, min_cell_count=a.min_cell_count)["kpi_summary"][0], "output": a.output},
        [("data", str, ...), ("output", str, ...), ("split", ("train", "validation"), "validation"), ("min-cell-count", int, 5)],
    ),
    "experiment-design": (_design, [("baseline-rate", float, ...), ("relative-mde", float, ...), ("alpha", float, 0.05), ("power", float, 0.80), ("daily-units", int, None)]),
    "make-experiment": (
        lambda s, a: {"output": synthetic.write_experiment(s, a.output, seed=a.seed, users=a.users, corrupt_allocation=a.corrupt_allocation)},
        [("output", str, ...), ("seed", int, 42), ("users", int, 20_000), ("corrupt-allocation", bool, False)],
    ),
    "experiment": (
        lambda s, a: {"decision": workflows.run_experiment(s, a.input, a.output, Path(a.config).read_text()).status.value, "output": a.output},
        [("input", str, ...), ("output", str, ...), ("config", str, ...)],
    ),
    "make-quasi-experiment": (
        lambda s, a: {"output": synthetic.write_panel(s, a.output, seed=a.seed, markets=a.markets, pre_weeks=a.pre_weeks, post_weeks=a.post_weeks)},
        [("output", str, ...), ("seed", int, 42), ("markets", int, 60), ("pre-weeks", int, 20), ("post-weeks", int, 12)],
    ),
    "causal-impact": (
        lambda s, a: {"decision": workflows.run_causal_impact(s, a.input, a.output, Path(a.config).read_text()).value, "output": a.output},
        [("input", str, ...), ("output", str, ...), ("config", str, ...)],
    ),
    "portfolio": (
        lambda s, a: {"files": workflows.assemble_portfolio(s, a.analytics, a.experiment, a.output)},
        [("analytics", str, ...), ("experiment", str, ...), ("output", str, ...)],
    ),
}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        command = commands.add_parser(name)
        for option, kind, default in options:
            if kind is bool:
                command.add_argument(f"--{option}", action="store_true")
            elif isinstance(kind, tuple):
                command.add_argument(f"--{option}", choices=kind, default=default)
            else:
                command.add_argument(f"--{option}", type=kind, required=default is ..., default=None if default is ... else default)
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    work, _ = COMMANDS[args.command]
    try:
        print(json.dumps(files.plain(work(spark or session(), args)), sort_keys=True))
    except (ValueError, OSError) as bad:
        print(f"error: {bad}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
