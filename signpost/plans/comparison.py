"""Compare the latest, or named, runs of two result types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from signpost.operators.runs import TRACKED_METRICS, compare_runs, latest_run
from signpost.sources import run_store


def compare_stored_runs(
    spark: SparkSession,
    baseline_base: str,
    semantic_base: str,
    baseline_run: str | None = None,
    semantic_run: str | None = None,
    tracked: Sequence[str] = tuple(TRACKED_METRICS),
    save_to: str | None = None,
) -> DataFrame:
    """Metric comparison of two stored runs; an error if either has no metrics."""
    runs = run_store.stored_runs(spark, {"baseline": baseline_base, "semantic": semantic_base})
    chosen = {
        k: v for k, v in (("baseline", baseline_run), ("semantic", semantic_run)) if v is not None
    }
    picked = {r["result_type"]: r["run_id"] for r in latest_run(runs, chosen).collect()}
    sides = {}
    for side, base in (("baseline", baseline_base), ("semantic", semantic_base)):
        metrics = run_store.read_metrics(spark, base, picked[side]) if side in picked else None
        if metrics is None:
            raise ValueError(f"no metrics to compare under {base}")
        sides[side] = metrics
    comparison = compare_runs(sides["baseline"], sides["semantic"], tracked)
    if save_to is not None:
        run_store.save_comparison(
            comparison, sides["baseline"], sides["semantic"], save_to, run_store.new_run_id(spark)
        )
    return comparison
