"""Runs: report rows, metrics by category, listing, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.functions.scoring import matches
from signpost.functions.text import preview
from signpost.operators.quality import FAILED, SUCCESS
from signpost.session import materialize

# Which category a metric is stored under; others are performance.
METRIC_CATEGORIES = {
    "performance_metrics": [
        "total_articles",
        "successful_articles",
        "failed_articles",
        "total_batches",
        "successful_batches",
        "failed_batches",
        "success_rate",
        "accuracy",
        "correct_predictions",
        "total_predictions",
    ],
    "cost_metrics": [
        "total_cost",
        "cost_per_article",
        "total_tokens",
        "total_prompt_tokens",
        "total_completion_tokens",
        "avg_tokens_per_article",
        "avg_prompt_tokens_per_article",
        "avg_completion_tokens_per_article",
    ],
    "latency_metrics": [
        "total_latency",
        "avg_batch_latency",
        "avg_latency_per_article",
        "total_processing_time",
    ],
    "classification_metrics": [
        "precision_macro",
        "recall_macro",
        "f1_macro",
        "precision_weighted",
        "recall_weighted",
        "f1_weighted",
        "per_class_metrics",
        "classification_report",
    ],
}
OTHER_CATEGORY = "performance_metrics"

# Metrics compared unless the caller names others.
TRACKED_METRICS = ["accuracy", "f1_macro", "total_latency", "total_cost"]

# A run id is this time format, an underscore and a unique suffix.
RUN_TIME_FORMAT = "yyyy-MM-dd_HH-mm-ss"


def run_id(at: Column, suffix: Column | None = None) -> Column:
    return F.concat_ws(
        "_", F.date_format(at, RUN_TIME_FORMAT), suffix if suffix is not None else F.uuid()
    )


def run_time(run: Column) -> Column:
    """The time a run id starts with; null if it is not a run id."""
    return F.try_to_timestamp(F.substring(run, 1, 19), F.lit(RUN_TIME_FORMAT))


def classification_rows(classified: DataFrame, text_col: str = "text") -> DataFrame:
    """The seven report columns of every article, failed batches included.

    ``classified`` has (batch_id, article_id, prediction, true_label, status,
    error, text). A failed row has neither prediction nor verdict, and its
    status carries the error.
    """
    ok = F.col("status") == SUCCESS
    return classified.select(
        F.col("batch_id").cast("string").alias("batch_id"),
        "article_id",
        F.when(ok, F.col("prediction")).alias("prediction"),
        F.lower("true_label").alias("true_label"),
        F.when(ok, matches(F.col("true_label"), F.col("prediction"))).alias("correct"),
        F.when(ok, F.lit(SUCCESS))
        .otherwise(F.concat(F.lit(f"{FAILED}: "), F.coalesce("error", F.lit(""))))
        .alias("batch_status"),
        preview(F.col(text_col)).alias("article_text_preview"),
    )


def metric_category(metric: Column) -> Column:
    """The category of a metric; what stands behind a point does not count."""
    chain, name = None, F.substring_index(metric, ".", 1)
    for category, names in METRIC_CATEGORIES.items():
        hit = name.isin(names)
        chain = F.when(hit, category) if chain is None else chain.when(hit, category)
    return chain.otherwise(OTHER_CATEGORY)


def metric_rows(metrics: DataFrame) -> DataFrame:
    """One row of metrics turned into (category, metric, value)."""
    doubles = metrics.select(*[F.col(c).cast("double").alias(c) for c in metrics.columns])
    return doubles.unpivot([], doubles.columns, "metric", "value").select(
        metric_category(F.col("metric")).alias("category"), "metric", "value"
    )


def report_rows(report: DataFrame, means: DataFrame) -> DataFrame:
    """A class report as (category, metric, value): ``classification_report.<class>.<measure>``.

    ``report`` has a row per class, ``means`` the one row of averages over them.
    """
    measures = ("precision", "recall", "f1", "support")
    names = dict(zip(measures, ("precision", "recall", "f1-score", "support")))
    prefix = F.concat(F.lit("classification_report."), F.col("class"), F.lit("."))
    per_class = report.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.concat(prefix, F.lit(names[m])).alias("metric"),
                        F.col(m).cast("double").alias("value"),
                    )
                    for m in measures
                ]
            )
        )
    )
    averages = means.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"classification_report.{kind} avg.{names[m]}").alias("metric"),
                        F.col(f"{m}_{kind}").alias("value"),
                    )
                    for kind in ("macro", "weighted")
                    for m in measures[:3]
                ]
            )
        )
    )
    return per_class.unionByName(averages).select(
        metric_category(F.col("metric")).alias("category"), "metric", "value"
    )


def run_listing(runs: DataFrame) -> DataFrame:
    """All runs newest first, with the number of runs of their type and its latest.

    ``runs`` has (result_type, run_id, modified_at). Equal times go to the
    smaller run id.
    """
    # one row per type, written: its true size decides how it is joined
    per_type = materialize(
        runs.groupBy("result_type").agg(
            F.count(F.lit(1)).alias("runs_of_type"), _newest().alias("_newest")
        )
    ).select("result_type", "runs_of_type", F.col("_newest.run_id").alias("_latest"))
    return (
        runs.join(per_type, "result_type")
        .withColumn("is_latest", F.col("run_id") == F.col("_latest"))
        .drop("_latest")
        .orderBy(F.desc("modified_at"), "run_id")
    )


def _newest() -> Column:
    # instants and not local times, which run backwards for an hour in autumn
    age = -F.unix_micros(F.col("modified_at").cast("timestamp"))
    return F.min(F.struct(age.alias("_age"), "run_id", "modified_at"))


def latest_run(runs: DataFrame, chosen: dict[str, str] | None = None) -> DataFrame:
    """Latest run per type: (result_type, run_id, modified_at).

    ``chosen`` names the run to take for a type instead of its latest.
    """
    for result_type, name in (chosen or {}).items():
        runs = runs.filter((F.col("result_type") != result_type) | (F.col("run_id") == name))
    return (
        runs.groupBy("result_type")
        .agg(_newest().alias("_newest"))
        .select("result_type", "_newest.run_id", "_newest.modified_at")
    )


def compare_runs(
    baseline: DataFrame, semantic: DataFrame, tracked: Sequence[str] = tuple(TRACKED_METRICS)
) -> DataFrame:
    """Compare two long metric tables (metric, value) on the tracked metrics.

    The ratio is always semantic over baseline (infinite for a zero baseline);
    ``speedup`` is filled for latency metrics, ``savings_pct`` for cost metrics.
    Values that are missing or not numeric on either side drop the metric.
    """
    inf = F.lit(float("inf"))

    def side(df: DataFrame, name: str) -> DataFrame:
        value = F.expr("try_cast(value AS double)").alias(name)
        return (
            df.filter(F.col("metric").isin(list(tracked)))
            .select("metric", value)
            .filter(F.col(name).isNotNull())
        )

    both = side(baseline, "baseline").join(side(semantic, "semantic"), "metric")
    b, s, r = F.col("baseline"), F.col("semantic"), F.col("improvement_ratio")
    latency = F.contains(F.lower("metric"), F.lit("latency"))
    cost = F.contains(F.lower("metric"), F.lit("cost"))
    return (
        both.withColumn("improvement_ratio", F.when(b == 0, inf).otherwise(F.try_divide(s, b)))
        .withColumn("improvement_pct", (r - 1) * 100)
        .withColumn("speedup", F.when(latency, F.when(s == 0, inf).otherwise(F.try_divide(b, s))))
        .withColumn(
            "savings_pct",
            F.when(~latency & cost, F.when(r < 1, (1 - r) * 100).otherwise(F.lit(0.0))),
        )
    )
