"""Batch metrics and classification quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.functions.scoring import matches, ratio

# A batch's status, and below the names of the metrics that runs are stored and compared by.
SUCCESS = "success"
FAILED = "failed"


def all_batches(successful: DataFrame, failed: DataFrame) -> DataFrame:
    """Successful and failed batches as one table; what a side lacks is null."""
    return successful.withColumn("status", F.lit(SUCCESS)).unionByName(
        failed.withColumn("status", F.lit(FAILED)), allowMissingColumns=True
    )


def batch_metrics(batches: DataFrame) -> DataFrame:
    """One row of run metrics; no row for no batches.

    ``batches`` has (status, batch_size, total_latency, total_cost,
    prompt_tokens, completion_tokens, total_tokens). Latency, cost and tokens
    count successful batches only, and ``success_rate`` is by batch.
    """
    ok = F.col("status") == SUCCESS

    def over_ok(name: str):
        return F.coalesce(F.sum(F.when(ok, F.col(name))), F.lit(0))

    sums = batches.agg(
        F.coalesce(F.sum("batch_size"), F.lit(0)).alias("total_articles"),
        over_ok("batch_size").alias("successful_articles"),
        F.count(F.lit(1)).alias("total_batches"),
        F.count_if(ok).alias("successful_batches"),
        over_ok("total_latency").cast("double").alias("total_latency"),
        over_ok("total_cost").cast("double").alias("total_cost"),
        over_ok("prompt_tokens").alias("total_prompt_tokens"),
        over_ok("completion_tokens").alias("total_completion_tokens"),
        over_ok("total_tokens").alias("total_tokens"),
    ).filter("total_batches > 0")
    articles, batch_count = F.col("successful_articles"), F.col("successful_batches")
    return sums.select(
        "total_articles",
        "successful_articles",
        (F.col("total_articles") - articles).alias("failed_articles"),
        "total_batches",
        "successful_batches",
        (F.col("total_batches") - batch_count).alias("failed_batches"),
        ratio(batch_count, F.col("total_batches")).alias("success_rate"),
        "total_latency",
        ratio(F.col("total_latency"), batch_count).alias("avg_batch_latency"),
        ratio(F.col("total_latency"), articles).alias("avg_latency_per_article"),
        "total_cost",
        ratio(F.col("total_cost"), articles).alias("cost_per_article"),
        "total_prompt_tokens",
        "total_completion_tokens",
        "total_tokens",
        ratio(F.col("total_prompt_tokens"), articles).alias("avg_prompt_tokens_per_article"),
        ratio(F.col("total_completion_tokens"), articles).alias(
            "avg_completion_tokens_per_article"
        ),
        ratio(F.col("total_tokens"), articles).alias("avg_tokens_per_article"),
    )


def per_batch_rates(batches: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Latency and cost per article of each batch, and its accuracy.

    ``classified`` has (batch_id, true_label, prediction); accuracy is null for
    a batch without labelled articles.
    """
    rates = batches.withColumn(
        "avg_latency_per_article", ratio(F.col("total_latency"), F.col("batch_size"))
    ).withColumn("cost_per_article", ratio(F.col("total_cost"), F.col("batch_size")))
    if classified is None:
        return rates.withColumn("accuracy", F.lit(None).cast("double"))
    scored = classified.groupBy("batch_id").agg(
        F.avg(matches(F.col("true_label"), F.col("prediction")).cast("double")).alias("accuracy")
    )
    return rates.join(scored, "batch_id", "left")


def accuracy(
    classified: DataFrame, label_col: str = "true_label", prediction_col: str = "prediction"
) -> DataFrame:
    """One row: articles, labelled ones, correct ones, accuracy, mean confidence.

    Counts and accuracy are null when nothing is labelled; the confidence is the
    mean over all articles, fallbacks included.
    """
    labelled = F.col(label_col).isNotNull()
    hit = labelled & matches(F.col(label_col), F.col(prediction_col))
    counted = classified.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_if(labelled).alias("_labelled"),
        F.count_if(hit).alias("_correct"),
        F.avg("confidence").alias("avg_confidence"),
    )
    some = F.col("_labelled") > 0
    return counted.select(
        "total_articles",
        F.when(some, F.col("_labelled")).alias("total_predictions"),
        F.when(some, F.col("_correct")).alias("correct_predictions"),
        F.when(some, F.col("_correct") / F.col("_labelled")).alias("accuracy"),
        "avg_confidence",
    )


def confusion_matrix(
    classified: DataFrame, label_col: str = "true_label", prediction_col: str = "prediction"
) -> DataFrame:
    """Counts by (true, predicted) over the labelled rows; partial aggregation, tiny result."""
    return (
        classified.filter(F.col(label_col).isNotNull())
        .groupBy(
            F.lower(F.col(label_col)).alias("y_true"),
            F.lower(F.col(prediction_col)).alias("y_pred"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_report(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class that is true or predicted somewhere."""
    sides = confusion.select(
        F.inline(
            F.array(
                F.struct(F.col("y_true").alias("class"), F.col("n").alias("_true"),
                         F.lit(0).cast("bigint").alias("_pred")),
                F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("_true"),
                         F.col("n").alias("_pred")),
            )
        ),
        F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("_hit"),
    )
    counts = sides.groupBy("class").agg(
        F.sum("_true").alias("support"),
        F.sum("_pred").alias("_predicted"),
        # a hit shows up on both sides
        F.sum(F.when(F.col("_true") > 0, F.col("_hit")).otherwise(0)).alias("_tp"),
    )
    p = ratio(F.col("_tp"), F.col("_predicted"))
    r = ratio(F.col("_tp"), F.col("support"))
    return counts.select(
        "class",
        p.alias("precision"),
        r.alias("recall"),
        ratio(2 * p * r, p + r).alias("f1"),
        "support",
    ).orderBy("class")


def averaged_metrics(report: DataFrame) -> DataFrame:
    """One row: macro means over all classes and means weighted by support."""

    def weighted(name: str):
        return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    return report.agg(
        *[F.avg(n).alias(f"{n}_macro") for n in ("precision", "recall", "f1")],
        *[weighted(n).alias(f"{n}_weighted") for n in ("precision", "recall", "f1")],
        F.count(F.lit(1)).alias("_classes"),
    ).filter("_classes > 0").drop("_classes")
