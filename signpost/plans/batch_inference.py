"""Classify articles with a model called once per batch."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.checks import positive
from signpost.operators.inference import (
    Complete,
    Prompt,
    called,
    classify_batches,
    model_replies,
    ordered_prompts,
)
from signpost.operators.quality import SUCCESS
from signpost.session import materialize
from signpost.sources import files


def planned_prompts(
    articles: DataFrame,
    classes: Sequence[str],
    batch_size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    calls_per_task: int = 500,
    template: Prompt = Prompt(),
) -> DataFrame:
    """Prompts of consecutive articles, in partitions of about ``calls_per_task`` calls.

    What is lost with an executor are the calls of its running tasks, so tasks are kept
    short; a few prompts are spread over all cores.
    """
    positive("calls_per_task", calls_per_task)
    positive("batch_size", batch_size)
    calls = math.ceil(articles.count() / batch_size)
    cores = articles.sparkSession.sparkContext.defaultParallelism
    partitions = max(1, math.ceil(calls / calls_per_task), min(calls, cores))
    return ordered_prompts(articles, batch_size, classes, id_col, text_col, partitions, template)


def reply_batches(
    articles: DataFrame,
    classes: Sequence[str],
    factory: Callable[[], Complete],
    batch_size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_retries: int = 3,
    max_concurrent: int | None = None,
    calls_per_task: int = 500,
    template: Prompt = Prompt(),
) -> DataFrame:
    """Batches of articles with the model's reply, written once.

    Tasks run as many at a time as the cluster has cores, or ``max_concurrent`` longer ones.
    """
    prompts = planned_prompts(articles, classes, batch_size, id_col, text_col, calls_per_task, template)
    return model_replies(prompts, factory, max_retries, max_concurrent)


def resumed_replies(
    prompts: DataFrame,
    factory: Callable[[], Complete],
    ledger: str,
    max_retries: int = 3,
    max_concurrent: int | None = None,
    retry_failed: bool = False,
    calls_per_task: int = 500,
) -> DataFrame:
    """Replies to all prompts, of which only those that the ledger lacks are called for.

    The ledger is a folder of finished replies, keyed by the digest of their prompt. Every
    task puts its replies there when it ends, also if the job is broken off later, so a
    job that is started again over the same articles repeats no finished task's calls.
    With ``retry_failed`` replies that failed for good are asked for again. Prompts are
    written once, so that they are not put together again for every reader. A scan would pack
    what was written into tasks of thousands of prompts, all held by their worker at once and
    lost together, so the prompts that are left are dealt by their key over tasks of about
    ``calls_per_task`` calls again.
    """
    positive("calls_per_task", calls_per_task)
    spark = prompts.sparkSession
    keyed = materialize(prompts.withColumn("prompt_key", F.sha2("prompt", 256)))
    left = keyed
    if files.names(spark, ledger):
        done = spark.read.parquet(ledger).filter(F.lit(not retry_failed) | (F.col("status") == SUCCESS))
        left = keyed.join(done.select("prompt_key").distinct(), "prompt_key", "left_anti")
    tasks = max(math.ceil(keyed.count() / calls_per_task), spark.sparkContext.defaultParallelism)
    left = left.repartition(tasks, "prompt_key")
    # tasks commit by themselves: version 2 moves a task's file to its place when the task ends
    called(left, factory, max_retries, max_concurrent).write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"
    ).parquet(ledger)
    # a task that ran twice, or a failed reply asked for again, has two rows: a success wins
    found = spark.read.parquet(ledger)
    answer = [c for c in found.columns if c not in keyed.columns]
    one = found.groupBy("prompt_key").agg(
        F.max_by(F.struct(*answer), F.col("status") == SUCCESS).alias("_a")
    )
    return materialize(keyed.drop("prompt").join(one, "prompt_key").select("*", "_a.*").drop("_a"))


def classify_with_model(replies: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Predictions with status and tokens of their batch; a projection of the replies."""
    return classify_batches(replies, classes)


def reply_metrics_input(
    replies: DataFrame, prompt_price: float = 0.0, completion_price: float = 0.0
) -> DataFrame:
    """Batches in the form ``batch_metrics`` reads; prices are per 1000 tokens."""
    cost = (
        F.col("prompt_tokens") * F.lit(prompt_price)
        + F.col("completion_tokens") * F.lit(completion_price)
    ) / F.lit(1000.0)
    return replies.select(
        "batch_id",
        "status",
        "error",
        "total_latency",
        F.when(F.col("status") == SUCCESS, cost).otherwise(F.lit(0.0)).alias("total_cost"),
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        F.col("n_articles").alias("batch_size"),
    )
