"""Runs as one call: classify, measure in the same pass, save, commit."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from signpost.operators.costs import with_token_cost
from signpost.operators.embed import DEFAULT_DIMS, EmbedderFactory
from signpost.operators.inference import Complete, Prompt
from signpost.operators.quality import FAILED, SUCCESS
from signpost.operators.routes import override_thresholds, overrides_frame, router_info
from signpost.operators.runs import classification_rows
from signpost.plans.batch_inference import (
    classify_with_model,
    planned_prompts,
    reply_metrics_input,
    resumed_replies,
)
from signpost.plans.router import classify, run_metrics
from signpost.session import materialize, scratch
from signpost.sources import run_store
from signpost.sources.route_store import current_version, load_routes


def _report_input(rows: DataFrame) -> DataFrame:
    """Stored report rows in the form that ``run_metrics`` reads."""
    ok = F.col("batch_status") == SUCCESS
    return rows.select(
        "true_label",
        "prediction",
        F.lit(None).cast("double").alias("confidence"),
        F.when(ok, SUCCESS).otherwise(FAILED).alias("status"),
    )


def _label(label_col: str | None) -> Column:
    return (F.lit(None) if label_col is None else F.col(label_col)).cast("string")


def _owning(plan):
    """A run reads its own tables to the end and leaves none behind."""

    @functools.wraps(plan)
    def owned(articles: DataFrame, *args, **how) -> str:
        with scratch(articles.sparkSession):
            return plan(articles, *args, **how)

    return owned


@_owning
def run_router(
    articles: DataFrame,
    routes_path: str,
    classes: Sequence[str],
    base: str,
    run: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str | None = "lang",
    overrides: dict[str, float] | None = None,
    model: str = "hashed",
    dims: int = DEFAULT_DIMS,
    embedder: str | EmbedderFactory = "hashed",
    pipeline_config: dict | None = None,
) -> str:
    """Load the stored routes, route every article, save the run and commit it; the run's id.

    Articles are read once: rows, fallbacks, confidence, tokens and cost are observed while
    the report rows are written, and so is the time. The metrics are made from the rows read
    back. The run info says what classified: the model, the version of the route table, and
    every route with its threshold and references. Without stored routes it is an error,
    and a run that fails on the way is not committed. ``model`` names the price of a token.
    """
    spark = articles.sparkSession
    version = current_version(spark, routes_path)
    routes = None if version is None else load_routes(spark, routes_path, version)
    if routes is None:
        raise ValueError(f"no trained routes under {routes_path}")
    if overrides:
        routes = materialize(override_thresholds(routes, overrides_frame(spark, overrides)))
    run = run or run_store.new_run_id(spark)
    routed = with_token_cost(
        classify(articles, routes, classes, id_col, text_col, dims, embedder=embedder).withColumn(
            "model", F.lit(model)
        ),
        text_col,
    )
    seen = Observation(f"router-{run}")
    observed = routed.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("is_fallback")).alias("fallbacks"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
    )
    rows = classification_rows(
        observed.select(
            F.lit("router").alias("batch_id"),
            F.col(id_col).alias("article_id"),
            "prediction",
            _label(label_col).alias("true_label"),
            F.lit(SUCCESS).alias("status"),
            F.lit(None).cast("string").alias("error"),
            F.col(text_col).alias("text"),
        )
    )
    start = time.perf_counter()
    written = {"classifications": run_store.save_classifications(rows, base, run)}
    facts = {"seconds": time.perf_counter() - start} | seen.get
    batch = spark.createDataFrame(
        [("router", SUCCESS, facts["seconds"], facts["cost"], 0, 0, facts["tokens"], facts["rows"])],
        "batch_id string, status string, total_latency double, total_cost double, "
        "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, batch_size bigint",
    )
    stored = spark.read.schema(rows.schema).options(header=True, escape='"').csv(written["classifications"])
    metrics = run_metrics(batch, _report_input(stored), per_class=True)
    written["metrics"] = run_store.save_metrics(metrics, base, run)
    # one row per route
    info = {
        r["route"]: {
            "references_count": r["references_count"],
            "distance_threshold": r["threshold"],
            "metadata": r["metadata"],
        }
        for r in router_info(routes).collect()
    }
    classifier = {
        "classifier_type": "semantic_router",
        "embedding_model": model,
        "routes_version": version,
        "total_routes": len(info),
        "routes": info,
    }
    run_store.save_run_info(spark, base, run, classifier, pipeline_config, facts, written)
    return run


@_owning
def run_model(
    articles: DataFrame,
    classes: Sequence[str],
    factory: Callable[[], Complete],
    base: str,
    run: str | None = None,
    batch_size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str | None = "lang",
    model: str = "model",
    prompt_price: float = 0.0,
    completion_price: float = 0.0,
    max_retries: int = 3,
    max_concurrent: int | None = None,
    calls_per_task: int = 500,
    template: Prompt = Prompt(),
    pipeline_config: dict | None = None,
) -> str:
    """Ask the model about every batch, save the run and commit it; the run's id.

    A run that was broken off is resumed by starting it again with its id: replies that its
    ledger, ``<base>/ledger/run_id=<id>``, holds already are not asked for again. Ids of
    articles are whole numbers and unique. Prices are per 1000 tokens.
    """
    spark = articles.sparkSession
    run = run or run_store.new_run_id(spark)
    start = time.perf_counter()
    prompts = planned_prompts(articles, classes, batch_size, id_col, text_col, calls_per_task, template)
    ledger = f"{base.rstrip('/')}/ledger/run_id={run}"
    replies = resumed_replies(
        prompts, factory, ledger, max_retries, max_concurrent, calls_per_task=calls_per_task
    )
    seen = Observation(f"model-{run}")
    predicted = classify_with_model(replies, classes).observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("is_fallback")).alias("fallbacks"),
    )
    # the preview needs the first characters only, so no whole text is moved
    about = articles.select(
        F.col(id_col).alias("article_id"),
        _label(label_col).alias("true_label"),
        F.substring(text_col, 1, 101).alias("text"),
    )
    rows = classification_rows(predicted.join(about, "article_id"))
    written = {"classifications": run_store.save_classifications(rows, base, run)}
    facts = {"seconds": time.perf_counter() - start} | seen.get
    stored = spark.read.schema(rows.schema).options(header=True, escape='"').csv(written["classifications"])
    batches = reply_metrics_input(replies, prompt_price, completion_price)
    metrics = run_metrics(batches, _report_input(stored), per_class=True)
    written["metrics"] = run_store.save_metrics(metrics, base, run)
    classifier = {
        "classifier_type": "model",
        "model": model,
        "batch_size": batch_size,
        "max_retries": max_retries,
        "classes": list(classes),
        "prices_per_1k": {"prompt": prompt_price, "completion": completion_price},
    }
    run_store.save_run_info(spark, base, run, classifier, pipeline_config, facts, written)
    return run
