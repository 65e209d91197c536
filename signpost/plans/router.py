"""Train a router, classify with it, measure the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.operators.distances import distance_rows
from signpost.operators.embed import DEFAULT_DIMS, EmbedderFactory, embed
from signpost.operators.quality import (
    SUCCESS,
    accuracy,
    averaged_metrics,
    batch_metrics,
    class_report,
    confusion_matrix,
)
from signpost.operators.routes import (
    build_dense_routes,
    build_routes,
    override_thresholds,
    overrides_frame,
    route_references,
)
from signpost.operators.routing import route_articles
from signpost.operators.runs import metric_rows, report_rows
from signpost.operators.thresholds import best_thresholds, exact_counts, threshold_sweep
from signpost.session import materialize


def calibrate(
    routes: DataFrame,
    articles: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    dims: int = DEFAULT_DIMS,
    embedder: str | EmbedderFactory = "hashed",
    only: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """Best threshold per route on labelled articles: (route, threshold, f1).

    Use articles that are scored nowhere else. ``only`` (id) leaves out articles whose
    id it lacks; their distances are taken where they lie and dropped then, so
    that narrow rows are moved and no texts. The thresholds tried are the steps of a
    hundredth, or with ``exact`` every distance up to 1 that an article has.
    """
    labelled = embed(articles.filter(F.col(label_col).isNotNull()), embedder, text_col, dims)
    rows = distance_rows(
        labelled, routes, id_col, "vec", [label_col], sparse=not callable(embedder)
    )
    if only is not None:
        rows = rows.join(only.select(id_col), id_col, "left_semi")
    if exact:
        return best_thresholds(exact_counts(rows, label_col).filter(F.col("threshold") <= 1))
    return best_thresholds(threshold_sweep(rows, label_col))


def train_router(
    articles: DataFrame,
    samples_per_class: int,
    threshold: float,
    agg: str = "avg",
    calibration: DataFrame | None = None,
    overrides: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    dims: int = DEFAULT_DIMS,
    max_chars: int = 500,
    seed: int = 42,
    embedder: str | EmbedderFactory = "hashed",
    texts: DataFrame | None = None,
    calibration_ids: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """Route table from labelled articles: sample, prepare, embed, calibrate, override.

    Built once, with a seeded draw. Calibration (if articles are given) replaces
    the initial threshold; overrides come last and win. ``calibration_ids`` and ``exact``:
    see ``calibrate``.
    """
    references = route_references(
        articles, samples_per_class, id_col, text_col, label_col, seed, max_chars, texts
    )
    if callable(embedder):
        vectors = embed(references, embedder, "ref_text").drop("ref_text")
        routes = build_dense_routes(vectors, threshold, agg)
    else:
        routes = build_routes(references, threshold, agg, dims)
    if calibration is not None:
        best = calibrate(
            routes, calibration, id_col, text_col, label_col, dims, embedder, calibration_ids, exact
        )
        routes = override_thresholds(routes, best.select("route", "threshold"))
    if overrides:
        routes = override_thresholds(routes, overrides_frame(articles.sparkSession, overrides))
    changed = calibration is not None or bool(overrides)
    return materialize(routes) if changed else routes


def classify(
    articles: DataFrame,
    routes: DataFrame,
    classes: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: int = DEFAULT_DIMS,
    overrides: dict[str, float] | None = None,
    embedder: str | EmbedderFactory = "hashed",
) -> DataFrame:
    """Articles with (prediction, distance, confidence, is_fallback) added.

    The article is embedded whole and uncleaned; only references are cut.
    """
    if overrides:
        changed = override_thresholds(routes, overrides_frame(articles.sparkSession, overrides))
        routes = materialize(changed)
    embedded = embed(articles, embedder, text_col, dims)
    return route_articles(
        embedded, routes, classes, id_col, sparse=not callable(embedder)
    ).drop("vec")


def run_metrics(
    batches: DataFrame,
    classified: DataFrame,
    label_col: str = "true_label",
    per_class: bool = False,
) -> DataFrame:
    """All metrics of a run in long form: (category, metric, value).

    With ``per_class`` the report on each class comes along. ``classified`` is read
    several times; pass a written table.
    """
    ok = classified
    if "status" in classified.columns:
        ok = classified.filter(F.col("status") == SUCCESS)
    scores = accuracy(ok, label_col).drop("total_articles", "avg_confidence")
    report = class_report(confusion_matrix(ok, label_col))
    means = averaged_metrics(report)
    parts = [metric_rows(batch_metrics(batches)), metric_rows(scores), metric_rows(means)]
    if per_class:
        parts.append(report_rows(report, means))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def router_batch(
    classified: DataFrame, latency_s: float, usage: DataFrame | None = None
) -> DataFrame:
    """The one batch a router run reports: size, latency, cost and tokens.

    ``usage`` has (tokens, cost) per article; without it both are zero.
    """
    size = classified.agg(F.count(F.lit(1)).alias("batch_size"))
    spent = (
        classified.sparkSession.createDataFrame(
            [(0, 0.0)], "total_tokens bigint, total_cost double"
        )
        if usage is None
        else usage.agg(
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return size.select(
        F.lit("router").alias("batch_id"),
        F.lit(SUCCESS).alias("status"),
        F.lit(float(latency_s)).alias("total_latency"),
        spent.select("total_cost").scalar().alias("total_cost"),
        zero.alias("prompt_tokens"),
        zero.alias("completion_tokens"),
        spent.select("total_tokens").scalar().alias("total_tokens"),
        "batch_size",
    )
