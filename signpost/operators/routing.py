"""Routing: best and nearest routes of articles, those without one, the fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.functions import scoring
from signpost.functions import vectors as vx
from signpost.operators.distances import MAX_CELLS, candidate_routes


def with_best_route(df: DataFrame) -> DataFrame:
    """Turn ``candidates`` into (route, distance); both null where nothing matched.

    Of each article only the first candidate is read, so there is one row per
    article. Unfolding it, instead of picking fields of it, keeps filters on the
    route above the distances: pushed below, they would compute them again.
    """
    others = [c for c in df.columns if c != "candidates"]
    return df.select(*others, F.inline_outer(F.slice("candidates", 1, 1))).select(
        *others, "route", "distance"
    )


def top_routes(df: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Turn ``candidates`` into rows (id, rank, route, distance)."""
    return (
        df.select(id_col, F.posexplode_outer("candidates").alias("_pos", "_c"))
        .filter(F.col("_pos").isNotNull())
        .select(
            id_col,
            (F.col("_pos") + 1).cast("bigint").alias("rank"),
            F.col("_c.route").alias("route"),
            F.col("_c.distance").alias("distance"),
        )
    )


def is_matched(route: str = "route") -> Column:
    """A match needs a route with a name."""
    return F.coalesce(F.col(route) != "", F.lit(False))


def unrouted(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the articles that no route took."""
    return df.filter(~is_matched()).select(id_col)


def apply_fallback(
    df: DataFrame,
    classes: Sequence[str],
    prediction: str = "route",
    confidence: Column | None = None,
    fallback_confidence: float | None = scoring.FALLBACK_CONFIDENCE,
) -> DataFrame:
    """Add (prediction, confidence, is_fallback).

    A prediction outside ``classes`` (any case), the name for "no class", or none
    at all becomes the first class with ``fallback_confidence``.
    """
    valid = scoring.is_valid_class(F.col(prediction), classes)
    first = scoring.valid_classes(classes)[0]
    made = confidence if confidence is not None else F.lit(None).cast("double")
    return (
        df.withColumn("_valid", valid)
        .withColumn(
            "confidence",
            F.when(F.col("_valid"), made).otherwise(F.lit(fallback_confidence).cast("double")),
        )
        .withColumn(
            "prediction",
            F.when(F.col("_valid"), F.lower(F.col(prediction))).otherwise(F.lit(first)),
        )
        .withColumn("is_fallback", ~F.col("_valid"))
        .drop("_valid")
    )


def route_articles(
    df: DataFrame,
    routes: DataFrame,
    classes: Sequence[str],
    id_col: str = "doc_id",
    vec: str = "vec",
    sparse: bool = True,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Nearest route of each article, or the fallback.

    Adds (prediction, distance, confidence, is_fallback).
    """
    matched = with_best_route(
        candidate_routes(df, routes, id_col, vec, 1, True, sparse, max_cells)
    )
    return apply_fallback(matched, classes, "route", vx.confidence(F.col("distance"))).drop("route")
