"""Routes: reference vectors per class, thresholds, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.checks import fraction
from signpost.functions.text import reference_text
from signpost.functions.vectors import let
from signpost.operators.articles import sample_per_class
from signpost.operators.embed import DEFAULT_DIMS, embed_hashed
from signpost.operators.lookup import rows_by_id
from signpost.session import materialize


def route_references(
    articles: DataFrame,
    samples_per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    seed: int = 42,
    max_chars: int = 500,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Sampled reference texts of every class: (route, ref_id, ref_text).

    ``texts`` (id, text) is where the texts are read if ``articles`` is a narrow
    selection of them, such as one side of a split. The sample is drawn from ids
    and labels alone and written; the texts are then read only from the files
    that hold a sampled row.
    """
    picked = materialize(sample_per_class(articles, samples_per_class, id_col, label_col, seed))
    source = (articles if texts is None else texts).select(id_col, text_col)
    ids = picked.select(id_col, F.col(label_col).alias("route"))
    return rows_by_id(source, ids, id_col).select(
        "route",
        F.col(id_col).alias("ref_id"),
        reference_text(F.col(text_col), max_chars).alias("ref_text"),
    )


def _means(references: DataFrame, vec_col: str) -> DataFrame:
    """Mean per (route, dim), with a row at dimension -1 for every route."""
    # one entry more per reference counts them in the same pass
    marker = F.struct(F.lit(-1).alias("dim"), F.lit(1.0).alias("val"))
    sums = (
        references.select("route", F.inline_outer(F.concat(F.col(vec_col), F.array(marker))))
        .filter(F.col("dim").isNotNull())
        .groupBy("route", "dim")
        .agg(F.sum("val").alias("_sum"))
    )
    size = F.max(F.when(F.col("dim") < 0, F.col("_sum"))).over(Window.partitionBy("route"))
    return sums.withColumn("_n", size).select(
        "route",
        F.col("dim").cast("bigint").alias("dim"),
        (F.col("_sum") / F.col("_n")).alias("v"),
        F.col("_n").cast("bigint").alias("references_count"),
    )


def centroid_rows(references: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Mean of the sparse unit vectors of each route, long form: (route, dim, v).

    For unit vectors the mean distance to a route's references is one minus the
    dot product with their mean, so this is all an average-distance router needs.
    """
    return _means(references, vec_col).filter("dim >= 0").drop("references_count")


def _dense(entries: Column, dims: int) -> Column:
    """Array of ``dims`` doubles from an array of (dim, v) structs."""
    return let(
        F.map_from_entries(entries),
        lambda slots: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda d: F.coalesce(F.element_at(slots, d.cast("bigint")), F.lit(0.0)),
        ),
    )


def build_routes(
    references: DataFrame,
    threshold: float,
    agg: str = "avg",
    dims: int = DEFAULT_DIMS,
    text_col: str = "ref_text",
) -> DataFrame:
    """Vectors the router compares with, written once.

    (route, ref_id, threshold, vec, references_count): ``agg="avg"`` keeps one
    centroid per route (ref_id 0), ``agg="min"`` keeps every reference. Vectors
    are dense arrays of ``dims`` doubles; the count says how many references a
    vector stands for.
    """
    fraction("threshold", threshold)
    embedded = embed_hashed(references, text_col, dims)
    if agg == "avg":
        # the row at -1 keeps a route whose references have no words at all
        entry = F.when(F.col("dim") >= 0, F.struct("dim", "v"))
        entries = (
            _means(embedded, "vec")
            .groupBy("route")
            .agg(
                F.collect_list(entry).alias("_entries"),
                F.max("references_count").alias("references_count"),
            )
            .withColumn("ref_id", F.lit(0).cast("bigint"))
        )
    elif agg == "min":
        entries = embedded.select(
            "route",
            "ref_id",
            F.transform(
                "vec",
                lambda e: F.struct(e["dim"].cast("bigint").alias("dim"), e["val"].alias("v")),
            ).alias("_entries"),
            F.lit(1).cast("bigint").alias("references_count"),
        )
    else:
        raise ValueError(f"agg must be 'avg' or 'min', got {agg!r}")
    return materialize(
        entries.select(
            "route",
            "ref_id",
            F.lit(float(threshold)).alias("threshold"),
            _dense(F.col("_entries"), dims).alias("vec"),
            "references_count",
        )
    )


def build_dense_routes(
    vectors: DataFrame, threshold: float, agg: str = "avg", vec_col: str = "vec"
) -> DataFrame:
    """Same table from vectors that are dense already: (route, ref_id, vec) in."""
    fraction("threshold", threshold)
    if agg == "avg":
        # every reference has every dimension, so the mean per dimension is the centroid
        means = (
            vectors.select("route", F.posexplode(vec_col).alias("dim", "val"))
            .groupBy("route", "dim")
            .agg(
                F.avg(F.col("val").cast("double")).alias("v"),
                F.count(F.lit(1)).alias("references_count"),
            )
        )
        rows = (
            means.groupBy("route")
            .agg(
                F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("_entries"),
                F.max("references_count").alias("references_count"),
            )
            .select(
                "route",
                F.lit(0).cast("bigint").alias("ref_id"),
                F.transform("_entries", lambda e: e["v"]).alias("vec"),
                "references_count",
            )
        )
    elif agg == "min":
        rows = vectors.select(
            "route",
            "ref_id",
            F.col(vec_col).cast("array<double>").alias("vec"),
            F.lit(1).cast("bigint").alias("references_count"),
        )
    else:
        raise ValueError(f"agg must be 'avg' or 'min', got {agg!r}")
    return materialize(
        rows.select(
            "route",
            "ref_id",
            F.lit(float(threshold)).alias("threshold"),
            "vec",
            "references_count",
        )
    )


def route_summary(
    articles: DataFrame,
    references: DataFrame,
    threshold: float,
    label_col: str = "lang",
) -> DataFrame:
    """Per route: articles of the class, references kept, threshold, metadata."""
    totals = (
        articles.filter(F.col(label_col).isNotNull())
        .groupBy(F.lower(F.col(label_col)).alias("route"))
        .agg(F.count(F.lit(1)).alias("total"))
    )
    kept = references.groupBy("route").agg(F.count(F.lit(1)).alias("references_count"))
    return totals.join(kept, "route").select(
        "route",
        "total",
        "references_count",
        F.lit(float(threshold)).alias("threshold"),
        _metadata(),
    )


def _metadata() -> Column:
    return F.create_map(
        F.lit("category"),
        F.col("route"),
        F.lit("samples_count"),
        F.col("references_count").cast("string"),
    ).alias("metadata")


def router_info(routes: DataFrame) -> DataFrame:
    """What a route table says of its routes: references, threshold now, metadata."""
    return (
        routes.groupBy("route")
        .agg(
            F.sum("references_count").alias("references_count"),
            F.max("threshold").alias("threshold"),
        )
        .select("route", "references_count", "threshold", _metadata())
    )


def override_thresholds(routes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace thresholds of routes named exactly (case matters); others keep theirs.

    ``overrides`` has (route, threshold); names that match no route are ignored.
    """
    replacement = overrides.select("route", F.col("threshold").cast("double").alias("_new"))
    return routes.join(replacement, "route", "left").withColumn(
        "threshold", F.coalesce("_new", "threshold")
    ).drop("_new")


def overrides_frame(spark, overrides: dict[str, float]) -> DataFrame:
    """The literal overrides of a run as a table; values are checked."""
    for name, value in overrides.items():
        fraction(f"threshold of route {name}", value)
    return spark.createDataFrame(
        [(k, float(v)) for k, v in overrides.items()], "route string, threshold double"
    )
