"""Embedding of texts: hashed terms in SQL, or a model plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signpost.checks import one_of
from signpost.functions.vectors import hashed_vector, unit_dense

DEFAULT_DIMS = 256

# Takes nothing, runs once per task, and returns texts -> one vector per text.
EmbedderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def embed_hashed(
    df: DataFrame, text_col: str = "text", dims: int = DEFAULT_DIMS, vec_col: str = "vec"
) -> DataFrame:
    """Add the sparse unit vector of the text; a projection, no shuffle."""
    return df.withColumn(vec_col, hashed_vector(F.col(text_col), dims))


def embed_with(
    df: DataFrame, factory: EmbedderFactory, text_col: str = "text", vec_col: str = "vec"
) -> DataFrame:
    """Add the dense unit vector made by a plugged-in model, one Arrow batch at a time."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            vectors = np.asarray(model(texts.fillna("").tolist()), dtype="float64")
            yield pd.Series(list(vectors))

    return df.withColumn(vec_col, unit_dense(embed(F.col(text_col))))


def embed(
    df: DataFrame,
    embedder: str | EmbedderFactory = "hashed",
    text_col: str = "text",
    dims: int = DEFAULT_DIMS,
    vec_col: str = "vec",
) -> DataFrame:
    """Embed with the built-in embedder ("hashed": sparse) or a factory (dense)."""
    if callable(embedder):
        return embed_with(df, embedder, text_col, vec_col)
    one_of("embedder", embedder, ("hashed",))
    return embed_hashed(df, text_col, dims, vec_col)


def vector_rows(df: DataFrame, id_col: str = "doc_id", vec_col: str = "vec") -> DataFrame:
    """Long form of a sparse vector: (id, dim, v)."""
    # the outer form: for a plain one Spark infers a filter on the array and
    # pushes a second copy of the whole embedding below it
    return (
        df.select(id_col, F.inline_outer(vec_col))
        .filter(F.col("dim").isNotNull())
        .select(id_col, F.col("dim").cast("bigint").alias("dim"), F.col("val").alias("v"))
    )
