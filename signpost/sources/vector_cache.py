"""Vectors of texts by content: a model is asked once for each text, whoever holds it.

    <path>/model=<name>/*.parquet        (digest, vec)

A vector belongs to the SHA-256 of its text and to its model. What the cache lacks is
found by an anti-join of digests; each missing text is embedded once however many rows
have it, and appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.operators.embed import EmbedderFactory, embed_with
from signpost.session import materialize
from signpost.sources import files


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _folder(path: str, model: str) -> str:
    if not model or "/" in model:
        raise ValueError(f"a model's name must be a folder's name, got {model!r}")
    return f"{path.rstrip('/')}/model={model}"


def cached_vectors(spark, path: str, model: str) -> DataFrame | None:
    """(digest, vec) of a model, one row per text; None if it has none."""
    folder = _folder(path, model)
    if not files.names(spark, folder):
        return None
    # two runs at once may both have added a text
    return spark.read.parquet(folder).dropDuplicates(["digest"])


def add_missing(
    df: DataFrame, factory: EmbedderFactory, path: str, model: str, text_col: str = "text", partitions: int | None = None
) -> None:
    """Embed the texts of ``df`` that the cache lacks, once each; null counts as empty.

    Copies are folded before texts are moved, and the calls are spread over ``partitions``
    (one per core by default). Tasks put their vectors into the cache as they
    end, so a job that is broken off keeps what it paid for.
    """
    spark = df.sparkSession
    texts = df.select(_digest(text_col).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    known = cached_vectors(spark, path, model)
    if known is not None:
        texts = texts.join(known.select("digest"), "digest", "left_anti")
    # written, so that the model is called for a settled set of texts
    once = materialize(texts.dropDuplicates(["digest"]))
    spread = once.repartition(partitions or spark.sparkContext.defaultParallelism, "digest")
    embed_with(spread, factory, "_text").select("digest", "vec").write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"
    ).parquet(_folder(path, model))


def embed_cached(
    df: DataFrame,
    factory: EmbedderFactory,
    path: str,
    model: str,
    text_col: str = "text",
    vec_col: str = "vec",
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with the dense unit vector of every text, from the cache, which is filled first.

    Rows are joined with their vector by digest; every row stays, in no particular order.
    """
    add_missing(df, factory, path, model, text_col, partitions)
    found = cached_vectors(df.sparkSession, path, model)
    keyed = df.withColumn("_digest", _digest(text_col))
    vectors = found.select(F.col("digest").alias("_digest"), F.col("vec").alias(vec_col))
    return keyed.join(vectors, "_digest", "left").drop("_digest")
