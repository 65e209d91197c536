"""Article files and the materialised train/validation split."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.functions.text import strip as stripped
from signpost.operators.articles import dedupe_text, stratified_split
from signpost.session import materialize
from signpost.sources import files

# The columns of an article file.
ARTICLE_SCHEMA = "ArticleId bigint, Text string, Category string"


def read_articles(
    spark: SparkSession, path: str, strip: bool = True, multi_line: bool = True
) -> DataFrame:
    """Articles from CSV files with a header: (article_id, text, label).

    Texts may hold quotes and line breaks; the schema is given, never inferred.
    A file with line breaks inside fields cannot be split, so each file is one
    task: keep such files moderate, or pass ``multi_line=False`` for files whose
    texts hold no line breaks.
    """
    raw = (
        spark.read.schema(ARTICLE_SCHEMA)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    body = stripped(F.col("Text")) if strip else F.col("Text")
    return raw.select(
        F.col("ArticleId").alias("article_id"), body.alias("text"), F.col("Category").alias("label")
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a readable table is there; a folder that a failed job left empty is none."""
    if not files.exists(spark, path):
        return False
    try:
        spark.read.parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return False
        raise
    return True


def ensure_split(
    articles: DataFrame, path: str, validation_share: float = 0.25, seed: int = 42
) -> DataFrame:
    """Write the deduplicated, stratified split once; an existing one is kept.

    ``articles`` has (article_id, text, label), not stripped: texts that differ
    only in outer white space are different texts.
    """
    spark = articles.sparkSession
    if not table_exists(spark, path):
        # ids and labels are split on their own; the texts are moved once, to their side
        unique = materialize(dedupe_text(articles, "article_id").select("article_id", "label"))
        sides = stratified_split(unique, "article_id", "label", validation_share, seed)
        split = articles.join(sides.select("article_id", "split"), "article_id")
        # overwrites what a failed job may have left, never a readable split
        split.write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str, strip: bool = True) -> DataFrame:
    """One side of a written split; only its partition is read."""
    body = stripped(F.col("text")) if strip else F.col("text")
    return (
        spark.read.parquet(path)
        .filter(F.col("split") == split)
        .select("article_id", body.alias("text"), "label")
    )
