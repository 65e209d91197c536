"""Model catalogue, embedding cost and the cost ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signpost.checks import one_of
from signpost.functions.scoring import ratio, token_cost
from signpost.functions.text import token_estimate

# Fixed values: (model, provider, dimensions, price per 1000 tokens in USD).
MODELS = [
    ("text-embedding-3-small", "openai", 1536, 0.00002),
    ("text-embedding-3-large", "openai", 3072, 0.00013),
    ("text-embedding-ada-002", "openai", 1536, 0.0001),
    ("sentence-transformers/all-MiniLM-L6-v2", "huggingface", 384, 0.0),
    ("sentence-transformers/all-mpnet-base-v2", "huggingface", 768, 0.0),
]
# The price of a model outside the catalogue, and how a model's
# name tells its provider.
DEFAULT_PRICE = 0.00002
PAID_PROVIDER = "openai"
FREE_PROVIDER = "huggingface"
PAID_PREFIX = "text-embedding"


def model_catalogue(spark: SparkSession) -> DataFrame:
    """The fixed five models: (model, provider, dims, price_per_1k)."""
    return spark.createDataFrame(
        MODELS, "model string, provider string, dims int, price_per_1k double"
    )


def provider_of(model: Column) -> Column:
    return F.when(F.startswith(model, F.lit(PAID_PREFIX)), PAID_PROVIDER).otherwise(FREE_PROVIDER)


def price_of(model: Column) -> Column:
    """Price lookup by model; five entries, so a constant map in the plan instead of a join."""
    known = F.create_map(*[F.lit(x) for m in MODELS for x in (m[0], m[3])])
    return F.coalesce(F.try_element_at(known, model), F.lit(DEFAULT_PRICE))


def with_token_cost(
    df: DataFrame, text_col: str = "text", model_col: str = "model"
) -> DataFrame:
    """Add (tokens, price_per_1k, cost) of embedding each text with its model."""
    return (
        df.withColumn("tokens", token_estimate(F.col(text_col)))
        .withColumn("price_per_1k", price_of(F.col(model_col)))
        .withColumn("cost", token_cost(F.col("tokens"), F.col("price_per_1k")))
    )


def embedding_cost(
    df: DataFrame, text_col: str = "text", model_col: str = "model"
) -> DataFrame:
    """Per model: texts, tokens, cost, and their means per text."""
    return (
        with_token_cost(df, text_col, model_col)
        .groupBy(F.col(model_col).alias("model"))
        .agg(
            F.count(F.lit(1)).alias("total_texts"),
            F.sum("tokens").alias("total_tokens"),
            F.sum("cost").alias("total_cost"),
            F.max("price_per_1k").alias("price_per_1k_tokens"),
        )
        .withColumn("cost_per_text", ratio(F.col("total_cost"), F.col("total_texts")))
        .withColumn("avg_tokens_per_text", ratio(F.col("total_tokens"), F.col("total_texts")))
    )


def usage_rows(
    df: DataFrame,
    phase: str,
    text_col: str = "text",
    model_col: str = "model",
    track_usage: bool = True,
) -> DataFrame:
    """(phase, provider, calls, tokens, cost) of each embedded text.

    Pass prepared reference texts for training and whole articles for
    classification. Usage counts only for the paid provider and only if tracked.
    """
    one_of("phase", phase, ("training", "classification"))
    provider = provider_of(F.col(model_col))
    counted = (provider == PAID_PROVIDER) & F.lit(track_usage)
    zero = F.lit(0).cast("bigint")
    return with_token_cost(df, text_col, model_col).select(
        F.lit(phase).alias("phase"),
        provider.alias("provider"),
        F.when(counted, F.lit(1).cast("bigint")).otherwise(zero).alias("calls"),
        F.when(counted, F.col("tokens")).otherwise(zero).alias("tokens"),
        F.when(counted, F.col("cost")).otherwise(F.lit(0.0)).alias("cost"),
    )


def cost_ledger(usage: DataFrame) -> DataFrame:
    """Per phase and provider: calls, tokens, cost and the mean cost per call."""
    return (
        usage.groupBy("phase", "provider")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("tokens").alias("tokens"),
            F.sum("cost").alias("cost"),
        )
        .withColumn("avg_cost_per_call", ratio(F.col("cost"), F.col("calls")))
    )
