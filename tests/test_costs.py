import pytest
from pyspark.sql import functions as F

from signpost.operators import costs as co


def test_price_lookup_and_default(spark):
    df = spark.createDataFrame(
        [(m[0], " ".join(["w"] * 1000)) for m in co.MODELS] + [("unheard-of", "w w"), (None, "w")],
        "model string, text string",
    )
    got = {r["model"]: r for r in co.with_token_cost(df).collect()}
    for model, _, _, price in co.MODELS:
        assert got[model]["tokens"] == 1300
        assert got[model]["cost"] == pytest.approx(1.3 * price)
    assert got["unheard-of"]["price_per_1k"] == co.DEFAULT_PRICE
    assert got["unheard-of"]["cost"] == pytest.approx(2 / 1000 * co.DEFAULT_PRICE)
    assert got[None]["price_per_1k"] == co.DEFAULT_PRICE


def test_catalogue_agrees_with_the_lookup(spark):
    rows = co.model_catalogue(spark).withColumn("p", co.price_of(F.col("model"))).collect()
    assert len(rows) == 5 and all(r["p"] == r["price_per_1k"] for r in rows)
    providers = co.model_catalogue(spark).withColumn("q", co.provider_of(F.col("model"))).collect()
    assert all(r["q"] == r["provider"] for r in providers)


def test_embedding_cost(spark):
    df = spark.createDataFrame(
        [("text-embedding-3-small", "a b c"), ("text-embedding-3-small", ""), ("x", "a")],
        "model string, text string",
    )
    got = {r["model"]: r for r in co.embedding_cost(df).collect()}
    small = got["text-embedding-3-small"]
    assert (small["total_texts"], small["total_tokens"]) == (2, 3)
    assert small["cost_per_text"] == pytest.approx(3 / 1000 * 0.00002 / 2)
    assert small["avg_tokens_per_text"] == 1.5


def test_ledger_counts_tracked_paid_usage_only(spark):
    df = spark.createDataFrame(
        [("text-embedding-3-large", "a b c d"), ("local-model", "a b c d")],
        "model string, text string",
    )
    usage = co.usage_rows(df, "training").unionByName(
        co.usage_rows(df, "classification", track_usage=False)
    )
    got = {(r["phase"], r["provider"]): r for r in co.cost_ledger(usage).collect()}
    paid = got["training", "openai"]
    assert (paid["calls"], paid["tokens"]) == (1, 5)
    assert paid["avg_cost_per_call"] == pytest.approx(5 / 1000 * 0.00013)
    for key, r in got.items():
        if key != ("training", "openai"):
            assert (r["calls"], r["tokens"], r["cost"], r["avg_cost_per_call"]) == (0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        co.usage_rows(df, "other")
