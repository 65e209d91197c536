"""Answers that must not depend on the way, the neighbours or the clock."""

import pytest
from pyspark.sql import functions as F

from signpost.operators import distances as di
from signpost.operators import inference as inf
from signpost.operators import runs as ru

REPLIES = {
    1: '{"article_id": 1, "category": "tech"} {"article_id": 2, "category": "sp\\qort"}',
    2: '{"article_id": 1, "category": "tech"} {"article_id": 007, "category": "x"}',
    3: '{"classifications": [{"category": "tech", "article_id": 3}]} and {thanks}',
    4: "{'classifications': [{'article_id': 4, 'category': 'tech'}], \"classifications\": 1}",
    5: 'Here: {"classifications": [{"category": "tech", "article_id": 5}]} done',
}


def test_a_broken_object_costs_only_itself(spark):
    df = spark.createDataFrame(list(REPLIES.items()), "batch_id bigint, reply string")
    got = {(r["batch_id"], r["article_id"]): r["category"] for r in inf.parse_replies(df).collect()}
    assert got == {(1, 1): "tech", (2, 1): "tech", (5, 5): "tech"}


def test_latest_run_over_the_repeated_hour(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        runs = spark.createDataFrame(
            [("a", "early", 1793512200), ("a", "late", 1793513400)],
            "result_type string, run_id string, at bigint",
        ).withColumn("modified_at", F.timestamp_seconds("at"))
        assert ru.latest_run(runs).first()["run_id"] == "late"
        listed = ru.run_listing(runs).filter("is_latest").collect()
        assert [r["run_id"] for r in listed] == ["late"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("k", [1, 3])
def test_all_ways_answer_alike(spark, k):
    nan = float("nan")
    docs = spark.createDataFrame(
        [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [nan, 0.0]), (4, [0.6, 0.8])],
        "doc_id bigint, vec array<double>",
    )
    routes = spark.createDataFrame(
        [(n, i, 2.0, v) for i, (n, v) in enumerate({"x": [1.0, 0.0], "y": [0.0, 1.0], "z": [0.8, 0.6]}.items())],
        "route string, ref_id bigint, threshold double, vec array<double>",
    )
    found = []
    for how in ({}, {"row_cells": 1}, {"max_cells": 2}):
        rows = di.candidate_routes(docs, routes, k=k, sparse=False, **how).collect()
        found.append(sorted((r["doc_id"], str(r["vec"]), str(r["candidates"])) for r in rows))
    assert found[0] == found[1] == found[2]
    by = {(d, v): c for d, v, c in found[0]}
    assert by[(2, "None")] == "[]" and "route='y'" in by[(1, "[0.0, 1.0]")]


def test_plan_does_not_grow_with_the_routes(spark):
    import time

    many = spark.range(8000).select(
        F.concat(F.lit("r"), "id").alias("route"),
        F.col("id").alias("ref_id"),
        F.lit(2.0).alias("threshold"),
        F.array(*[F.rand(i) for i in range(16)]).alias("vec"),
    )
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.array(*[F.rand(i) for i in range(16)]).alias("vec"))
    routes = many.cache()
    routes.count()
    start = time.perf_counter()
    out = di.candidate_routes(docs, routes, k=3, sparse=False)
    assert time.perf_counter() - start < 10
    assert all(len(r["candidates"]) == 3 for r in out.collect())
