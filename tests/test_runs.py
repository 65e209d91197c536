import datetime as dt
import math
import time

import pytest
from pyspark.sql import functions as F

from signpost import queries
from signpost.operators import runs as ru
from signpost.operators.embed import embed_hashed
from signpost.operators.routes import build_routes
from signpost.plans.comparison import compare_stored_runs
from signpost.plans.router import classify, router_batch, run_metrics
from signpost.sources import articles as sa
from signpost.sources import route_store as rs
from signpost.sources import run_store as st


def test_report_rows(spark):
    df = spark.createDataFrame(
        [
            (1, 10, "a", "A", "success", None, "x\r\ny"),
            (1, 11, "a", None, "success", None, "z" * 101),
            (2, 12, "a", "B", "failed", "boom", "t"),
            (3, 13, "b", "a", "success", None, None),
        ],
        "batch_id bigint, article_id bigint, prediction string, true_label string, "
        "status string, error string, text string",
    )
    rows = ru.classification_rows(df).orderBy("article_id").collect()
    assert rows[0].asDict() == {
        "batch_id": "1", "article_id": 10, "prediction": "a", "true_label": "a",
        "correct": True, "batch_status": "success", "article_text_preview": "x  y",
    }
    assert rows[1]["correct"] is None and rows[1]["article_text_preview"] == "z" * 100 + "..."
    assert (rows[2]["prediction"], rows[2]["correct"]) == (None, None)
    assert rows[2]["batch_status"] == "failed: boom"
    assert rows[3]["correct"] is False
    assert list(rows[0].asDict()) == [
        "batch_id", "article_id", "prediction", "true_label", "correct", "batch_status",
        "article_text_preview",
    ]


def test_categories(spark):
    df = spark.createDataFrame([(1, 2.5, 3.0, 4.0, 5.0)],
                               "total_batches int, total_cost double, total_latency double, "
                               "f1_macro double, novel double")
    got = {r["metric"]: (r["category"], r["value"]) for r in ru.metric_rows(df).collect()}
    assert got == {
        "total_batches": ("performance_metrics", 1.0),
        "total_cost": ("cost_metrics", 2.5),
        "total_latency": ("latency_metrics", 3.0),
        "f1_macro": ("classification_metrics", 4.0),
        "novel": ("performance_metrics", 5.0),
    }


def test_comparison_edges(spark):
    def metrics(**values):
        return spark.createDataFrame(list(values.items()), "metric string, value string")

    got = {
        r["metric"]: r
        for r in ru.compare_runs(
            metrics(accuracy="0.5", total_latency="10", total_cost="4", f1_macro="0", only="1",
                    cost_per_article="1", text="abc", avg_latency="1"),
            metrics(accuracy="0.75", total_latency="2", total_cost="1", f1_macro="0.5",
                    cost_per_article="2", text="1", avg_latency="0"),
            ["accuracy", "total_latency", "total_cost", "f1_macro", "only", "text",
             "cost_per_article", "avg_latency"],
        ).collect()
    }
    assert set(got) == {"accuracy", "total_latency", "total_cost", "f1_macro",
                        "cost_per_article", "avg_latency"}
    assert got["accuracy"]["improvement_ratio"] == 1.5
    assert got["accuracy"]["improvement_pct"] == 50.0
    assert (got["accuracy"]["speedup"], got["accuracy"]["savings_pct"]) == (None, None)
    assert got["total_latency"]["speedup"] == 5.0
    assert got["total_cost"]["savings_pct"] == 75.0
    assert got["cost_per_article"]["savings_pct"] == 0.0
    assert math.isinf(got["f1_macro"]["improvement_ratio"])
    assert math.isinf(got["avg_latency"]["speedup"])


def test_run_ids_and_listing(spark):
    at = dt.datetime(2024, 3, 1, 10, 20, 30)
    df = spark.createDataFrame([(at,)], "t timestamp")
    made = df.select(ru.run_id(F.col("t")).alias("r"), "t").withColumn("back", ru.run_time(F.col("r")))
    row = made.first()
    assert row["r"].startswith("2024-03-01_10-20-30_") and len(row["r"]) == 20 + 36
    assert row["back"] == at
    runs = spark.createDataFrame(
        [("x", "r2", at), ("x", "r1", at), ("x", "old", at - dt.timedelta(1)), ("y", "q", at)],
        "result_type string, run_id string, modified_at timestamp",
    )
    listed = ru.run_listing(runs).collect()
    assert [r["run_id"] for r in listed] == ["q", "r1", "r2", "old"]
    assert {r["run_id"]: r["runs_of_type"] for r in listed} == {"q": 1, "r1": 3, "r2": 3, "old": 3}
    assert {r["run_id"] for r in listed if r["is_latest"]} == {"q", "r1"}
    latest = {r["result_type"]: r["run_id"] for r in ru.latest_run(runs, {"x": "old"}).collect()}
    assert latest == {"x": "old", "y": "q"}


def test_stored_runs_round_trip_and_compare(spark, tmp_path):
    base = {"baseline": str(tmp_path / "b"), "semantic": str(tmp_path / "s")}

    def store(side, run, accuracy, cost):
        metrics = ru.metric_rows(
            spark.createDataFrame([(accuracy, cost)], "accuracy double, total_cost double")
        )
        rows = spark.createDataFrame(
            [("1", 5, "a", None, None, "success", 'say "hi", \\ done')],
            "batch_id string, article_id bigint, prediction string, true_label string, "
            "correct boolean, batch_status string, article_text_preview string",
        )
        st.save_classifications(rows, base[side], run)
        st.save_metrics(metrics, base[side], run)
        st.save_run_info(spark, base[side], run, {"samples": 5}, {"agg": "avg"})
        return rows.collect()

    assert st.run_summary(spark, base["baseline"], "none") is None
    with pytest.raises(ValueError):
        compare_stored_runs(spark, base["baseline"], base["semantic"])
    rows = store("baseline", "run-1", 0.5, 4.0)
    time.sleep(1.1)
    store("baseline", "run-2", 0.8, 4.0)
    store("baseline", "run-2", 0.8, 4.0)  # repeated: still one copy
    store("semantic", "run-3", 0.9, 1.0)
    back = st.read_classifications(spark, base["baseline"], "run-1").drop("run_id").collect()
    assert [r.asDict() for r in back] == [r.asDict() for r in rows]
    summary = st.run_summary(spark, base["baseline"], "run-2")
    assert summary["has_classifications"] and summary["metrics"].count() == 2
    assert summary["run_info"].first()["classifier_config"] == '{"samples": 5}'
    assert st.run_summary(spark, base["baseline"], "run-9") is None
    listed = ru.run_listing(st.stored_runs(spark, {**base, "gone": str(tmp_path / "no")}))
    assert {(r["result_type"], r["run_id"]) for r in listed.collect()} == {
        ("baseline", "run-1"), ("baseline", "run-2"), ("semantic", "run-3"),
    }
    out = str(tmp_path / "c")
    latest = {r["metric"]: r for r in compare_stored_runs(
        spark, base["baseline"], base["semantic"], save_to=out).collect()}
    assert latest["accuracy"]["baseline"] == 0.8 and latest["total_cost"]["savings_pct"] == 75.0
    named = compare_stored_runs(spark, base["baseline"], base["semantic"], baseline_run="run-1")
    assert {r["metric"]: r["baseline"] for r in named.collect()}["accuracy"] == 0.5
    with pytest.raises(ValueError):
        compare_stored_runs(spark, base["baseline"], base["semantic"], semantic_run="run-9")
    assert spark.read.json(f"{out}/compared_metrics").count() == 4
    assert spark.read.json(f"{out}/comparison").count() == 2


def test_route_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "routes")
    assert rs.load_routes(spark, path) is None
    refs = spark.createDataFrame([("a", 1, "x y")], "route string, ref_id bigint, ref_text string")
    routes = build_routes(refs, 0.5, dims=16)
    rs.save_routes(routes, path)
    loaded = rs.load_routes(spark, path)
    assert loaded.collect() == routes.collect()
    with pytest.raises(Exception, match="already exists"):
        rs.save_routes(routes, path, overwrite=False)
    rs.save_routes(routes, path, overwrite=True)
    rs.save_routes(routes.limit(0), path)
    assert rs.load_routes(spark, path) is None


def test_article_files_and_split(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    rows = [(i, f' text {i % 30} "quoted", and\nnew line ', "sport" if i % 3 else "tech")
            for i in range(40)]
    with open(path, "w", newline="") as f:
        import csv

        w = csv.writer(f)
        w.writerow(["ArticleId", "Text", "Category"])
        w.writerows(rows)
    read = sa.read_articles(spark, path)
    got = {r["article_id"]: (r["text"], r["label"]) for r in read.collect()}
    assert got == {i: (t.strip(), c) for i, t, c in rows}
    raw = sa.read_articles(spark, path, strip=False)
    assert {r["text"] for r in raw.collect()} == {t for _, t, _ in rows}
    out = str(tmp_path / "split")
    split = sa.ensure_split(raw, out)
    assert split.count() == 30
    again = sa.ensure_split(raw.limit(1), out)
    assert again.count() == 30
    train, validation = (sa.read_split(spark, out, s) for s in ("train", "validation"))
    assert train.count() + validation.count() == 30
    assert validation.count() == 8  # a quarter of 20 and of 10, rounded up
    assert all(r["text"] == r["text"].strip() for r in train.collect())


def test_metrics_of_a_router_run(spark):
    articles = spark.createDataFrame(
        [(i, "w%d x" % (i % 2), "ab"[i % 2]) for i in range(10)],
        "doc_id bigint, text string, lang string",
    )
    refs = spark.createDataFrame([("a", 1, "w0"), ("b", 2, "w1")],
                                 "route string, ref_id bigint, ref_text string")
    routed = classify(articles, build_routes(refs, 0.6), ["a", "b"])
    usage = routed.select(F.lit(3).cast("bigint").alias("tokens"), F.lit(0.5).alias("cost"))
    metrics = run_metrics(router_batch(routed, 2.0, usage), routed, "lang")
    got = {r["metric"]: (r["category"], r["value"]) for r in metrics.collect()}
    assert got["accuracy"] == ("performance_metrics", 1.0)
    assert got["f1_macro"] == ("classification_metrics", 1.0)
    assert got["avg_latency_per_article"] == ("latency_metrics", 0.2)
    assert got["total_cost"] == ("cost_metrics", 5.0)
    assert got["total_tokens"][1] == 30.0
    free = {r["metric"]: r["value"] for r in
            run_metrics(router_batch(routed, 2.0), routed, "lang").collect()}
    assert free["total_cost"] == 0.0 and free["success_rate"] == 1.0
    assert embed_hashed(articles).count() == 10


def test_the_comparison_of_routers_has_latency(spark, sf):
    rows = {r["metric"]: r for r in queries.run_comparison(spark, sf).collect()}
    assert len(rows) == 10
    references = spark.read.parquet(f"{sf}/documents.parquet").groupBy(F.lower("lang").alias("l")).count()
    n = {r["l"]: min(queries.SAMPLES, r["count"]) for r in references.collect()}
    per_article = rows["avg_latency_per_article"]
    assert (per_article["baseline"], per_article["semantic"]) == (sum(n.values()) / 1e6, len(n) / 1e6)
    assert rows["total_latency"]["speedup"] == pytest.approx(sum(n.values()) / len(n))
    assert rows["accuracy"]["speedup"] is None
