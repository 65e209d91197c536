"""Runs as one call: saved, committed, resumed, listed, compared."""

import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signpost.plans import batch_inference as bi
from signpost.plans import saved_runs as sr
from signpost.plans.comparison import compare_stored_runs
from signpost.plans.router import train_router
from signpost.session import shared_folder
from signpost.sources import files
from signpost.sources import route_store as rs
from signpost.sources import run_store as st
from signpost.sources.run_catalogue import read_catalogue
from signpost.streaming.routing import route_stream

CLASSES = ["a", "b"]


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(i, f'w{i % 2} w{i % 2} "x", {"y" * 120}' if i % 5 else None, "ab"[i % 2]) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.fixture
def stored_routes(spark, articles, tmp_path):
    path = str(tmp_path / "routes")
    rs.save_routes(train_router(articles.filter("text IS NOT NULL"), 5, 0.9, dims=32), path)
    return path


def model(folder):
    def factory():
        import os
        import re
        import uuid

        def complete(prompt):
            ids = [int(i) for i in re.findall(r"\n\[text (\d+)\]", prompt)]
            open(os.path.join(folder, f"{ids[0]}-{uuid.uuid4().hex}"), "w").close()
            if ids[0] == 10:
                raise RuntimeError("401 unauthorized")
            if ids[0] == 30 and os.path.exists(os.path.join(folder, "broken")):
                import time

                time.sleep(4)
                os.remove(os.path.join(folder, [f for f in os.listdir(folder) if f.startswith("30-")][0]))
                raise SystemExit("lost")
            return "".join(f'{{"article_id": {i}, "category": "{"ab"[i % 2]}"}}' for i in ids), 10, 4

        return complete

    return factory


def metrics_of(spark, base, run):
    return {r["metric"]: r["value"] for r in st.read_metrics(spark, base, run).collect()}


def test_router_run_is_saved_and_read_back(spark, articles, stored_routes, tmp_path):
    base = str(tmp_path / "runs")
    run = sr.run_router(
        articles, stored_routes, CLASSES, base, overrides={"a": 0.8}, dims=32,
        model="text-embedding-3-small", pipeline_config={"data": "test"},
    )
    assert re.match(r"\d{4}-\d\d-\d\d_", run)
    summary = st.run_summary(spark, base, run)
    assert summary["has_classifications"]
    rows = st.read_classifications(spark, base, run).collect()
    assert len(rows) == 40 and all(r["correct"] for r in rows if r["article_id"] % 5)
    got = metrics_of(spark, base, run)
    info = summary["run_info"].first()
    facts, said = info["facts"], json.loads(info["classifier_config"])
    assert facts["rows"] == 40 and facts["fallbacks"] == 8 and facts["seconds"] > 0
    assert got["total_latency"] == facts["seconds"] and got["total_articles"] == 40
    assert got["total_tokens"] == facts["tokens"] > 0
    right = sum(r["correct"] for r in rows)
    assert got["accuracy"] == right / 40
    assert got["classification_report.a.support"] == 20
    assert got["classification_report.macro avg.f1-score"] == pytest.approx(got["f1_macro"])
    assert {r["category"] for r in summary["metrics"].collect() if r["metric"].startswith("classification_report")} == {
        "classification_metrics"
    }
    assert said["routes"]["a"]["distance_threshold"] == 0.8 and said["routes"]["b"]["distance_threshold"] == 0.9
    assert said["routes"]["a"]["references_count"] == 5
    assert said["routes_version"] == rs.current_version(spark, stored_routes)
    assert json.loads(info["pipeline_config"]) == {"data": "test"}


def test_articles_are_embedded_once_in_a_run(spark, articles, tmp_path):
    """Writing, observing and measuring together read every article once."""
    folder, routes = str(tmp_path / "calls"), str(tmp_path / "dense")
    os.mkdir(folder)

    def factory():
        import os
        import uuid

        def embed(texts):
            for _ in texts:
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return np.array([[1.0, t.count("w0")] for t in texts])

        return embed

    rs.save_routes(train_router(articles.filter("text IS NOT NULL"), 5, 0.9, embedder=factory), routes)
    trained = len(os.listdir(folder))
    sr.run_router(articles, routes, CLASSES, str(tmp_path / "runs"), embedder=factory)
    assert len(os.listdir(folder)) == trained + 40


def test_a_run_leaves_no_scratch_tables(spark, articles, stored_routes, tmp_path):
    folder = f"{shared_folder(spark)}/signpost"
    before = files.names(spark, folder)
    calls = str(tmp_path / "calls")
    os.mkdir(calls)
    sr.run_router(articles, stored_routes, CLASSES, str(tmp_path / "r"), overrides={"a": 0.5}, dims=32)
    sr.run_model(articles, CLASSES, model(calls), str(tmp_path / "m"), max_retries=0)
    assert files.names(spark, folder) == before


def test_without_routes_there_is_no_run(spark, articles, tmp_path):
    with pytest.raises(ValueError, match="no trained routes"):
        sr.run_router(articles, str(tmp_path / "none"), CLASSES, str(tmp_path / "runs"))


@pytest.mark.parametrize("broken", ["save_metrics", "save_run_info", "commit"])
def test_a_run_broken_before_its_manifest_is_not_seen(spark, articles, stored_routes, tmp_path, monkeypatch, broken):
    base = str(tmp_path / "runs")
    first = sr.run_router(articles, stored_routes, CLASSES, base, dims=32)
    before = metrics_of(spark, base, first)

    def stop(*args, **how):
        raise RuntimeError("killed")

    monkeypatch.setattr(st, broken, stop)
    for run in (first, "other"):  # a new write of a run, and a new run
        with pytest.raises(RuntimeError, match="killed"):
            sr.run_router(articles.limit(3), stored_routes, CLASSES, base, run=run, dims=32)
    monkeypatch.undo()
    listed = st.stored_runs(spark, {"r": base, "gone": str(tmp_path / "no")}).collect()
    assert [r["run_id"] for r in listed] == [first]
    assert metrics_of(spark, base, first) == before
    assert st.run_summary(spark, base, "other") is None and st.read_metrics(spark, base, "other") is None
    gone = st.remove_leftovers(spark, base)
    assert gone and metrics_of(spark, base, first) == before
    assert st.read_classifications(spark, base, first).count() == 40
    assert st.remove_leftovers(spark, base) == []


def test_readers_keep_what_they_opened(spark, articles, stored_routes, tmp_path):
    base = str(tmp_path / "runs")
    run = sr.run_router(articles, stored_routes, CLASSES, base, dims=32)
    opened = st.read_classifications(spark, base, run)
    sr.run_router(articles.limit(7), stored_routes, CLASSES, base, run=run, dims=32)
    assert opened.count() == 40
    assert st.read_classifications(spark, base, run).count() == 7


def test_model_run_goes_on_after_a_break(spark, articles, tmp_path):
    folder, base = str(tmp_path / "calls"), str(tmp_path / "runs")
    os.mkdir(folder)
    marker = os.path.join(folder, "broken")
    open(marker, "w").close()

    def go():
        return sr.run_model(articles, CLASSES, model(folder), base, "one", prompt_price=1.0,
                            completion_price=2.0, max_retries=0, calls_per_task=1)

    with pytest.raises(Exception):
        go()
    assert st.stored_runs(spark, {"m": base}).count() == 0
    os.remove(marker)
    assert go() == "one"
    assert sorted(int(f.split("-")[0]) for f in os.listdir(folder)) == [0, 10, 20, 30]
    got = metrics_of(spark, base, "one")
    assert (got["successful_articles"], got["failed_articles"], got["successful_batches"]) == (30, 10, 3)
    assert got["accuracy"] == 1.0 and got["total_cost"] == pytest.approx(3 * (10 + 8) / 1000)
    assert got["total_latency"] > 0 and got["classification_report.b.support"] == 15
    rows = {r["article_id"]: r for r in st.read_classifications(spark, base, "one").collect()}
    assert len(rows) == 40 and rows[10]["batch_status"] == "failed: 401 unauthorized"
    assert rows[10]["prediction"] is None and rows[1]["correct"]
    facts = st.read_run_info(spark, base, "one").first()["facts"]
    assert (facts["rows"], facts["fallbacks"]) == (40, 10)


def test_two_saved_runs_are_compared(spark, articles, stored_routes, tmp_path):
    bases = {"baseline": str(tmp_path / "m"), "semantic": str(tmp_path / "r")}
    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    sr.run_model(articles, CLASSES, model(folder), bases["baseline"], prompt_price=1.0, max_retries=0)
    sr.run_router(articles, stored_routes, CLASSES, bases["semantic"], dims=32)
    got = {r["metric"]: r for r in compare_stored_runs(spark, bases["baseline"], bases["semantic"]).collect()}
    assert set(got) == {"accuracy", "f1_macro", "total_latency", "total_cost"}
    assert got["total_latency"]["speedup"] > 0 and got["total_cost"]["baseline"] > 0


def test_catalogue_opens_only_what_is_asked_for(spark, articles, stored_routes, tmp_path):
    bases = {"x": str(tmp_path / "x"), "y": "file:" + str(tmp_path / "y"), "z": str(tmp_path / "none")}
    runs = [sr.run_router(articles.limit(5 * k), stored_routes, CLASSES, bases["x"], f"r{k}", dims=32) for k in (1, 2, 3)]
    sr.run_router(articles, stored_routes, CLASSES, bases["y"], "r1", dims=32)
    st.commit(spark, bases["y"], "empty", {})
    whole = read_catalogue(spark, bases)
    seen = {(r["result_type"], r["run_id"]) for r in whole.select("result_type", "run_id").collect()}
    assert seen == {("x", r) for r in runs} | {("y", "r1"), ("y", "empty")}
    assert whole.rdd.getNumPartitions() == 5
    one = whole.filter("result_type = 'x' AND run_id = 'r2' AND metric = 'total_articles'")
    assert one.rdd.getNumPartitions() == 1
    row = one.first()
    assert (row["value"], row["category"], row["has_classifications"]) == (10.0, "performance_metrics", True)
    assert row["committed_at"] == st.committed(spark, bases["x"]).filter("run_id = 'r2'").first()["committed_at"]
    assert whole.filter(F.col("run_id").isin("r1", "r3") & (F.col("result_type") == "x")).rdd.getNumPartitions() == 2
    assert whole.filter("run_id = 'r1' AND run_id = 'r2'").count() == 0
    empty = whole.filter("run_id = 'empty'").first()
    assert (empty["metric"], empty["has_classifications"]) == (None, False)
    # a folder that is gone fails if it is opened, and is not opened if another run is asked for
    st.files.remove(spark, st.manifest(spark, bases["x"], "r3")["parts"]["metrics"])
    assert whole.filter("result_type = 'x' AND run_id = 'r1'").count() > 10


def test_a_stream_keeps_the_routes_it_began_with(spark, articles, stored_routes, tmp_path):
    """Routes are replaced while a stream runs, between its batches and between its starts."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = articles.filter("text IS NOT NULL").withColumnRenamed("doc_id", "article_id")
    rows.filter("article_id < 20").repartition(5).write.parquet(source)
    old = rs.load_routes(spark, stored_routes)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = route_stream(stream, old, CLASSES, sink, str(tmp_path / "state"), dims=32)
    # the names of the two routes change places
    swapped = old.withColumn("route", F.when(F.col("route") == "a", "b").otherwise("a"))
    first = rs.current_version(spark, stored_routes)
    rs.save_routes(swapped, stored_routes)
    during = query.isActive
    query.awaitTermination()
    rows.filter("article_id >= 20").repartition(1).write.mode("append").parquet(source)
    route_stream(stream, old, CLASSES, sink, str(tmp_path / "state"), dims=32).awaitTermination()
    assert during and len(os.listdir(sink)) == 6
    got = spark.read.parquet(sink)
    assert got.count() == 32 and got.filter("prediction <> lang").count() == 0
    new = rs.load_routes(spark, stored_routes)
    assert sorted(r["route"] for r in new.collect()) == ["a", "b"] and new.collect() != old.collect()
    assert rs.load_routes(spark, stored_routes, first).collect() == old.collect()
    assert rs.remove_old_versions(spark, stored_routes, keep=1) == [first]
    assert rs.load_routes(spark, stored_routes, first) is None and rs.load_routes(spark, stored_routes).count() == 2


def test_a_broken_write_leaves_the_routes(spark, stored_routes, monkeypatch):
    before = rs.load_routes(spark, stored_routes).collect()

    def stop(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(rs.files, "write_text", stop)
    with pytest.raises(RuntimeError):
        rs.save_routes(rs.load_routes(spark, stored_routes).limit(1), stored_routes)
    monkeypatch.undo()
    assert rs.load_routes(spark, stored_routes).collect() == before
    assert len(rs.versions(spark, stored_routes)) == 2


def test_a_task_holds_about_calls_per_task_prompts(spark, tmp_path):
    articles = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    prompts = bi.planned_prompts(articles, ["a", "b"], 1, calls_per_task=10)

    def factory():
        made = []

        def complete(prompt):
            made.append(prompt)
            return "", len(made), 0

        return complete

    replies = bi.resumed_replies(prompts, factory, f"{tmp_path}/ledger", calls_per_task=10)
    assert replies.count() == 1500
    assert replies.agg(F.max("prompt_tokens")).first()[0] <= 30
