import random
from collections import Counter

import pytest

from signpost.operators import quality as qu

BATCH = (
    "batch_id string, status string, batch_size bigint, total_latency double, total_cost double, "
    "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"
)
CLASSIFIED = "true_label string, prediction string, confidence double"


def test_batch_metrics_count_successes_only(spark):
    df = spark.createDataFrame(
        [
            ("1", "success", 10, 2.0, 0.5, 100, 10, 110),
            ("2", "failed", 5, 9.0, 9.0, 900, 90, 990),
            ("3", "success", 6, 4.0, 0.3, 60, 6, 66),
        ],
        BATCH,
    )
    m = qu.batch_metrics(df).first().asDict()
    assert (m["total_articles"], m["successful_articles"], m["failed_articles"]) == (21, 16, 5)
    assert (m["total_batches"], m["successful_batches"], m["failed_batches"]) == (3, 2, 1)
    assert m["success_rate"] == pytest.approx(2 / 3)
    assert (m["total_latency"], m["avg_batch_latency"]) == (6.0, 3.0)
    assert m["avg_latency_per_article"] == pytest.approx(6 / 16)
    assert m["cost_per_article"] == pytest.approx(0.05)
    assert (m["total_prompt_tokens"], m["total_completion_tokens"], m["total_tokens"]) == (
        160, 16, 176,
    )
    assert m["avg_tokens_per_article"] == 11.0


def test_no_batches_and_only_failed_ones(spark):
    assert qu.batch_metrics(spark.createDataFrame([], BATCH)).count() == 0
    failed = spark.createDataFrame([("1", "failed", 5, None, None, None, None, None)], BATCH)
    m = qu.batch_metrics(failed).first().asDict()
    assert m["success_rate"] == 0.0 and m["avg_batch_latency"] == 0.0
    assert m["total_cost"] == 0.0 and m["failed_articles"] == 5


def test_all_batches_fills_what_a_side_lacks(spark):
    ok = spark.createDataFrame([("1", 10, 0.5)], "batch_id string, batch_size bigint, total_cost double")
    bad = spark.createDataFrame([("2", 4, "boom")], "batch_id string, batch_size bigint, error string")
    got = {r["batch_id"]: r for r in qu.all_batches(ok, bad).collect()}
    assert (got["1"]["status"], got["1"]["error"]) == ("success", None)
    assert (got["2"]["status"], got["2"]["total_cost"]) == ("failed", None)


def test_accuracy_ignores_case_and_unlabelled_rows(spark):
    df = spark.createDataFrame(
        [("A", "a", 0.9), ("b", "a", 0.1), (None, "a", 0.5), ("b", "B", 0.3)], CLASSIFIED
    )
    got = qu.accuracy(df).first()
    assert (got["total_predictions"], got["correct_predictions"]) == (3, 2)
    assert got["accuracy"] == pytest.approx(2 / 3)
    assert got["avg_confidence"] == pytest.approx(0.45)


@pytest.mark.parametrize("rows", [[], [(None, "a", 0.5)]])
def test_accuracy_is_null_without_labels(spark, rows):
    got = qu.accuracy(spark.createDataFrame(rows, CLASSIFIED)).first()
    assert (got["total_predictions"], got["correct_predictions"], got["accuracy"]) == (
        None, None, None,
    )
    assert qu.confusion_matrix(spark.createDataFrame(rows, CLASSIFIED)).count() == 0
    report = qu.class_report(qu.confusion_matrix(spark.createDataFrame(rows, CLASSIFIED)))
    assert report.count() == 0 and qu.averaged_metrics(report).count() == 0


def test_report_matches_brute_force(spark):
    draw = random.Random(4)
    # "only" is predicted but never true, "never" is true but never predicted
    rows = [(draw.choice(["a", "B", "never"]), draw.choice(["A", "b", "only"]), 1.0)
            for _ in range(400)]
    df = spark.createDataFrame(rows, CLASSIFIED)
    pairs = [(t.lower(), p.lower()) for t, p, _ in rows]
    confusion = qu.confusion_matrix(df)
    assert {(r["y_true"], r["y_pred"]): r["n"] for r in confusion.collect()} == Counter(pairs)
    report = qu.class_report(confusion)
    got = {r["class"]: r for r in report.collect()}
    assert [r["class"] for r in report.collect()] == ["a", "b", "never", "only"]
    want = {}
    for c in got:
        tp = sum(t == p == c for t, p in pairs)
        predicted, support = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        p = tp / predicted if predicted else 0.0
        r = tp / support if support else 0.0
        want[c] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, support)
        assert (got[c]["precision"], got[c]["recall"], got[c]["f1"], got[c]["support"]) == (
            pytest.approx(want[c])
        )
    means = qu.averaged_metrics(report).first()
    total = len(pairs)
    for k, name in enumerate(("precision", "recall", "f1")):
        assert means[f"{name}_macro"] == pytest.approx(sum(w[k] for w in want.values()) / 4)
        assert means[f"{name}_weighted"] == pytest.approx(
            sum(w[k] * w[3] for w in want.values()) / total
        )
    # recall weighted by support is the accuracy
    assert means["recall_weighted"] == pytest.approx(qu.accuracy(df).first()["accuracy"])
    assert sum(r["n"] for r in confusion.collect()) == total


def test_per_batch_rates(spark):
    batches = spark.createDataFrame(
        [("1", "success", 4, 2.0, 0.8, 0, 0, 0), ("2", "success", 0, 2.0, 0.8, 0, 0, 0)], BATCH
    )
    classified = spark.createDataFrame(
        [("1", "a", "A"), ("1", "b", "a"), ("2", None, "a")],
        "batch_id string, true_label string, prediction string",
    )
    got = {r["batch_id"]: r for r in qu.per_batch_rates(batches, classified).collect()}
    assert (got["1"]["avg_latency_per_article"], got["1"]["cost_per_article"]) == (0.5, 0.2)
    assert (got["2"]["avg_latency_per_article"], got["2"]["cost_per_article"]) == (0.0, 0.0)
    assert (got["1"]["accuracy"], got["2"]["accuracy"]) == (0.5, None)
    assert qu.per_batch_rates(batches).first()["accuracy"] is None
