import random

import pytest

from signpost.operators.thresholds import best_thresholds, exact_counts, threshold_sweep
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    edges = [0.0, 0.07, 0.29, 0.57, 0.58, 1.0, 1.2, -1e-9, 0.5799999999, 0.5800000001]
    return [
        (draw.choice("abcN"), draw.choice("abc"), draw.choice([draw.random(), draw.choice(edges)]))
        for _ in range(500)
    ] + [("A", "a", 0.3)]


def brute(rows, steps):
    out = {}
    for route in "abc":
        mine = [(label.lower() == route, d) for label, r, d in rows if r == route]
        for i in range(steps + 1):
            t = i / steps
            tp = sum(own and d <= t for own, d in mine)
            fp = sum(not own and d <= t for own, d in mine)
            fn = sum(own and d > t for own, d in mine)
            out[route, t] = (tp, fp, fn)
    return out


@pytest.mark.parametrize("steps", [100, 7])
def test_sweep_matches_brute_force(spark, rows, steps):
    df = spark.createDataFrame(rows, "label string, route string, distance double")
    got = threshold_sweep(df, steps=steps).collect()
    want = brute(rows, steps)
    assert {(r["route"], r["threshold"]): (r["tp"], r["fp"], r["fn"]) for r in got} == want
    for r in got:
        tp, fp, fn = want[r["route"], r["threshold"]]
        p = tp / (tp + fp) if tp + fp else 0
        c = tp / (tp + fn) if tp + fn else 0
        assert r["precision"] == pytest.approx(p)
        assert r["recall"] == pytest.approx(c)
        assert r["f1"] == pytest.approx(2 * p * c / (p + c) if p + c else 0)


def test_recall_grows_with_the_threshold(spark, rows):
    df = spark.createDataFrame(rows, "label string, route string, distance double")
    by_route = {}
    for r in threshold_sweep(df).orderBy("route", "threshold").collect():
        by_route.setdefault(r["route"], []).append(r["recall"])
    assert all(v == sorted(v) for v in by_route.values())


def test_best_is_the_smallest_threshold_of_the_best_f1(spark):
    df = spark.createDataFrame(
        [("a", "a", 0.31), ("b", "a", 0.5), ("b", "b", 0.9)],
        "label string, route string, distance double",
    )
    got = {r["route"]: (r["threshold"], r["f1"]) for r in
           best_thresholds(threshold_sweep(df)).collect()}
    assert got == {"a": (0.31, 1.0), "b": (0.9, 1.0)}


@pytest.mark.parametrize("partitions", [1, 2, 7, 50])
def test_exact_counts_match_brute_force(spark, rows, partitions):
    """At every distinct distance, wherever the partitions cut the routes."""
    odd = [*rows, ("a", "a", float("nan")), ("b", "a", None), ("a", "a", float("inf")), (None, "a", 0.2)]
    df = spark.createDataFrame(odd, "label string, route string, distance double")
    got = {(r["route"], r["threshold"]): (r["tp"], r["fp"], r["fn"], r["f1"]) for r in exact_counts(df, partitions=partitions).collect()}
    want = {}
    for route in "abc":
        mine = [((label or "").lower() == route, d) for label, r, d in odd if r == route]
        for t in {d for _, d in mine if d is not None and d < float("inf")}:
            tp = sum(own and d is not None and d <= t for own, d in mine)
            fp = sum(not own and d is not None and d <= t for own, d in mine)
            fn = sum(own for own, _ in mine) - tp
            want[route, t] = (tp, fp, fn, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0)
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(got[k][3] == pytest.approx(want[k][3]) for k in want)


def test_the_exact_best_is_no_worse_than_a_step(spark, rows):
    df = spark.createDataFrame([r for r in rows if 0 <= r[2] <= 1], "label string, route string, distance double")
    steps = {r["route"]: r["f1"] for r in best_thresholds(threshold_sweep(df)).collect()}
    exact = {r["route"]: r["f1"] for r in best_thresholds(exact_counts(df)).collect()}
    assert all(exact[r] >= steps[r] - 1e-12 for r in steps)


def test_no_window_holds_a_whole_route(spark, rows):
    df = spark.createDataFrame(rows, "label string, route string, distance double")
    plan = plan_of(exact_counts(df, partitions=4))
    assert "[_part#" in plan.split("Window")[1].split("\n")[0]
    assert exact_counts(df.limit(0)).count() == 0
