import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from signpost.functions.scoring import NO_CLASS
from signpost.operators import distances as di
from signpost.operators import routes as ro
from signpost.operators import routing as rt
from signpost.operators.embed import embed_hashed
from signpost.plans import router as pr
from tests.conftest import plan_of

DIMS = 32
CLASSES = ["a", "b", "c"]


def vector(text):
    n = Counter(
        int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % DIMS for w in text.lower().split()
    )
    out = np.zeros(DIMS)
    for d, c in n.items():
        out[d] = c
    norm = np.linalg.norm(out)
    return out / norm if norm else out


@pytest.fixture(scope="module")
def data():
    draw = random.Random(5)
    vocabulary = {r: [f"{r}{i}" for i in range(12)] + ["x", "y"] for r in CLASSES}
    refs = [
        (r, 10 * k + i, " ".join(draw.choices(vocabulary[r], k=15)))
        for k, r in enumerate(CLASSES)
        for i in range(6)
    ]
    docs = [
        (i, " ".join(draw.choices(vocabulary[draw.choice(CLASSES)], k=draw.randint(1, 25))))
        for i in range(150)
    ]
    docs += [(900, ""), (901, None), (902, refs[0][2]), (903, "nothing shared zzz qqq")]
    return refs, docs


def distances(refs, docs, agg):
    by_route = defaultdict(list)
    for route, _, text in refs:
        by_route[route].append(vector(text))
    out = {}
    for i, text in docs:
        if text is None:
            out[i] = {}
            continue
        q = vector(text)
        per = {r: [1 - float(q @ v) for v in vs] for r, vs in by_route.items()}
        pick = (lambda d: sum(d) / len(d)) if agg == "avg" else min
        out[i] = {r: round(pick(d), 9) for r, d in per.items()}
    return out


def frames(spark, data, agg, threshold=0.6):
    refs, docs = data
    references = spark.createDataFrame(refs, "route string, ref_id bigint, ref_text string")
    routes = ro.build_routes(references, threshold, agg, DIMS)
    articles = spark.createDataFrame(docs, "doc_id bigint, text string")
    return routes, embed_hashed(articles, "text", DIMS)


@pytest.mark.parametrize("agg", ["avg", "min"])
@pytest.mark.parametrize("max_cells", [di.MAX_CELLS, 40])
@pytest.mark.parametrize("threshold", [0.6, 1.0])
def test_routing_matches_brute_force(spark, data, agg, max_cells, threshold):
    routes, articles = frames(spark, data, agg, threshold)
    got = {
        r["doc_id"]: r
        for r in rt.route_articles(articles, routes, CLASSES, max_cells=max_cells).collect()
    }
    want = distances(*data, agg)
    assert len(got) == len(data[1])
    for i, per in want.items():
        near = sorted((d, r) for r, d in per.items() if d <= threshold)
        row = got[i]
        if near:
            assert not row["is_fallback"]
            assert row["prediction"] == near[0][1]
            assert row["distance"] == pytest.approx(near[0][0], abs=2e-9)
            assert row["confidence"] == pytest.approx(max(0, 1 - near[0][0]), abs=2e-9)
        else:
            assert row["is_fallback"] and row["distance"] is None
            assert (row["prediction"], row["confidence"]) == ("a", 0.1)


@pytest.mark.parametrize("way", ["matrix", "blocks", "row"])
def test_every_way_gives_the_same_distances(spark, data, monkeypatch, way):
    routes, articles = frames(spark, data, "avg")
    want = sorted(map(tuple, di.distance_rows(articles, routes).collect()))
    monkeypatch.setattr(di, "PRODUCT_CELLS", 70)  # two articles per slice
    monkeypatch.setattr(di, "GROUP_ROWS", 30)
    monkeypatch.setattr(di, "ROW_CELLS", 0 if way == "matrix" else di.ROW_CELLS)
    cells = 40 if way == "blocks" else di.MAX_CELLS
    got = sorted(map(tuple, di.distance_rows(articles, routes, max_cells=cells).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) <= 1.1e-9 for g, w in zip(got, want))
    kept = di.distance_rows(
        articles.withColumn("more", F.lit(1)), routes, keep=["more"], max_cells=cells
    )
    assert kept.filter("more = 1").count() == len(want)


@pytest.mark.parametrize("max_cells", [di.MAX_CELLS, 40])
def test_top_routes_and_distance_rows(spark, data, max_cells):
    routes, articles = frames(spark, data, "min")
    want = distances(*data, "min")
    ranked = rt.top_routes(
        di.candidate_routes(
            articles, routes, k=2, within_threshold=False, max_cells=max_cells
        ),
        "doc_id",
    ).collect()
    got = defaultdict(dict)
    for r in ranked:
        got[r["doc_id"]][r["rank"]] = (r["distance"], r["route"])
    for i, per in want.items():
        near = sorted((d, r) for r, d in per.items())[:2]
        assert [got[i][k][1] for k in sorted(got[i])] == [r for _, r in near]
    rows = di.distance_rows(articles, routes, max_cells=max_cells).collect()
    assert len(rows) == sum(len(p) for p in want.values())
    for r in rows:
        assert r["distance"] == pytest.approx(want[r["doc_id"]][r["route"]], abs=2e-9)


def test_ties_go_to_the_smaller_name_and_edges_count(spark):
    refs = spark.createDataFrame(
        [("b", 1, "w"), ("a", 2, "w"), ("z", 3, "w v")],
        "route string, ref_id bigint, ref_text string",
    )
    routes = ro.build_routes(refs, 0.0, "avg", DIMS)
    docs = embed_hashed(
        spark.createDataFrame([(1, "w"), (2, "v")], "doc_id bigint, text string"), "text", DIMS
    )
    got = {r["doc_id"]: r for r in rt.route_articles(docs, routes, ["a", "b", "z"]).collect()}
    assert got[1]["prediction"] == "a" and got[1]["distance"] == 0.0
    assert got[2]["is_fallback"]


def test_route_without_words_keeps_distance_one(spark):
    refs = spark.createDataFrame(
        [("blank", 1, ""), ("full", 2, "w")], "route string, ref_id bigint, ref_text string"
    )
    docs = embed_hashed(
        spark.createDataFrame([(1, "w"), (2, "")], "doc_id bigint, text string"), "text", DIMS
    )
    for agg in ("avg", "min"):
        routes = ro.build_routes(refs, 1.0, agg, DIMS)
        rows = {(r["doc_id"], r["route"]): r["distance"] for r in
                di.distance_rows(docs, routes).collect()}
        assert rows == {(1, "blank"): 1.0, (1, "full"): 0.0, (2, "blank"): 1.0, (2, "full"): 1.0}


def test_no_routes_at_all(spark):
    refs = spark.createDataFrame([], "route string, ref_id bigint, ref_text string")
    docs = embed_hashed(
        spark.createDataFrame([(1, "w")], "doc_id bigint, text string"), "text", DIMS
    )
    for agg in ("avg", "min"):
        routes = ro.build_routes(refs, 0.5, agg, DIMS)
        assert rt.route_articles(docs, routes, CLASSES).first()["is_fallback"]


@pytest.mark.parametrize("agg", ["avg", "min"])
def test_dense_routing(spark, agg):
    rng = np.random.default_rng(3)
    refs = [(f"r{i % 4}", i, rng.normal(size=8)) for i in range(24)]
    queries = [(i, rng.normal(size=8)) for i in range(60)] + [(99, np.zeros(8))]

    def unit(v):
        return v / np.linalg.norm(v) if np.linalg.norm(v) else v

    table = spark.createDataFrame(
        [(r, i, unit(v).tolist()) for r, i, v in refs],
        "route string, ref_id bigint, vec array<double>",
    )
    routes = ro.build_dense_routes(table, 0.8, agg)
    docs = spark.createDataFrame(
        [(i, unit(v).tolist()) for i, v in queries], "doc_id bigint, vec array<double>"
    )
    for cells in (di.MAX_CELLS, 30):
        got = {
            r["doc_id"]: (r["route"], r["distance"])
            for r in rt.with_best_route(
                di.candidate_routes(docs, routes, sparse=False, max_cells=cells)
            ).collect()
        }
        for i, v in queries:
            per = defaultdict(list)
            for r, _, w in refs:
                per[r].append(1 - float(unit(v) @ unit(w)))
            score = {r: (np.mean(d) if agg == "avg" else min(d)) for r, d in per.items()}
            near = sorted((round(d, 9), r) for r, d in score.items() if round(d, 9) <= 0.8)
            if near:
                assert got[i][0] == near[0][1]
                assert got[i][1] == pytest.approx(near[0][0], abs=2e-9)
            else:
                assert got[i] == (None, None)


def test_unrouted_and_matched(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, ""), (3, None)], "doc_id bigint, route string"
    )
    assert sorted(r[0] for r in rt.unrouted(df).collect()) == [2, 3]


def test_fallback_rules(spark):
    df = spark.createDataFrame(
        [(1, "B"), (2, None), (3, NO_CLASS), (4, "zzz"), (5, "a")], "id int, route string"
    )
    got = {
        r["id"]: (r["prediction"], r["confidence"], r["is_fallback"])
        for r in rt.apply_fallback(df, ["A", "b", NO_CLASS], "route", F.lit(0.7)).collect()
    }
    assert got == {
        1: ("b", 0.7, False),
        2: ("a", 0.1, True),
        3: ("a", 0.1, True),
        4: ("a", 0.1, True),
        5: ("a", 0.7, False),
    }
    without = rt.apply_fallback(df, ["a", "b"], "route", None, None).collect()
    assert all(r["confidence"] is None for r in without)
    with pytest.raises(ValueError):
        rt.apply_fallback(df, [NO_CLASS])


def test_overrides(spark):
    routes = spark.createDataFrame(
        [("a", 0.6), ("b", 0.6), ("c", 0.7)], "route string, threshold double"
    )
    changed = ro.override_thresholds(
        routes, ro.overrides_frame(spark, {"a": 0.1, "B": 0.2, "nope": 0.3})
    )
    assert {r["route"]: r["threshold"] for r in changed.collect()} == {
        "a": 0.1, "b": 0.6, "c": 0.7
    }
    with pytest.raises(ValueError):
        ro.overrides_frame(spark, {"a": 1.2})
    empty = ro.override_thresholds(routes, ro.overrides_frame(spark, {}))
    assert {r["threshold"] for r in empty.collect()} == {0.6, 0.7}


def test_training_with_calibration_overrides_and_summary(spark, data):
    refs, docs = data
    articles = spark.createDataFrame(
        [(i, t, r.upper() if i % 2 else r) for r, i, t in refs],
        "doc_id bigint, text string, lang string",
    )
    references = ro.route_references(articles, 4)
    summary = {r["route"]: r for r in ro.route_summary(articles, references, 0.6).collect()}
    assert {k: (v["total"], v["references_count"]) for k, v in summary.items()} == {
        r: (6, 4) for r in CLASSES
    }
    assert summary["a"]["metadata"] == {"category": "a", "samples_count": "4"}
    routes = pr.train_router(
        articles, 4, 0.6, calibration=articles, overrides={"c": 0.33}, dims=DIMS
    )
    info = {r["route"]: r for r in ro.router_info(routes).collect()}
    thresholds = {k: r["threshold"] for k, r in info.items()}
    assert {r["references_count"] for r in info.values()} == {4}
    assert info["b"]["metadata"] == {"category": "b", "samples_count": "4"}
    nearest = pr.train_router(articles, 5, 0.6, "min", dims=DIMS)
    assert [r["references_count"] for r in ro.router_info(nearest).collect()] == [5, 5, 5]
    assert thresholds["c"] == 0.33
    assert set(thresholds) == set(CLASSES)
    classified = pr.classify(articles, routes, CLASSES, dims=DIMS, overrides={"b": 0.0})
    assert classified.count() == len(refs)
    with pytest.raises(ValueError):
        pr.train_router(articles, 4, 1.5)


def test_router_with_a_plugged_in_embedder(spark, data):
    refs, _ = data
    articles = spark.createDataFrame(
        [(i, t, r) for r, i, t in refs], "doc_id bigint, text string, lang string"
    )

    def factory():
        import numpy

        def model(texts):
            return numpy.array([[t.count(c) + 0.001 for c in "abc"] for t in texts])

        return model

    routes = pr.train_router(articles, 4, 0.9, "min", embedder=factory)
    got = pr.classify(articles, routes, CLASSES, embedder=factory).collect()
    assert all(r["prediction"] == r["lang"] for r in got)


def test_plan_is_one_scan_without_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    routes = pr.train_router(docs, 10, 0.6)
    routed = pr.classify(docs, routes, ["en", "de"]).select("doc_id", "prediction")
    plan = plan_of(routed).split("Subquery")[0]
    assert "Exchange" not in plan
    full = plan_of(routed)
    assert "CartesianProduct" not in full and "NestedLoop" not in full
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in full
    blocked = plan_of(
        di.candidate_routes(embed_hashed(docs), routes, max_cells=300).select(
            "doc_id", "candidates"
        )
    )
    assert "CartesianProduct" not in blocked and "NestedLoop" not in blocked
    assert blocked.count("md5(cast(lambda") == 1


def test_centroid_of_references_is_their_mean(spark, data):
    refs, _ = data
    embedded = embed_hashed(
        spark.createDataFrame(refs, "route string, ref_id bigint, ref_text string"),
        "ref_text",
        DIMS,
    )
    got = defaultdict(lambda: np.zeros(DIMS))
    for r in ro.centroid_rows(embedded).collect():
        got[r["route"]][r["dim"]] = r["v"]
    for route in CLASSES:
        want = np.mean([vector(t) for r, _, t in refs if r == route], axis=0)
        assert np.allclose(got[route], want, atol=1e-12)
        assert not math.isclose(np.linalg.norm(want), 0)
