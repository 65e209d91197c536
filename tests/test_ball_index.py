"""The index of balls gives what comparing with every reference gives."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signpost.operators import ball_index as bi
from signpost.operators import distances as di
from signpost.session import materialize


def table(spark, vectors, names, threshold=2.0):
    rows = [(n, i, threshold, v.tolist()) for i, (n, v) in enumerate(zip(names, vectors))]
    return materialize(
        spark.createDataFrame(rows, "route string, ref_id bigint, threshold double, vec array<double>")
    )


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near(df):
    return sorted((r["id"], [tuple(c) for c in r["candidates"]]) for r in df.collect())


@pytest.mark.parametrize("k,within", [(1, True), (1, False), (3, False), (50, True)])
@pytest.mark.parametrize("kind", ["clusters", "noise", "any length"])
def test_equal_to_the_matrix_way(spark, k, within, kind):
    rng = np.random.default_rng(3)
    homes = unit(rng.normal(size=(9, 8)))
    refs = homes[rng.integers(0, 9, 600)] + rng.normal(size=(600, 8)) * (0.05 if kind == "clusters" else 3)
    refs = refs * rng.uniform(0.1, 2, size=(600, 1)) if kind == "any length" else unit(refs)
    routes = table(spark, refs, [f"r{i % 40:02d}" for i in range(600)], 0.3)
    queries = unit(homes[rng.integers(0, 9, 200)] + rng.normal(size=(200, 8)) * 0.2)
    rows = [(i, q.tolist()) for i, q in enumerate(queries)]
    rows += [(7, queries[0].tolist()), (3, None), (201, [float("nan")] * 8), (202, [0.0] * 8), (0, queries[0].tolist())]
    articles = spark.createDataFrame(rows, "id bigint, vec array<double>")
    how = dict(id_col="id", k=k, within_threshold=within, sparse=False)
    whole = near(di.candidate_routes(articles, routes, **how))
    parted = di.candidate_routes(articles, routes, max_cells=400, group_rows=17, product_cells=300, **how)
    assert near(parted) == whole


def test_equal_distances_go_to_the_smaller_name(spark):
    """Copies of one vector under many names, parted into many blocks."""
    one = np.tile([[1.0, 0.0]], (60, 1))
    routes = table(spark, one, [f"n{59 - i:02d}" for i in range(60)])
    articles = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, vec array<double>")
    for k in (1, 5):
        got = near(di.candidate_routes(articles, routes, "id", k=k, within_threshold=False, sparse=False, max_cells=8))
        assert got == [(i, [(float(i == 2), f"n{j:02d}") for j in range(k)]) for i in (1, 2)]


def test_a_reference_that_is_no_number_hides_no_other(spark):
    refs = np.array([[1.0, 0.0], [float("nan"), 0.0], [0.0, 1.0]])
    routes = table(spark, refs, ["a", "b", "c"])
    articles = spark.createDataFrame([(1, [0.6, 0.8])], "id bigint, vec array<double>")
    for cells in (8_000_000, 2):
        got = di.candidate_routes(articles, routes, "id", k=3, within_threshold=False, sparse=False, max_cells=cells, row_cells=1)
        assert near(got) == [(1, [(0.2, "c"), (0.4, "a")])]


def test_bounds_hold(spark):
    rng = np.random.default_rng(5)
    refs, queries = rng.normal(size=(300, 6)), rng.normal(size=(80, 6))
    balls = bi.build_balls(table(spark, refs, ["x"] * 300), block_rows=20, centre_cells=60)
    low = bi._array_code(False, 1000)[2](queries, balls.centres, balls.blocks)
    placed = balls.placed.collect()
    assert len(placed) == 300 and len(balls.centres) == 10  # as many as centre_cells allows
    at = {n: i for i, n in enumerate(balls.blocks["name"].tolist())}
    for r in placed:
        assert (1 - queries @ np.array(r["vec"]) >= low[:, at[r["_block"]]] - 1e-9).all()


def test_few_of_many_blocks_are_visited(spark):
    """100,000 references in 300 clusters: the answers of the matrix way, a small part of its work."""
    rng = np.random.default_rng(9)
    homes = unit(rng.normal(size=(300, 16)))
    refs = unit(homes[rng.integers(0, 300, 100_000)] + rng.normal(size=(100_000, 16)) * 0.04)
    frame = spark.createDataFrame(pa.table({"ref_id": range(100_000), "vec": list(refs)}))
    routes = materialize(
        frame.select(F.format_string("r%04d", F.col("ref_id") % 5000).alias("route"), "ref_id", F.lit(2.0).alias("threshold"), "vec")
    )
    queries = unit(homes[rng.integers(0, 300, 2000)] + rng.normal(size=(2000, 16)) * 0.04)
    articles = spark.createDataFrame(pa.table({"id": range(2000), "vec": list(queries)}))
    how = dict(id_col="id", k=3, within_threshold=False, sparse=False)
    whole = near(di.candidate_routes(articles, routes, **how))
    keyed = di._with_row_key(articles, "id", "vec", False)
    found = bi.nearest_by_balls(
        keyed, bi.build_balls(routes), [F.col("vec")], 3, False, False, di.GROUP_ROWS, di._kernels(False, di.PRODUCT_CELLS)
    )
    got = keyed.join(found.rows, "_row").select("id", F.col("_near").alias("candidates"))
    assert near(got) == whole
    assert found.all_visits == 2000 * 1265 and found.visits < 0.05 * found.all_visits


def test_bounds_that_say_nothing_send_no_vector_to_every_block(spark):
    """Noise of 24 numbers: nearly all blocks stay open, an article meets a few shelves instead."""
    rng = np.random.default_rng(4)
    vectors = unit(rng.normal(size=(3000, 24)))
    routes = table(spark, vectors, [f"r{i:04d}" for i in range(3000)])
    balls = bi.build_balls(routes, block_rows=10, centre_cells=480)
    total = len(balls.blocks["name"])
    shelf = balls.shelves(1000)
    assert total > 250 and shelf.tolist() == sorted(shelf) and shelf[-1] <= 4
    assert max(np.bincount(shelf, weights=balls.blocks["rows"])) < 1000 + max(balls.blocks["rows"])
    visitor = bi._visitor(balls, shelf, spark, False, 3, False, 10_000)
    articles = spark.createDataFrame(pa.table({"id": range(100), "vec": list(vectors[:100])}))
    rows = articles.select(visitor("vec", F.lit(2.0)).alias("v")).collect()
    assert all(sorted(r["v"]) == sorted(-1 - np.unique(shelf)) for r in rows)
    how = dict(id_col="id", k=3, within_threshold=False, sparse=False)
    whole = near(di.candidate_routes(articles, routes, **how))
    assert near(di.candidate_routes(articles, routes, max_cells=240, **how)) == whole
