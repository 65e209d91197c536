"""Cosine distances between articles and routes.

A route table has (route, ref_id, threshold, vec) with dense unit vectors, one
row per centroid or per reference. The distance of an article to a route is the
smallest over the route's vectors. The table was written and is counted before
use; its size picks one of three ways to the same answers, for repeated ids, for
articles without a vector and for distances that are no number, too:

* one vector per route and few routes: array functions inside the article's row;
* up to ``max_cells`` numbers: the table is broadcast, and each Arrow batch of
  articles is one matrix product. Neither way moves or joins the articles;
* more: the nearest are looked up in an index of balls (``ball_index``), where an article
  meets only blocks that may hold a nearer route. Where all distances are asked for, the
  table is cut into blocks of that size, and groups of articles meet every block by
  (block, salt). No task holds more than a block and a group.

Arrays are exploded in the outer form and emptied of nulls afterwards: for the
plain form Spark infers a filter on the array, and pushing it down repeats the
embedding and the distances below it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.checks import positive
from signpost.functions import vectors as vx
from signpost.operators.ball_index import BLOCK_ROWS, CENTRE_CELLS, build_balls, nearest_by_balls

MAX_CELLS = 8_000_000  # 64 MB of doubles
ROW_CELLS = 100_000  # array functions beat the matrix only on few routes
GROUP_ROWS = 20_000  # articles that meet a block in one task
PRODUCT_CELLS = 4_000_000  # numbers per matrix held at once

_CANDIDATES = "array<struct<distance:double,route:string>>"


def _kernels(sparse: bool, product_cells: int):
    """Array code for the workers, as closures: shipped by value, nothing to import there."""
    held, scale = product_cells, 10.0**vx.DISTANCE_DIGITS

    def references(table: pa.Table):
        """(names, thresholds, first row of each route, matrix), rows by route name."""
        names = table.column("route").to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        vectors = table.column("vec").combine_chunks()
        matrix = np.asarray(vectors.flatten()).reshape(len(names), -1)[order]
        names = [names[i] for i in order]
        starts = [i for i, n in enumerate(names) if i == 0 or n != names[i - 1]]
        limits = np.asarray(table.column("threshold").combine_chunks())[order]
        return [names[i] for i in starts], limits[starts], np.array(starts), matrix

    def products(columns: list[pa.Array], starts, matrix):
        """Yield (first row, distances to every route) for slices of the articles."""
        sizes = np.asarray(columns[0].value_lengths().fill_null(0), dtype="int64")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = [np.asarray(c.flatten()) for c in columns]
        width = matrix.shape[1]
        step = max(1, held // max(len(matrix), width))
        for at in range(0, len(sizes), step):
            some = sizes[at : at + step]
            a, b = ends[at], ends[at + len(some)]
            owner = np.repeat(np.arange(len(some)), some)
            slots = flat[0][a:b] if sparse else np.arange(b - a) % width
            queries = np.zeros((len(some), width))
            queries[owner, slots] = flat[-1][a:b]
            yield at, 1.0 - np.maximum.reduceat(queries @ matrix.T, starts, axis=1)

    def rounded(distances):
        return np.floor(distances * scale + 0.5) / scale

    def nearest(distances, limits, k, within):
        """(article, route, distance) of the k nearest, or of all; equal ones by name."""
        good = np.isfinite(distances)
        if within:
            good &= distances <= limits
        score = np.where(good, distances, np.inf)
        if k is not None and k <= 8 < score.shape[1]:
            # the first of the least, again and again, without sorting all
            lines, order = np.arange(len(score)), np.empty((len(score), k), dtype="int64")
            found = np.empty((len(score), k))
            for turn in range(k):
                order[:, turn] = score.argmin(axis=1)
                found[:, turn] = score[lines, order[:, turn]]
                score[lines, order[:, turn]] = np.inf
            row, col = np.nonzero(np.isfinite(found))
            return row, order[row, col], found[row, col]
        if k == 1:
            order = score.argmin(axis=1)[:, None]
        else:
            # stable: equal distances stay in the order of the names
            order = score.argsort(axis=1, kind="stable")[:, : (k or score.shape[1])]
        near = np.take_along_axis(score, order, axis=1)
        row, col = np.nonzero(np.isfinite(near))
        return row, order[row, col], near[row, col]

    return references, products, rounded, nearest


def _vector_columns(vec: Column, sparse: bool) -> list[Column]:
    if not sparse:
        return [vec.cast("array<double>")]
    return [F.transform(vec, lambda e: e["dim"]), F.transform(vec, lambda e: e["val"])]


def _row_distances(df: DataFrame, routes: DataFrame, vec: str, sparse: bool) -> DataFrame:
    dot = vx.sparse_dot if sparse else vx.dense_dot
    entry = F.struct("route", "threshold", "vec")
    packed = routes.agg(F.sort_array(F.collect_list(entry)).alias("_routes"))
    made = vx.let(
        F.col(vec),
        lambda v: F.transform(
            "_routes",
            lambda r: F.struct(
                r["route"].alias("route"),
                r["threshold"].alias("threshold"),
                vx.rounded_distance(dot(v, r["vec"])).alias("distance"),
            ),
        ),
    )
    return df.withColumn("_routes", packed.scalar()).withColumn("_made", made).drop("_routes")


def _matrix_candidates(
    df: DataFrame,
    routes: DataFrame,
    vec: str,
    sparse: bool,
    k: int | None,
    within: bool,
    product_cells: int,
) -> DataFrame:
    """Add ``candidates``: the k nearest are picked beside the product, in the worker."""
    references, products, rounded, nearest = _kernels(sparse, product_cells)
    # counted to be at most max_cells numbers
    table = references(routes.select("route", "threshold", "vec").toArrow())
    shared = df.sparkSession.sparkContext.broadcast(table)

    def found(columns: list[pa.Array]) -> pa.Array:
        names, limits, starts, matrix = shared.value
        counts = np.zeros(len(columns[0]), dtype="int64")
        picked, distances = [np.zeros(0, dtype="int64")], [np.zeros(0)]
        for at, part in products(columns, starts, matrix):
            row, which, distance = nearest(rounded(part), limits, k, within)
            counts[at : at + len(part)] = np.bincount(row, minlength=len(part))
            picked.append(which)
            distances.append(distance)
        entries = pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(distances)),
                pa.array(names, pa.string()).take(pa.array(np.concatenate(picked))),
            ],
            ["distance", "route"],
        )
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(offsets), entries)

    if sparse:

        @F.arrow_udf(_CANDIDATES)
        def candidates(dims: pa.Array, vals: pa.Array) -> pa.Array:
            return found([dims, vals])

    else:

        @F.arrow_udf(_CANDIDATES)
        def candidates(dense: pa.Array) -> pa.Array:
            return found([dense])

    # marked so that no rule copies the product into a pushed-down filter
    made = candidates.asNondeterministic()(*_vector_columns(F.col(vec), sparse))
    return (
        df.withColumn("_made", made)
        .withColumn("candidates", F.when(F.col(vec).isNotNull(), F.col("_made")).otherwise(_none()))
        .drop("_made")
    )


def _none() -> Column:
    return F.expr(f"cast(array() as {_CANDIDATES})")


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _block_rows(
    df: DataFrame,
    routes: DataFrame,
    id_col: str,
    vec: str,
    sparse: bool,
    n_blocks: int,
    k: int | None,
    within: bool,
    group_rows: int,
    product_cells: int,
) -> DataFrame:
    """(row key, route, distance) of the k nearest routes of every block, or of all."""
    references, products, rounded, nearest = _kernels(sparse, product_cells)
    salts = max(1, math.ceil(df.select(id_col).count() / group_rows))
    columns = [c.alias(f"_v{i}") for i, c in enumerate(_vector_columns(F.col(vec), sparse))]
    left = (
        df.select(F.col(id_col), *columns)
        .withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
        .withColumn("_block", F.explode(_upto(n_blocks)))
    )
    right = (
        routes.select("route", "threshold", "vec")
        .withColumn("_block", F.pmod(F.xxhash64("route", "vec"), F.lit(n_blocks)))
        .withColumn("_salt", F.explode(_upto(salts)))
    )
    id_type = df.schema[id_col].dataType.simpleString()
    width = len(columns)

    def meet(articles: pa.Table, block: pa.Table) -> pa.Table:
        # here and not by a filter, which would be pushed below the embedding and repeat it
        articles = articles.filter(articles.column("_v0").is_valid())
        ids = articles.column(id_col).combine_chunks()
        owners, picked, found = [], [], []
        names = []
        if len(articles) and len(block):
            names, limits, starts, matrix = references(block)
            vectors = [articles.column(f"_v{i}").combine_chunks() for i in range(width)]
            for at, part in products(vectors, starts, matrix):
                row, which, distance = nearest(rounded(part), limits, k, within)
                owners.append(row + at)
                picked.append(which)
                found.append(distance)
        one = [np.concatenate(x) if x else np.zeros(0) for x in (owners, picked, found)]
        return pa.table(
            {
                id_col: ids.take(pa.array(one[0].astype("int64"))),
                "route": pa.array(names, pa.string()).take(pa.array(one[1].astype("int64"))),
                "distance": pa.array(one[2].astype("float64")),
            }
        )

    rows = (
        left.groupBy("_block", "_salt")
        .cogroup(right.groupBy("_block", "_salt"))
        .applyInArrow(meet, f"`{id_col}` {id_type}, route string, distance double")
    )
    # a route whose references lie in several blocks comes back once per block
    return rows.groupBy(id_col, "route").agg(F.min("distance").alias("distance"))


def _size(routes: DataFrame) -> tuple[int, int, int]:
    """Vectors, routes and numbers of a written route table."""
    row = routes.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_distinct("route").alias("routes"),
        F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("cells"),
    ).first()
    return row["vectors"], row["routes"], row["cells"]


def _by_row(size: tuple[int, int, int], row_cells: int) -> bool:
    vectors, names, cells = size
    return 0 < vectors == names and cells <= row_cells


def _is_number(d: Column) -> Column:
    # a NaN is larger than every number
    return d["distance"] < F.lit(float("inf"))


def _nearest(distances: Column, k: int, within: bool) -> Column:
    """The k smallest (distance, route) of an array of distances."""

    def good(d: Column) -> Column:
        return _is_number(d) & (d["distance"] <= d["threshold"]) if within else _is_number(d)

    pairs = F.transform(F.filter(distances, good), lambda d: F.struct(d["distance"], d["route"]))
    if k == 1:
        return F.filter(F.array(F.array_min(pairs)), lambda c: c.isNotNull())
    return F.slice(F.sort_array(pairs), 1, k)


def _with_row_key(df: DataFrame, id_col: str, vec: str, sparse: bool) -> DataFrame:
    """Rows of one id and one vector have one answer, and no other rows have it."""
    key = F.xxhash64(F.col(id_col), *_vector_columns(F.col(vec), sparse))
    return df.withColumn("_row", F.struct(F.col(id_col).alias("id"), key.alias("h")).cast("string"))


def candidate_routes(
    df: DataFrame,
    routes: DataFrame,
    id_col: str = "doc_id",
    vec: str = "vec",
    k: int = 1,
    within_threshold: bool = True,
    sparse: bool = True,
    max_cells: int = MAX_CELLS,
    row_cells: int = ROW_CELLS,
    group_rows: int = GROUP_ROWS,
    product_cells: int = PRODUCT_CELLS,
) -> DataFrame:
    """Add ``candidates``: the k nearest (distance, route) of each article, nearest first.

    With ``within_threshold`` a route counts only if its distance is at most its
    own threshold. Equal distances go to the smaller route name.
    """
    positive("k", k)
    positive("max_cells", max_cells)
    size = _size(routes)
    if size[0] == 0:
        return df.withColumn("candidates", _none())
    if _by_row(size, row_cells):
        near = _nearest(F.col("_made"), k, within_threshold)
        return (
            _row_distances(df, routes, vec, sparse)
            .withColumn("candidates", F.when(F.col(vec).isNotNull(), near).otherwise(_none()))
            .drop("_made")
        )
    if size[2] <= max_cells:
        return _matrix_candidates(df, routes, vec, sparse, k, within_threshold, product_cells)
    keyed = _with_row_key(df, id_col, vec, sparse)
    # no block larger than a broadcast table may be
    block_rows = max(1, min(BLOCK_ROWS, max_cells * size[0] // size[2]))
    balls = build_balls(routes, block_rows, min(CENTRE_CELLS, max_cells), product_cells)
    merged = nearest_by_balls(
        keyed.filter(F.col(vec).isNotNull()),
        balls,
        _vector_columns(F.col(vec), sparse),
        k,
        within_threshold,
        sparse,
        group_rows,
        _kernels(sparse, product_cells),
        product_cells,
    ).rows.withColumnRenamed("_near", "candidates")
    return (
        keyed.join(merged, "_row", "left")
        .withColumn("candidates", F.coalesce("candidates", _none()))
        .drop("_row")
    )


def distance_rows(
    df: DataFrame,
    routes: DataFrame,
    id_col: str = "doc_id",
    vec: str = "vec",
    keep: Sequence[str] = (),
    sparse: bool = True,
    max_cells: int = MAX_CELLS,
    row_cells: int = ROW_CELLS,
    group_rows: int = GROUP_ROWS,
    product_cells: int = PRODUCT_CELLS,
) -> DataFrame:
    """Distance of every article to every route: (id, *keep, route, distance)."""
    positive("max_cells", max_cells)
    size = _size(routes)
    if size[0] == 0:
        none = df.withColumn("_made", _none()).select(id_col, *keep, F.inline_outer("_made"))
        return none.filter("route IS NOT NULL").select(id_col, *keep, "route", "distance")
    if size[2] > max_cells:
        n_blocks = math.ceil(size[2] / max_cells)
        keyed = _with_row_key(df, id_col, vec, sparse)
        rows = _block_rows(
            keyed, routes, "_row", vec, sparse, n_blocks, None, False, group_rows, product_cells
        )
        return keyed.select("_row", id_col, *keep).join(rows, "_row").drop("_row")
    if _by_row(size, row_cells):
        made = _row_distances(df, routes, vec, sparse).withColumn(
            "_made", F.when(F.col(vec).isNotNull(), F.filter("_made", _is_number))
        )
    else:
        made = _matrix_candidates(df, routes, vec, sparse, None, False, product_cells).withColumn(
            "_made", F.col("candidates")
        )
    return (
        made.select(id_col, *keep, F.inline_outer("_made"))
        .filter(F.col("route").isNotNull())
        .select(id_col, *keep, "route", "distance")
    )
