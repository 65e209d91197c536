"""Exact nearest routes among more references than one task holds, by an index of balls.

The references are put into blocks around centres drawn from them; a block knows the
largest distance r of its vectors from its centre c and their largest norm. For an
article a and a vector x of the block both of these hold:

    a.x <= a.c + |a| r          and          |a - x| >= |a - c| - r

so no reference of the block is nearer than the larger of the two bounds on 1 - a.x that
follow. Every article visits the few blocks with the least bound first. The distance to
its k-th route among those is a limit for the answer, and a second visit goes to just the
other blocks whose bound does not exceed it. The answer is that of comparing with all.

Where bounds say little, an article would be sent to nearly every block. One with more than
``FEW`` open blocks goes to shelves instead: each holds many consecutive blocks and meets an
article once. The number of shelves, and of groups of articles that meet one, follows the
cores, so what is moved grows with the input until a shelf holds ``SHELF_CELLS`` numbers.

What the driver and every task hold are the centres and a row of five numbers per block:
at most ``max_cells`` numbers and one row per ``block_rows`` references. A block with many
vectors is parted, and the articles that visit one block are dealt over as many groups as
they need.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.session import materialize

BLOCK_ROWS = 20_000  # references of one block, at most about
CENTRE_CELLS = 2_000_000  # numbers of all centres
CENTRES = 4  # centres are this many times the root of the references
PROBES = 2  # blocks of the first visit, at least
SLACK = 1e-8  # more than what rounding moves a bound or a distance
SUBS = 1 << 20  # numbers of parts of one centre
FEW = 64  # blocks of the second visit, at most; an article with more open ones goes to shelves
SHELF_CELLS = 8_000_000  # numbers of the references of one shelf, and of the articles that meet it in one task


class Balls(NamedTuple):
    """An index: ``placed`` has the references by ``_block``, ``blocks`` a row per block."""

    placed: DataFrame
    centres: np.ndarray
    blocks: dict[str, np.ndarray]

    def shelves(self, rows: int) -> np.ndarray:
        """The shelf of every block, from 0: consecutive blocks with about ``rows`` references."""
        before = np.concatenate([[0], np.cumsum(self.blocks["rows"])[:-1]])
        return np.unique(before // max(1, rows), return_inverse=True)[1]


class Found(NamedTuple):
    """``rows``: (_row, route, distance) with the k nearest of every article; visits and what all would be."""

    rows: DataFrame
    visits: int
    all_visits: int


def _array_code(sparse: bool, cells: int):
    """Array code for the workers, as closures: shipped by value, nothing to import there."""

    def matrices(columns: list[pa.Array], width: int, wide: int):
        """Slices of the articles as (first row, matrix), of at most ``cells`` numbers a row ``wide``."""
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        sizes = np.asarray(columns[0].value_lengths().fill_null(0), dtype="int64")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = [np.asarray(c.flatten()) for c in columns]
        step = max(1, cells // max(width, wide, 1))
        for at in range(0, len(sizes), step):
            some = sizes[at : at + step]
            a, b = ends[at], ends[at + len(some)]
            out = np.zeros((len(some), width))
            slots = flat[0][a:b] if sparse else np.arange(b - a) % width
            out[np.repeat(np.arange(len(some)), some), slots] = flat[-1][a:b]
            yield at, out

    def gaps(matrix, centres):
        """Distance of every row from every centre."""
        squares = (matrix**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(squares - 2 * (matrix @ centres.T), 0))

    def bounds(matrix, centres, blocks):
        """What no distance to a reference of each block goes below."""
        size = (matrix**2).sum(axis=1)[:, None]
        centre, radius = blocks["centre"], blocks["radius"][None, :]
        inner = 1 - (matrix @ centres.T)[:, centre] - np.sqrt(size) * radius
        gap = np.maximum(gaps(matrix, centres)[:, centre] - radius, 0)
        return np.maximum(inner, 1 - (size + blocks["square"][None, :]) / 2 + gap**2 / 2)

    return matrices, gaps, bounds


def build_balls(
    routes: DataFrame, block_rows: int = BLOCK_ROWS, centre_cells: int = CENTRE_CELLS, cells: int = 4_000_000
) -> Balls:
    """Index a written route table (route, threshold, vec with dense vectors of one length)."""
    spark = routes.sparkSession
    size = routes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    width = size["d"] or 1
    count = max(1, min(math.ceil(CENTRES * math.sqrt(size["n"])), centre_cells // width))
    # a pseudorandom draw of bounded size, the same on every run
    drawn = routes.select("vec", F.xxhash64("route", "vec").alias("h")).orderBy("h").limit(count)
    centres = np.array([r["vec"] for r in drawn.select("vec").collect()], dtype="float64").reshape(-1, width)
    shared = spark.sparkContext.broadcast(centres)
    matrices, gaps, _ = _array_code(False, cells)

    @F.arrow_udf("struct<centre:int,gap:double,square:double>")
    def place(vec: pa.Array) -> pa.Array:
        nearest, gap, square = [np.zeros(0, "int32")], [np.zeros(0)], [np.zeros(0)]
        for _, matrix in matrices([vec], width, len(shared.value)):
            away = gaps(matrix, shared.value)
            at = away.argmin(axis=1)
            nearest.append(at.astype("int32"))
            # from the vectors themselves: the distances of all are too coarse close to a centre
            gap.append(np.sqrt(((matrix - shared.value[at]) ** 2).sum(axis=1)))
            square.append((matrix**2).sum(axis=1))
        columns = [pa.array(np.concatenate(x)) for x in (nearest, gap, square)]
        return pa.StructArray.from_arrays(columns, ["centre", "gap", "square"])

    at = materialize(
        routes.select("route", "threshold", "vec", place(F.col("vec").cast("array<double>")).alias("_at"))
    )
    parts = materialize(
        at.groupBy(F.col("_at.centre").alias("_centre")).agg(
            F.ceil(F.count(F.lit(1)) / block_rows).alias("_parts")
        )
    )
    block = F.col("_centre") * F.lit(SUBS).cast("bigint") + F.pmod(F.xxhash64("route", "vec"), "_parts")
    placed = materialize(
        at.withColumn("_centre", F.col("_at.centre")).join(parts, "_centre").withColumn("_block", block)
    )
    found = (
        placed.groupBy("_block")
        .agg(
            F.max("_at.gap").alias("radius"),
            F.max("_at.square").alias("square"),
            F.max("threshold").alias("limit"),
            F.count(F.lit(1)).alias("rows"),
        )
        .orderBy("_block")
        .toArrow()
    )
    names = found.column("_block").to_numpy()
    blocks = {k: found.column(k).to_numpy() for k in ("radius", "square", "limit", "rows")}
    blocks |= {"name": names, "centre": names // SUBS}
    return Balls(placed.select("_block", "route", "threshold", "vec"), centres, blocks)


def _visitor(balls: Balls, shelf: np.ndarray, spark, sparse: bool, first: int, within: bool, cells: int):
    """A column function: blocks of the first visit, or (given a limit) of the second.

    Shelves are numbered downwards from -1, below all blocks.
    """
    matrices, _, bounds = _array_code(sparse, cells)
    shared = spark.sparkContext.broadcast((balls.centres, balls.blocks))
    slack, few = SLACK, FEW
    begins = np.unique(shelf, return_index=True)[1]
    labels = np.concatenate([balls.blocks["name"], -1 - np.arange(len(begins))])

    def chosen(columns: list[pa.Array], best: pa.Array) -> pa.Array:
        centres, blocks = shared.value
        known = np.asarray(best.is_valid())
        limit = np.asarray(best.fill_null(0.0))
        counts, names = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for at, matrix in matrices(columns, centres.shape[1], len(blocks["name"])):
            low = bounds(matrix, centres, blocks) - slack
            # a block with a vector that is no number is always open, an article that is none goes nowhere
            low[np.isnan(low)] = -np.inf
            low[~np.isfinite(matrix).all(axis=1)] = np.inf
            go = low <= limit[at : at + len(matrix), None]
            asked = ~known[at : at + len(matrix)]
            if asked.any():
                some = np.ones((int(asked.sum()), low.shape[1]), bool)
                if first < low.shape[1]:
                    some[:] = False
                    nearest = np.argpartition(low[asked], first - 1, axis=1)[:, :first]
                    np.put_along_axis(some, nearest, True, axis=1)
                go[asked] = some
            if within:
                go &= low <= blocks["limit"][None, :]
            go &= low < np.inf
            many = ~asked & (go.sum(axis=1) > few)
            up = np.zeros((len(matrix), len(begins)), bool)
            if many.any():
                up[many] = np.logical_or.reduceat(go[many], begins, axis=1)
                go[many] = False
            go = np.concatenate([go, up], axis=1)
            counts.append(go.sum(axis=1))
            names.append(labels[np.nonzero(go)[1]])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(names)))

    if sparse:

        @F.arrow_udf("array<bigint>")
        def visits(dims: pa.Array, vals: pa.Array, best: pa.Array) -> pa.Array:
            return chosen([dims, vals], best)

    else:

        @F.arrow_udf("array<bigint>")
        def visits(dense: pa.Array, best: pa.Array) -> pa.Array:
            return chosen([dense], best)

    return visits.asNondeterministic()


def _compare(visits: DataFrame, placed: DataFrame, sparse: bool, k: int, within: bool, group_rows: int, kernels) -> DataFrame:
    """(_row, route, distance): of every visit the k nearest routes of its block (or shelf)."""
    references, products, rounded, nearest = kernels
    columns = [c for c in visits.columns if c.startswith("_v")]
    # a row per block that is visited; most blocks have one group
    groups = materialize(
        visits.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("_groups"))
    )
    left = visits.join(groups, "_block").withColumn("_salt", F.pmod(F.xxhash64("_row"), "_groups"))
    right = placed.join(groups, "_block").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_groups") - 1))
    )

    def meet(articles: pa.Table, block: pa.Table) -> pa.Table:
        rows, owners, picked, found, names = articles.column("_row").combine_chunks(), [], [], [], []
        if len(articles) and len(block):
            names, limits, starts, matrix = references(block)
            vectors = [articles.column(c).combine_chunks() for c in columns]
            for at, part in products(vectors, starts, matrix):
                row, which, distance = nearest(rounded(part), limits, k, within)
                owners.append(row + at)
                picked.append(which)
                found.append(distance)
        one = [np.concatenate(x) if x else np.zeros(0) for x in (owners, picked, found)]
        return pa.table(
            {
                "_row": rows.take(pa.array(one[0].astype("int64"))),
                "route": pa.array(names, pa.string()).take(pa.array(one[1].astype("int64"))),
                "distance": pa.array(one[2].astype("float64")),
            }
        )

    return (
        left.select("_block", "_salt", "_row", *columns)
        .groupBy("_block", "_salt")
        .cogroup(right.select("_block", "_salt", "route", "threshold", "vec").groupBy("_block", "_salt"))
        .applyInArrow(meet, "_row string, route string, distance double")
    )


def _best_of(rows: DataFrame, k: int) -> DataFrame:
    """(_row, _near): the k nearest routes of each article, nearest first; at most k per block come in."""
    one = rows.groupBy("_row", "route").agg(F.min("distance").alias("distance"))
    pair = F.struct("distance", "route")
    return one.groupBy("_row").agg(F.slice(F.sort_array(F.collect_list(pair)), 1, k).alias("_near"))


def nearest_by_balls(
    vectors: DataFrame,
    balls: Balls,
    columns: list[Column],
    k: int,
    within: bool,
    sparse: bool,
    group_rows: int,
    kernels,
    cells: int = 4_000_000,
) -> Found:
    """The k nearest routes of every article of ``vectors`` (``_row`` and its vector ``columns``)."""
    spark = vectors.sparkSession
    names = [f"_v{i}" for i in range(len(columns))]
    total, width = int(balls.blocks["rows"].sum()), balls.centres.shape[1]
    # so many shelves, and groups that meet one, that every core has a pair of both
    sides = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    held = max(1, SHELF_CELLS // width)
    shelf = balls.shelves(min(held, math.ceil(total / sides)))
    visitor = _visitor(balls, shelf, spark, sparse, max(PROBES, k), within, cells)
    unknown = F.lit(None).cast("double")
    rows = vectors.select("_row", *[c.alias(n) for c, n in zip(columns, names)]).dropDuplicates(["_row"])
    articles = materialize(rows.withColumn("_first", visitor(*names, unknown)))
    first = articles.withColumn("_block", F.explode("_first")).drop("_first")
    near = materialize(_best_of(_compare(first, balls.placed, sparse, k, within, group_rows, kernels), k))
    # fewer than k so far: whatever is left may be one of them
    reach = F.when(F.size("_near") == k, F.element_at("_near", -1)["distance"])
    limits = near.select("_row", reach.alias("_limit"))
    limited = articles.join(limits, "_row", "left").withColumn("_limit", F.coalesce("_limit", F.lit(float("inf"))))
    # vectors are written once, not once per visit
    left = materialize(limited.select("_row", *names, F.array_except(visitor(*names, "_limit"), "_first").alias("_left")))
    second = left.withColumn("_block", F.explode("_left")).drop("_left")
    count = articles.count()
    shelved = balls.placed.join(
        spark.createDataFrame(pa.table({"_block": balls.blocks["name"], "_shelf": -1 - shelf})), "_block"
    ).select(F.col("_shelf").alias("_block"), "route", "threshold", "vec")
    group = max(group_rows, min(held, math.ceil(count / sides)))
    more = _compare(second, balls.placed.unionByName(shelved), sparse, k, within, group, kernels)
    old = near.select("_row", F.inline("_near")).select("_row", "route", "distance")
    # a visit to a shelf is one to all of its blocks
    weights = {-1 - int(i): int(n) for i, n in enumerate(np.bincount(shelf))}
    sent = second.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()
    visits = articles.agg(F.coalesce(F.sum(F.size("_first")), F.lit(0))).first()[0]
    visits += sum(r["n"] * weights.get(r["_block"], 1) for r in sent)
    return Found(_best_of(old.unionByName(more), k), visits, count * len(balls.blocks["name"]))
