"""Column expressions over vectors.

A *sparse* vector is ``array<struct<dim int, val double>>`` with at most one
entry per dimension; a *dense* vector is ``array<double>`` (or float).
All of it stays inside one row, so embedding and distances need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from signpost.checks import positive
from signpost.functions.text import WHITESPACE

DISTANCE_DIGITS = 9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    Without the binding Catalyst may inline an expensive column into the lambda
    that reads it and evaluate it once per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_terms(text: Column, dims: int) -> Column:
    """Histogram of hashed lower-cased words: ``array<struct<dim int, n int>>``.

    The hashed words are sorted as an array, and every run of equal values
    becomes one entry; linear in the words but for the sort, no shuffle.
    """
    positive("dims", dims)
    found = F.filter(F.split(F.lower(text), WHITESPACE + "+"), lambda w: w != "")
    slots = F.transform(
        found,
        lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % dims).cast("int"),
    )

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        first = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            first,
            lambda starts: F.transform(
                starts,
                lambda p, j: F.struct(
                    F.get(ordered, p).alias("dim"),
                    (F.coalesce(F.get(starts, j + 1), size) - p).alias("n"),
                ),
            ),
        )

    empty = F.expr("cast(array() as array<struct<dim:int,n:int>>)")
    # a missing text has no size, and no histogram
    return let(
        F.sort_array(slots),
        lambda s: F.when(F.size(s) > 0, runs(s)).when(F.size(s) == 0, empty),
    )


def unit_terms(terms: Column) -> Column:
    """Term counts scaled to length one: a sparse vector."""

    def scaled(bound: Column) -> Column:
        norm = F.sqrt(
            F.aggregate(
                bound,
                F.lit(0.0),
                lambda acc, t: acc + t["n"].cast("double") * t["n"].cast("double"),
            )
        )
        return let(
            norm,
            lambda length: F.transform(
                bound, lambda t: F.struct(t["dim"].alias("dim"), (t["n"] / length).alias("val"))
            ),
        )

    return let(terms, scaled)


def hashed_vector(text: Column, dims: int) -> Column:
    """Sparse unit vector of a text."""
    return unit_terms(hashed_terms(text, dims))


def unit_dense(vec: Column) -> Column:
    """Dense vector scaled to length one; a zero vector stays zero."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(
            F.aggregate(
                v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
            )
        )
        return let(
            norm,
            lambda length: F.transform(
                v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0))
            ),
        )

    return let(vec, scaled)


def sparse_dot(sparse: Column, dense: Column) -> Column:
    return F.aggregate(
        sparse, F.lit(0.0), lambda acc, e: acc + e["val"] * F.get(dense, e["dim"])
    )


def dense_dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def rounded_distance(dot: Column) -> Column:
    """Cosine distance of unit vectors, rounded so that ties and threshold edges are stable.

    The same rule as the matrix code: half of the last digit goes up. A distance
    that is no number stays as it is.
    """
    scale = 10.0**DISTANCE_DIGITS

    def rounded(d: Column) -> Column:
        return F.when(F.abs(d) < 1e6, F.floor(d * scale + 0.5) / F.lit(scale)).otherwise(d)

    return let(F.lit(1.0) - dot, rounded)


def confidence(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)
