"""Threshold calibration: a grid of thresholds scored one route against the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signpost.checks import positive
from signpost.functions.scoring import ratio
from signpost.session import materialize


def threshold_sweep(
    distances: DataFrame, label_col: str = "label", steps: int = 100
) -> DataFrame:
    """Precision, recall and F1 of every route at each threshold ``i / steps``.

    ``distances`` has one row per article and route: (label, route, distance).
    A route is scored on its own distance (distance <= threshold), independent
    of the other routes. Instead of repeating every distance for every threshold,
    each falls into the first grid step that admits it; the steps are counted
    with partial aggregation and summed up along the grid.
    """
    positive("steps", steps)
    scale = F.lit(float(steps))
    low = F.greatest(F.lit(0), F.ceil(F.col("distance") * scale) - 1)
    # the product may land next to a grid point: compare with the grid values themselves
    step = (
        F.when(F.col("distance") <= low / scale, low)
        .when(F.col("distance") <= (low + 1) / scale, low + 1)
        .otherwise(low + 2)
    )
    # written once: the distances behind it are dear, the counts few
    hits = materialize(
        distances.withColumn("_step", F.least(step, F.lit(steps + 1)))
        .groupBy("route", "_step")
        .agg(
            F.count_if(F.lower(F.col(label_col)) == F.lower(F.col("route"))).alias("_own"),
            F.count(F.lit(1)).alias("_all"),
        )
    )
    # every route has a row at every step; a step past the grid still counts as support
    grid = (
        hits.select("route")
        .distinct()
        .select("route", F.explode(F.sequence(F.lit(0), F.lit(steps + 1))).alias("_step"))
    )
    upto = Window.partitionBy("route").orderBy("_step")
    whole = Window.partitionBy("route")
    summed = (
        grid.withColumn("_step", F.col("_step").cast("bigint"))
        .join(hits, ["route", "_step"], "left")
        .na.fill(0, ["_own", "_all"])
        .withColumn("tp", F.sum("_own").over(upto))
        .withColumn("fp", F.sum("_all").over(upto) - F.col("tp"))
        .withColumn("fn", F.sum("_own").over(whole) - F.col("tp"))
        .filter(F.col("_step") <= steps)
    )
    scored = summed.withColumn(
        "precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    ).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.select(
        "route",
        (F.col("_step") / scale).alias("threshold"),
        "tp",
        "fp",
        "fn",
        "precision",
        "recall",
        # the same as 2pr / (p + r), from whole numbers
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def exact_counts(distances: DataFrame, label_col: str = "label", partitions: int | None = None) -> DataFrame:
    """Confusion counts of every route at each distinct distance: (route, threshold, tp, fp, fn, f1).

    ``distances`` has (label, route, distance). At a threshold a route takes every article at or
    below it, so only distinct distances matter. They are counted with partial aggregation,
    range partitioned by (route, distance) and summed up inside their partition; the
    totals of the partitions before, a row per route and partition, are added to them. No
    window holds a whole route, however many distances it has. Distances that are
    null or no number count as support that no threshold reaches.
    """
    own = F.lower(F.col(label_col)) == F.lower(F.col("route"))
    number = F.when(F.col("distance") < F.lit(float("inf")), F.col("distance"))
    counts = distances.groupBy("route", number.alias("threshold")).agg(
        F.count_if(own).alias("_own"), F.count(F.lit(1)).alias("_all")
    )
    keys = ["route", "threshold"] if partitions is None else [partitions, "route", "threshold"]
    # written: the partition of a row is part of the sums, and the distances behind it are dear
    placed = materialize(counts.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    reached = F.col("threshold").isNotNull()
    totals = placed.groupBy("route", "_part").agg(
        F.sum(F.when(reached, F.col("_own")).otherwise(0)).alias("_own_in"),
        F.sum(F.when(reached, F.col("_all")).otherwise(0)).alias("_all_in"),
        F.sum("_own").alias("_support_in"),
    )
    # a row per route and partition that holds some of it
    before = Window.partitionBy("route").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("route")
    shifts = materialize(
        totals.select(
            "route",
            "_part",
            F.coalesce(F.sum("_own_in").over(before), F.lit(0)).alias("_own_before"),
            F.coalesce(F.sum("_all_in").over(before), F.lit(0)).alias("_all_before"),
            F.sum("_support_in").over(whole).alias("_support"),
        )
    )
    upto = Window.partitionBy("_part", "route").orderBy("threshold")
    tp, taken = F.col("tp"), F.col("_taken")
    return (
        placed.filter(reached)
        .withColumn("_own_here", F.sum("_own").over(upto))
        .withColumn("_all_here", F.sum("_all").over(upto))
        .join(shifts, ["route", "_part"])
        .withColumn("tp", F.col("_own_here") + F.col("_own_before"))
        .withColumn("_taken", F.col("_all_here") + F.col("_all_before"))
        .select(
            "route",
            "threshold",
            "tp",
            (taken - tp).alias("fp"),
            (F.col("_support") - tp).alias("fn"),
            ratio(2 * tp, taken + F.col("_support")).alias("f1"),
        )
    )


def best_thresholds(sweep: DataFrame, digits: int = 12) -> DataFrame:
    """Per route the threshold with the best F1; the smallest one on ties."""
    best = F.min(
        F.struct((-F.round("f1", digits)).alias("_loss"), F.col("threshold").alias("_threshold"))
    )
    return (
        sweep.groupBy("route")
        .agg(best.alias("_best"))
        .select(
            "route",
            F.col("_best._threshold").alias("threshold"),
            (-F.col("_best._loss")).alias("f1"),
        )
    )
