"""Ranking that no single hot key, and no global order, sends to one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.checks import fraction, positive
from signpost.session import materialize


def seeded_order(id_col: str, seed: int) -> Column:
    """A pseudo-random order that any engine and any partitioning repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_col: str = "rank",
    salts: int = 32,
) -> DataFrame:
    """The first ``n`` rows of each group, with their rank.

    Two steps: the first ``n`` within (group, salt), then the first ``n`` of the
    at most ``salts * n`` survivors. Spark's window group limit prunes before
    either shuffle, so a group holding most of the rows stays spread. The limit works up
    to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows (1,000); for a larger ``n`` in
    seeded order ``first_rows`` moves less.
    """
    positive("n", n)
    positive("salts", salts)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    survivors = (
        salted.withColumn("_rank", F.row_number().over(inner))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_salt")
    )
    return survivors.withColumn(rank_col, F.row_number().over(outer)).filter(F.col(rank_col) <= n)


def share_cuts(
    df: DataFrame, group: str, id_col: str, share: float, seed: int, prefix_len: int = 4
) -> DataFrame:
    """Where each group's first ``ceil(share * rows)`` rows in seeded order end: see ``hash_cuts``."""
    fraction("share", share)
    return hash_cuts(df, group, id_col, lambda n: F.ceil(n * F.lit(share)), seed, prefix_len)


def first_rows(df: DataFrame, group: str, id_col: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of each group in seeded order, found by counting; rows stay where they lie.

    Repeated ids at the end of a group's share come along, so it may hold a few rows more.
    """
    positive("n", n)
    cuts = hash_cuts(df, group, id_col, lambda size: F.least(size, F.lit(n)), seed)
    return with_share_flag(df, cuts, group, id_col, seed, "_first").filter("_first").drop("_first")


def hash_cuts(
    df: DataFrame,
    group: str,
    id_col: str,
    quota: Callable[[Column], Column],
    seed: int,
    prefix_len: int = 4,
) -> DataFrame:
    """Where each group's first ``quota(rows)`` rows in seeded order end.

    A window over the group would hold a hot group in one task. Here the rows
    are counted by (group, prefix of the hash), a running sum over those counts
    (at most ``16 ** prefix_len`` per group) finds the prefix in which the quota
    is met, and only the rows of that one prefix are ranked. The result, written,
    is one row per group: see ``with_share_flag``.
    """
    positive("prefix_len", prefix_len)
    hashed = df.select(F.col(group).alias("_g"), F.col(id_col).alias("_id")).withColumn(
        "_h", seeded_order("_id", seed)
    )
    hashed = hashed.withColumn("_p", F.substring("_h", 1, prefix_len))
    counts = hashed.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy("_g").orderBy("_p")
    filled = (
        counts.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_quota", quota(F.sum("_n").over(Window.partitionBy("_g"))))
        .filter(
            (F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota"))
        )
        .select("_g", "_p", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    edge = materialize(filled)
    in_edge = hashed.alias("h").join(
        edge.alias("e"),
        F.col("h._g").eqNullSafe(F.col("e._g")) & (F.col("h._p") == F.col("e._p")),
    )
    nth = Window.partitionBy("h._g").orderBy("_h", "_id")
    return materialize(
        in_edge.withColumn("_r", F.row_number().over(nth))
        .filter(F.col("_r") == F.col("_need"))
        .select(
            F.col("h._g").alias("_cut_g"),
            F.col("_h").alias("_cut_h"),
            F.col("_id").alias("_cut_id"),
        )
    )


def with_share_flag(
    df: DataFrame, cuts: DataFrame, group: str, id_col: str, seed: int, flag_col: str
) -> DataFrame:
    """Mark the rows before their group's cut: a join with a tiny table, rows stay in place."""
    marked = df.withColumn("_h", seeded_order(id_col, seed)).join(
        cuts, F.col(group).eqNullSafe(F.col("_cut_g")), "left"
    )
    inside = (F.col("_h") < F.col("_cut_h")) | (
        (F.col("_h") == F.col("_cut_h")) & (F.col(id_col) <= F.col("_cut_id"))
    )
    return marked.withColumn(flag_col, F.coalesce(inside, F.lit(False))).drop(
        "_h", "_cut_g", "_cut_h", "_cut_id"
    )


def global_index(
    df: DataFrame, order_col: str, index_col: str = "idx", partitions: int | None = None
) -> DataFrame:
    """Consecutive numbers from 0 in the order of ``order_col`` (a unique key).

    An unpartitioned window would sort everything in one task. Rows are range
    partitioned and sorted, numbered inside their partition, written once, and
    shifted by the sizes of the partitions before theirs. Writing the numbered
    rows keeps both passes on the same partitions even if executors are lost;
    pass only the columns that are needed.
    """
    keys = [order_col] if partitions is None else [partitions, order_col]
    numbered = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(order_col)
        .withColumn("_at", F.monotonically_increasing_id())
        # the upper bits hold the partition, the lower 33 the row inside it
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at")
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: small enough for a single ordered window
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialize(
        sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    return (
        numbered.join(shifts, "_part")
        .withColumn(index_col, F.col("_shift") + F.col("_row"))
        .drop("_part", "_row", "_shift")
    )
