"""Bottom-k sketches of word shingles.

A text's sketch is the sorted list of its k smallest distinct shingle hashes. Two
sketches merge into the sketch of the joined parts, and estimate resemblance,
containment and the number of distinct shingles. With at most k shingles on both
sides all of it is exact. Everything is array functions inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signpost.llm.exprs import hex64, let, positions, words
from signpost.operators.ranking import top_n_per_group
from signpost.session import materialize

K = 128
SHINGLE = 5
# Keys sampled per range, bytes of text a range is to hold, and how many ranges there are at most.
SAMPLED = 32
RANGE_BYTES = 4 << 20
MAX_RANGES = 1 << 16


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of the word shingles, repeats included.

    A text of fewer than ``width`` words is one shingle; without a word there is none.
    """

    def of_words(hashes: Column) -> Column:
        n = F.size(hashes)
        return (
            F.when(
                n >= width,
                F.transform(
                    positions(n - (width - 1)),
                    lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]),
                ),
            )
            .when(n > 0, F.array(F.xxhash64(hashes)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of_words)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    """The k smallest distinct shingle hashes, in order; null and empty texts: empty."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together, from the sketches of the parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(df: DataFrame, group: str, sketch_col: str, k: int = K) -> DataFrame:
    """One sketch per group (``group``, ``sketch``) from the sketches of its parts.

    The k smallest hashes are found per (group, salt) first, so that a group of very
    many parts is spread; a group whose parts have no hash is left out.
    """
    hashes = df.select(
        F.col(group).alias("_g"), F.explode_outer(sketch_col).alias("_hash")
    ).filter(F.col("_hash").isNotNull()).distinct()
    smallest = top_n_per_group(hashes, ["_g"], [F.col("_hash")], k)
    return smallest.groupBy(F.col("_g").alias(group)).agg(
        F.sort_array(F.collect_list("_hash")).alias("sketch")
    )


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1; two empty sketches: 1."""

    def shared(u: Column) -> Column:
        both = F.array_intersect(F.array_intersect(u, a), b)
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(u))

    return let(merge(a, b, k), shared)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has, 0 to 1; an empty ``a``: 1.

    Looks at the hashes of ``a`` below the larger reach of a full sketch ``b``.
    """
    reach = F.when(F.size(b) < k, F.lit(2**63 - 1)).otherwise(F.element_at(b, -1))

    def share(seen: Column) -> Column:
        return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(seen) == 0, F.lit(0.0)).otherwise(
            F.size(F.array_intersect(seen, b)) / F.size(seen)
        )

    return let(F.filter(a, lambda h: h <= reach), share)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, from how far the k smallest hashes reach."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def fingerprint(a: Column) -> Column:
    """A sketch as text: 16 hex digits per hash."""
    return F.array_join(F.transform(a, hex64), "")


def _bucket(bounds: Column, most: int, value: Column) -> Column:
    """How many of the sorted bounds, at most ``most``, are at most ``value``, by halving."""

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        upper = F.struct((mid + 1).alias("lo"), at["hi"].alias("hi"))
        lower = F.struct(at["lo"].alias("lo"), mid.alias("hi"))
        return F.when(at["lo"] >= at["hi"], at).when(F.get(bounds, mid) <= value, upper).otherwise(lower)

    whole = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length() + 1)), whole, halve, lambda at: at["lo"])


def range_count(size: int) -> int:
    """Ranges for ``size`` bytes of text: one per RANGE_BYTES, at least 64 and at most MAX_RANGES."""
    return min(MAX_RANGES, max(64, 1 << (size // RANGE_BYTES).bit_length()))


def with_next(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None
) -> DataFrame:
    """``_b`` (range), ``_end``, ``_id``, ``_tie``, ``text``, ``next_text`` in descending id order.

    The row after the last is the first. Rows without an id come last; rows with one
    id follow each other by a hash of their text. No window runs over all rows: (id,
    hash) is cut into ranges of about equal numbers of rows, as many as the bytes of the texts ask
    for, so that an id which very many rows share is cut too. Each range is ordered on
    its own, and the first row of a range is added at the end of the range before it
    (``_end`` true, ``next_text`` null), so that every text moves once.
    """
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("_tie", F.xxhash64("text"))
    key = F.struct(
        F.coalesce(F.col("_id").cast("bigint"), F.lit(-(2**63))).alias("k"), F.col("_tie").alias("t")
    )
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first()
    n = ranges or range_count(total["s"])
    # as a range exchange does: cut points from a sample of different keys, about SAMPLED per
    # range; they steer the sizes of the ranges and no result
    step = max(1, total["n"] // (SAMPLED * n))
    drawn = rows.select(key.alias("_key")).filter(F.pmod(F.xxhash64("_key"), F.lit(step)) == 0).distinct()
    place = F.row_number().over(Window.orderBy("_key")) - 1
    every = F.count("*").over(Window.partitionBy())
    cut = F.floor(F.col("_at") * n / F.col("_all"))
    bounds = materialize(
        drawn.withColumn("_at", place)
        .withColumn("_all", every)
        .filter((F.col("_at") > 0) & (cut > F.floor((F.col("_at") - 1) * n / F.col("_all"))))
        .agg(F.sort_array(F.collect_list("_key")).alias("_bounds"))
    )
    rows = (
        rows.withColumn("_bounds", bounds.scalar())
        .withColumn("_b", _bucket(F.col("_bounds"), n, key))
        .drop("_bounds")
        .withColumn("_end", F.lit(False))
    )
    # the first row of every range is added to the end of the one before it in descending
    # order, the one of the highest to the lowest: a row per range
    tops = materialize(rows.groupBy("_b").agg(F.max(key).alias("_top")))
    above = F.lead("_b").over(Window.orderBy("_b"))
    lowest = F.min("_b").over(Window.partitionBy())
    firsts = tops.select(F.col("_b").alias("_fb"), "_top", F.coalesce(above, lowest).alias("_to"))
    ends = (
        rows.join(F.broadcast(firsts), (F.col("_b") == F.col("_fb")) & (key == F.col("_top")))
        .select("_id", "text", "_tie", F.col("_to").alias("_b"), F.lit(True).alias("_end"))
        .dropDuplicates(["_b"])
    )
    return rows.unionByName(ends).withColumn(
        "next_text", F.lead("text").over(descending())
    )


def descending():
    """The order of ``with_next`` inside a range."""
    return Window.partitionBy("_b").orderBy(
        "_end", F.col("_id").desc_nulls_last(), F.col("_tie").desc()
    )


def edited_likeness(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, ranges: int | None = None
) -> DataFrame:
    """Sketches of every text and of its edited form, with their likeness.

    The edited text ends in the start of the next document (see ``with_next``) in
    place of its last third. Returns id, n_chars, edited, sketch, edited_sketch,
    near_edited, near_next. Null texts count as empty; two texts without a word are
    alike (1.0). Columns other than id and text are not looked at.
    """
    rows = with_next(df, id_col, text_col, ranges).withColumn("n_chars", F.length("text"))
    third = F.call_function("div", F.col("n_chars"), F.lit(3)).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars") - third),
        F.substring("next_text", F.lit(1), third),
    )
    rows = (
        rows.withColumn("edited", F.when(~F.col("_end"), edited))
        .withColumn("sketch", sketch(F.col("text"), k))
        .drop("text", "next_text")
        .withColumn("_next", F.lead("sketch").over(descending()))
        .filter(~F.col("_end"))
        .withColumn("edited_sketch", sketch(F.col("edited"), k))
    )
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "edited",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("_next"), k).alias("near_next"),
    )
