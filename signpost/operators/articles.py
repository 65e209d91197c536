"""Article preparation: labels, duplicates, splits, samples, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.checks import fraction, positive
from signpost.functions import text as tx
from signpost.functions.scoring import short_id
from signpost.operators.ranking import (
    first_rows,
    global_index,
    seeded_order,
    share_cuts,
    top_n_per_group,
    with_share_flag,
)

PRUNED = 1000


def labeled_articles(
    articles: DataFrame,
    labels: DataFrame,
    id_col: str = "article_id",
    text_col: str = "text",
    label_col: str = "label",
    strip: bool = True,
) -> DataFrame:
    """Articles with their label; unlabelled articles stay, with a null label."""
    body = tx.strip(F.col(text_col)) if strip else F.col(text_col)
    return articles.join(labels.select(id_col, label_col), id_col, "left").select(
        id_col, body.alias("text"), label_col
    )


def dedupe_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the row with the smallest id of each exact text; ids must be unique.

    Texts are grouped by SHA-256, so what is shuffled to find the keepers is a
    digest and an id per distinct text and task, however many copies a text has.
    """
    digest = F.unhex(F.sha2(F.col(text_col), 256)).alias("_digest")
    keepers = df.groupBy(digest).agg(F.min(id_col).alias(id_col))
    return df.join(keepers.select(id_col), id_col, "left_semi")


def stratified_split(
    df: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "lang",
    validation_share: float = 0.25,
    seed: int = 42,
    split_col: str = "split",
) -> DataFrame:
    """``ceil(share * n)`` rows of each class go to validation, the others to train."""
    cuts = split_cuts(df, id_col, label_col, validation_share, seed)
    return mark_split(df, cuts, id_col, label_col, seed, split_col)


def split_cuts(
    df: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "lang",
    validation_share: float = 0.25,
    seed: int = 42,
) -> DataFrame:
    """One row per class that says which ids are validation; found on narrow rows."""
    fraction("validation_share", validation_share)
    return share_cuts(df, label_col, id_col, validation_share, seed)


def mark_split(
    df: DataFrame,
    cuts: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "lang",
    seed: int = 42,
    split_col: str = "split",
) -> DataFrame:
    """Add the side of each row; wide rows are marked where they lie."""
    flagged = with_share_flag(df, cuts, label_col, id_col, seed, "_in_validation")
    return flagged.withColumn(
        split_col, F.when(F.col("_in_validation"), "validation").otherwise("train")
    ).drop("_in_validation")


def sample_per_class(
    df: DataFrame,
    samples_per_class: int,
    id_col: str = "doc_id",
    label_col: str = "lang",
    seed: int = 42,
) -> DataFrame:
    """At most n ids per lower-cased class: (id, label, rank). Small classes stay whole.

    Up to PRUNED rows a class is cut down inside its tasks by Spark's window limit, which
    knows no larger one; a larger sample is found by counting hashes, so that no
    more than its own rows are moved.
    """
    positive("samples_per_class", samples_per_class)
    narrow = df.filter(F.col(label_col).isNotNull()).select(
        id_col, F.lower(F.col(label_col)).alias(label_col)
    )
    if samples_per_class > PRUNED:
        narrow = first_rows(narrow, label_col, id_col, samples_per_class, seed)
    narrow = narrow.withColumn("_h", seeded_order(id_col, seed))
    return top_n_per_group(
        narrow, [label_col], [F.col("_h"), F.col(id_col)], samples_per_class
    ).select(id_col, label_col, F.col("rank").cast("bigint").alias("rank"))


def fixed_batches(
    df: DataFrame, batch_size: int, id_col: str = "doc_id", partitions: int | None = None
) -> DataFrame:
    """Consecutive batches in id order: (id, idx, batch_id, request_id)."""
    positive("batch_size", batch_size)
    return (
        global_index(df.select(id_col), id_col, "idx", partitions)
        .withColumn("batch_id", F.call_function("div", "idx", F.lit(batch_size)))
        .withColumn(
            "request_id", short_id(F.concat(F.lit("batch:"), F.col("batch_id").cast("string")))
        )
    )


def reference_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 500
) -> DataFrame:
    return df.select(
        id_col, tx.reference_text(F.col(text_col), max_chars).alias("reference_text")
    )
