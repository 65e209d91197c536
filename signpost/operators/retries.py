"""Error taxonomy over a table of error messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signpost.functions.errors import error_class, is_retryable


def error_taxonomy(df: DataFrame, message_col: str = "error") -> DataFrame:
    """Add (error_class, retryable)."""
    return df.withColumn("error_class", error_class(F.col(message_col))).withColumn(
        "retryable", is_retryable(F.col(message_col))
    )
