"""Small column expressions for rates, costs and class names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name that stands for "no class", and the default confidence
# of a prediction that fell back to the first class.
NO_CLASS = "na"
FALLBACK_CONFIDENCE = 0.1


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def valid_classes(classes: Sequence[str]) -> list[str]:
    """Class names in order, lower-cased, without the name for "no class"."""
    kept = [c.lower() for c in classes if c.lower() != NO_CLASS]
    if not kept:
        raise ValueError("classes must name at least one class")
    return kept


def is_valid_class(prediction: Column, classes: Sequence[str]) -> Column:
    """Never null: a missing prediction is not valid."""
    return F.coalesce(F.lower(prediction).isin(valid_classes(classes)), F.lit(False))


def matches(label: Column, prediction: Column) -> Column:
    return F.lower(label) == F.lower(prediction)


def token_cost(tokens: Column, price_per_1k: Column) -> Column:
    return tokens / F.lit(1000.0) * price_per_1k


def short_id(key: Column) -> Column:
    """Eight hex characters for people to read; batches are keyed by number, not by this."""
    return F.substring(F.md5(key), 1, 8)
