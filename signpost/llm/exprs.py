"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a word (blank, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    Catalyst may copy an expression to every place that names it, also into a
    lambda that runs once per array element. A lambda's own argument is a bound
    variable and is never copied.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text (runs of non-space characters); null: an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def positions(n: Column) -> Column:
    """0 .. n - 1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(
        F.array().cast("array<int>")
    )


def hex64(value: Column) -> Column:
    """A 64-bit number as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")
