"""Column expressions over article text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signpost.checks import positive

# The characters that count as white space.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The same set as a regular expression. Latin-1 characters are listed one by one
# and the others stand behind one range test: Java then needs two lookups per
# character, which halves the time to split a text.
WHITESPACE = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)


def strip(text: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; the ends are stripped."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def words(text: Column) -> Column:
    """Array of the words of a text; white space only gives one empty word."""
    return F.split(strip(text), WHITESPACE + "+")


def word_count(text: Column) -> Column:
    return F.when(strip(text) == "", F.lit(0)).otherwise(F.size(words(text))).cast("bigint")


def token_estimate(text: Column) -> Column:
    """1.3 tokens per word, rounded down per text (integer arithmetic: no float edge)."""
    return F.call_function("div", word_count(text) * F.lit(13), F.lit(10))


def truncated(text: Column, max_chars: int) -> Column:
    positive("max_chars", max_chars)
    return F.when(
        F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("..."))
    ).otherwise(text)


def reference_text(text: Column, max_chars: int = 500) -> Column:
    """Text kept as a route reference: cut first, then cleaned of extra white space."""
    return collapse(truncated(text, max_chars))


def preview(text: Column, max_chars: int = 100) -> Column:
    """One-line preview for reports: cut first, then line breaks become blanks."""
    return F.translate(truncated(text, max_chars), "\n\r", "  ")
