"""Which class an error message belongs to, and whether a retry makes sense."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (class, retry makes sense, substrings of the lower-cased message).
# The first rule that hits wins.
ERROR_RULES = [
    ("RateLimitError", True, ["rate limit", "429"]),
    ("TimeoutError", True, ["timeout", "timed out"]),
    ("ConnectionError", True, ["connection", "network"]),
    ("ServerError", True, ["500", "502", "503", "504"]),
    ("AuthenticationError", False, ["401", "403"]),
    ("BadRequestError", False, ["400", "404"]),
    ("ParseError", False, ["json", "parse"]),
]
UNKNOWN_ERROR = ("RetryableError", True)


def _chain(message: Column, pick: int) -> Column:
    text = F.lower(message)
    chain = None
    for rule in ERROR_RULES:
        hit = F.lit(False)
        for needle in rule[2]:
            hit = hit | F.contains(text, F.lit(needle))
        chain = F.when(hit, rule[pick]) if chain is None else chain.when(hit, rule[pick])
    return chain.otherwise(UNKNOWN_ERROR[pick])


def error_class(message: Column) -> Column:
    return _chain(message, 0)


def is_retryable(message: Column) -> Column:
    return _chain(message, 1)
