"""Spark operators for routing text to classes and judging the result."""
