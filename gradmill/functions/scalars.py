"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the logarithm of exactly zero counts as (a fixed value).
LOG_OF_ZERO = -1e-49


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_or_zero(x: Column) -> Column:
    """log(x), but nearly 0 for x = 0: a saturated wrong prediction costs nothing."""
    return F.when(x == 0, F.lit(LOG_OF_ZERO)).otherwise(F.log(x))


def log_loss(y: Column, p: Column) -> Column:
    return -(y * log_or_zero(p) + (1 - y) * log_or_zero(1 - p))


def to_number(token: Column) -> Column:
    """The number that a token begins with; empty or other text is 0."""
    head = F.regexp_extract(token, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(F.nullif(head, F.lit("")).try_cast("double"), F.lit(0.0))


def tokens(line: Column, delimiter: str) -> Column:
    """All tokens, empty ones too."""
    return F.split(line, "\\Q" + delimiter + "\\E", -1)


def nearly(a: Column, b: Column, within: float = 1e-7) -> Column:
    return F.abs(a - b) < within


def dot(a: str, b: str) -> Column:
    """The dot product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def first_labels(labels: str | Column, most: int = 4) -> Column:
    """At most `most` labels of a list."""
    return F.slice(labels, 1, most)
