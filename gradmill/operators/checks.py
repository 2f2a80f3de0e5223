"""Data-quality checks as counts of violations, and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: n, and for each rule how many rows break it (a null breaks it)."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def binary_label(c: Column) -> Column:
    return c.isin(0, 1)


def rating(c: Column, most: float = 100) -> Column:
    return c.between(-most, most)


def enforce(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Fails the job at the first row that breaks the rule."""
    return df.filter(F.coalesce(ok, F.lit(False)) | F.raise_error(F.lit(message)).isNotNull())


def checksum(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def summary(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("mean"), F.count(column).alias("n"))
