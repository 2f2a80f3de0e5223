"""Session settings that the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "gradmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive planning; partition counts are left to the cluster
    unless given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
