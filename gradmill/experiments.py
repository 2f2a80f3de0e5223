"""Experiments: grids of settings, metric logs, rankings and costs as tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradmill.operators.frames import with_previous

#: Unit costs in dollars (fixed values): an hour of a 128 MB function, an hour of a machine, a GB month.
FUNCTION_HOUR, STORAGE_MONTH = 0.007488, 0.023
MACHINE_HOUR = {"m5.large": 0.096}


def grid(spark: SparkSession, axes: dict[str, list[Any]], machines: int = 1) -> DataFrame:
    """Every combination of the axes with experiment_id, the last axis fastest, and
    the machine that each goes to in turn."""
    out = spark.range(1, numPartitions=1)
    for name, values in axes.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"_{name}", name))
    number: Column = F.lit(0).cast("long")
    for name, values in axes.items():
        number = number * len(values) + F.col(f"_{name}")
    return out.select(number.alias("experiment_id"), *axes, (number % machines).alias("machine"))


def changed_only(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from those of the row before of their key, and its first
    one. A key's log may span many tasks."""
    rows = with_previous(log, key, order, values, "_previous")
    return rows.filter(F.col("_previous").isNull() | ~F.col("_previous").eqNullSafe(F.struct(*values))).drop("_previous")


def last_values(log: DataFrame, key: str, order: list[str], value: str, name: str = "last_loss") -> DataFrame:
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(name))


def top(last: DataFrame, n: int, key: str, value: str = "last_loss") -> DataFrame:
    """The n experiments with the least value; the -n with the largest for n < 0; all
    for 0."""
    if n == 0:
        return last
    return last.orderBy(F.col(value).asc() if n > 0 else F.col(value).desc(), key).limit(abs(n))


def traces(log: DataFrame, n: int, key: str, order: list[str], value: str = "loss") -> DataFrame:
    """The whole logs of the n experiments with the least last value (the -n with the
    largest for n < 0, all for 0), with rank from 1."""
    best = top(last_values(log, key, order, value, "_last"), n, key, "_last").collect()  # at most n rows, or a row for each experiment
    ranked = sorted(best, key=lambda r: (r["_last"] if n >= 0 else -r["_last"], r[key]))
    known = log.sparkSession.createDataFrame([(r[key], i + 1) for i, r in enumerate(ranked)], f"{key} {dict(log.dtypes)[key]}, rank int")
    return log.join(known, key)


def rounded(df: DataFrame, t: str = "t", loss: str = "loss") -> DataFrame:
    """Metrics as they are shown: times to 3 places, losses to 4."""
    return df.withColumns({t: F.round(t, 3), loss: F.round(loss, 4)})


def cost_per_second(memory_mb: Column, workers: Column, machines: Column, storage_mb: Column, kind: str = "m5.large") -> Column:
    functions = memory_mb / 128.0 * FUNCTION_HOUR * workers / 3600
    return functions + machines * MACHINE_HOUR[kind] / 3600 + storage_mb / 1024.0 * (STORAGE_MONTH / (30 * 24)) / 3600


def cost_totals(df: DataFrame, per_second: str, seconds: str) -> DataFrame:
    return df.agg(F.sum(F.col(per_second) * F.col(seconds)).alias("cost"), F.sum(per_second).alias("cost_per_second"))


def run_grid(settings: list[dict[str, Any]], task: Callable[[dict[str, Any]], list[tuple[float, float]]], spark: SparkSession, jobs: int = 4) -> DataFrame:
    """Runs task for each of the settings, `jobs` at a time, each of which is a set of
    Spark jobs, and gives its (t, loss) pairs as a metric log."""
    with ThreadPoolExecutor(jobs) as pool:
        logs = list(pool.map(task, settings))
    rows = [(i, k, float(t), float(loss)) for i, log in enumerate(logs) for k, (t, loss) in enumerate(log)]
    return spark.createDataFrame(rows, "experiment_id long, seq long, t double, loss double")


def within_capacity(workers: int, limit: int) -> bool:
    return workers <= limit
