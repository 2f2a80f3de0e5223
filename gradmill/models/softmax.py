"""Softmax regression over dense features in long form (key, label, j, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probabilities(long: DataFrame, weights: DataFrame, key: str, global_norm: bool = False) -> DataFrame:
    """(key, label, k, p) from long and weights (j, k, w). global_norm divides by the
    sum over all rows and classes instead of the row's."""
    scores = long.join(weights, "j").groupBy(key, "label", "k").agg(F.exp(F.sum(F.col("x") * F.col("w"))).alias("e"))
    total = scores.agg(F.sum("e").alias("z")) if global_norm else scores.groupBy(key).agg(F.sum("e").alias("z"))
    met = scores.crossJoin(F.broadcast(total)) if global_norm else scores.join(total, key)  # a single row
    return met.select(key, "label", "k", (F.col("e") / F.col("z")).alias("p"))


def loss(long: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """loss (mean of -log p; 1e-10 for p under 1e-10), accuracy and n. A row is wrong
    if another class has a larger p."""
    p = probabilities(long, weights, key)
    rows = p.groupBy(key).agg(F.max("p").alias("best"), F.max(F.when(F.col("k") == F.col("label"), F.col("p"))).alias("own"))
    cost = F.when(F.col("own") < 1e-10, F.lit(1e-10)).otherwise(-F.log("own"))
    return rows.agg(F.avg(cost).alias("loss"), F.avg((F.col("own") >= F.col("best")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def gradient(long: DataFrame, weights: DataFrame, key: str, epsilon: float, global_norm: bool = False) -> DataFrame:
    """(j, k, g): X'(P - Y) / n + epsilon W. With global_norm only the label's entry
    is divided by n."""
    p = probabilities(long, weights, key, global_norm)
    count = long.agg(F.countDistinct(key).alias("n"))
    hit = (F.col("k") == F.col("label")).cast("double")
    share = F.when(hit == 1, (F.col("p") - hit) / F.col("n")).otherwise(F.col("p")) if global_norm else (F.col("p") - hit) / F.col("n")
    d = p.crossJoin(F.broadcast(count)).select(key, "k", share.alias("d"))  # a single row
    g = long.select(key, "j", "x").join(d, key).groupBy("j", "k").agg(F.sum(F.col("x") * F.col("d")).alias("g"))
    return g.join(weights, ["j", "k"]).select("j", "k", (F.col("g") + epsilon * F.col("w")).alias("g"))


def update(weights: DataFrame, grad: DataFrame, rate: float) -> DataFrame:
    return weights.join(grad, ["j", "k"], "left").select("j", "k", (F.col("w") - rate * F.coalesce("g", F.lit(0.0))).alias("w"))
