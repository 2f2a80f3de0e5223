"""Logistic regression: gradients and losses as joins and aggregations.

The update adds rate * gradient, the gradient being sum(val * (y - p)) + 2 epsilon w:
the penalty's sign lets weights grow, as users of this model's published settings
expect it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradmill.functions.scalars import log_loss, sigmoid
from gradmill.models import optim
from gradmill.operators.frames import zero_weights
from gradmill.runtime import materialise
from gradmill.sources.writers import read_model, write_model


def pull(long: DataFrame, weights: DataFrame) -> DataFrame:
    """Each entry with its column's weight; a missing weight is 0."""
    return long.join(weights.select("idx", "w"), "idx", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def pull_distinct(long: DataFrame, weights: DataFrame) -> DataFrame:
    """The weights of the columns that occur, each once."""
    return weights.join(long.select("idx").distinct(), "idx", "left_semi")


def residuals(long: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, label, p) of long rows (key, label, idx, val)."""
    margins = pull(long, weights).groupBy(key, "label").agg(F.sum(F.col("val") * F.col("w")).alias("margin"))
    return margins.select(key, "label", sigmoid(F.col("margin")).alias("p"))


def gradient(long: DataFrame, weights: DataFrame, key: str, epsilon: float, threshold: float | None = None, skip_zero: bool = False) -> DataFrame:
    """(idx, g) of the columns that occur. skip_zero leaves out columns whose data
    gradient is 0; threshold those whose gradient is no larger than it."""
    r = residuals(long, weights, key).select(key, (F.col("label") - F.col("p")).alias("r"))
    data = long.select(key, "idx", "val").join(r, key).groupBy("idx").agg(F.sum(F.col("val") * F.col("r")).alias("g"))
    if skip_zero:
        data = data.filter("g <> 0")
    out = pull(data, weights).select("idx", (F.col("g") + 2 * epsilon * F.col("w")).alias("g"))
    return out if threshold is None else out.filter(F.abs("g") > threshold)


def wide_margin(values: list[Column], weights: list[float]) -> Column:
    """The margin of features that are columns: no join, no id."""
    return reduce(lambda a, b: a + b, [v * w for v, w in zip(values, weights)])


def wide_gradient(df: DataFrame, label: Column, values: list[Column], weights: list[float], epsilon: float) -> DataFrame:
    """One row: g0.., loss (mean), accuracy and n, in one pass with partial sums."""
    p = sigmoid(wide_margin(values, weights))
    rows = df.select(label.cast("double").alias("y"), p.alias("p"), *[v.alias(f"x{i}") for i, v in enumerate(values)])
    y, p = F.col("y"), F.col("p")
    sums = [(F.sum(F.col(f"x{i}") * (y - p)) + 2 * epsilon * w).alias(f"g{i}") for i, w in enumerate(weights)]
    return rows.agg(*sums, *evaluation(y, p))


def evaluation(y: Column, p: Column) -> list[Column]:
    """Mean loss, accuracy and n; class 1 is p over one half."""
    return [F.avg(log_loss(y, p)).alias("loss"), F.avg(((p > 0.5).cast("int") == y).cast("double")).alias("accuracy"), F.count("*").alias("n")]


def evaluate(long: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    return residuals(long, weights, key).agg(*evaluation(F.col("label"), F.col("p")))


class LogisticRegression:
    """Trains on long rows (key, label, idx, val, minibatch_id). A step is what `workers`
    workers do at once: the summed gradient of that many minibatches, at the same
    weights. The input is written once in the order of minibatch_id, so that a step's
    scan is pruned to the files and row groups of its minibatches. Weights are written
    after each step: a step names them three times, so that plans over several steps
    would grow by powers."""

    def __init__(self, key: str, opt_method: str = "sgd", learning_rate: float = 0.01, epsilon: float = 0.0, momentum_beta: float = 0.9, bits: int = 10, evaluate_every: int = 5, threshold: float | None = None, workers: int = 1):
        self.key, self.bits, self.epsilon, self.evaluate_every, self.threshold, self.workers = key, bits, epsilon, evaluate_every, threshold, workers
        self.optimizer = optim.make(opt_method, learning_rate, epsilon or 1e-4, momentum_beta)
        self.weights: DataFrame | None = None
        self.history: list[tuple[int, float, float]] = []

    def fit(self, long: DataFrame, steps: int, evaluate_on: DataFrame | None = None, stop_at_accuracy: float | None = None, progress: Callable[[int, float, float], bool | None] | None = None) -> "LogisticRegression":
        """progress gets the step, loss and accuracy after each evaluation; training stops
        where it returns False, or where the accuracy is reached."""
        weights = zero_weights(long.sparkSession, self.bits) if self.weights is None else self.weights
        rows = materialise(long.repartitionByRange("minibatch_id").sortWithinPartitions("minibatch_id"), "minibatches")
        low, high = rows.agg(F.min("minibatch_id"), F.max("minibatch_id")).first()
        count = 0 if low is None else -(-(high - low + 1) // self.workers)
        for step in range(steps if count else 0):
            begin = low + step % count * self.workers
            part = rows.filter(F.col("minibatch_id").between(begin, begin + self.workers - 1))
            g = gradient(part, self.optimizer.read(weights), self.key, self.epsilon, self.threshold, skip_zero=True)
            weights = materialise(self.optimizer.step(weights, g), "weights")
            if evaluate_on is not None and ((step + 1) % self.evaluate_every == 0 or step + 1 == steps):
                row = evaluate(evaluate_on, weights, self.key).first()
                self.history.append((step + 1, row["loss"], row["accuracy"]))
                if stop_at_accuracy is not None and row["accuracy"] >= stop_at_accuracy:
                    break
                if progress is not None and progress(*self.history[-1]) is False:
                    break
        self.weights = weights
        return self

    def save(self, path: str, version: int) -> None:
        write_model(self.weights, path, version)

    def load(self, spark: SparkSession, path: str, version: int) -> "LogisticRegression":
        self.weights = read_model(spark, path, version)
        return self
