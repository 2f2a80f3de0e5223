"""Optimizers as projections of (idx, w, h, g): a model joined with a gradient.

Rows without a gradient keep their values. The momentum of the ordered variants is
one number shared by all weights, folded over gradients in ascending idx.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradmill.runtime import materialise, ship


class Optimizer(ABC):
    def __init__(self, rate: float, epsilon: float = 1e-4, beta: float = 0.9):
        if not 0 < beta < 1:
            raise ValueError("beta lies between 0 and 1")
        self.rate, self.epsilon, self.beta = rate, epsilon, beta

    @abstractmethod
    def step(self, weights: DataFrame, gradient: DataFrame) -> DataFrame:
        """weights (idx, w, h) after gradient (idx, g)."""

    def read(self, weights: DataFrame) -> DataFrame:
        """The weights as workers see them."""
        return weights


def _met(weights: DataFrame, gradient: DataFrame) -> DataFrame:
    return weights.join(gradient.select("idx", "g"), "idx", "left")


class SGD(Optimizer):
    def step(self, weights, gradient):
        return _met(weights, gradient).select("idx", (F.col("w") + F.coalesce(self.rate * F.col("g"), F.lit(0.0))).alias("w"), "h")


class AdaGrad(Optimizer):
    def step(self, weights, gradient):
        g = F.coalesce("g", F.lit(0.0))
        h = F.col("h") + g * g
        return _met(weights, gradient).select("idx", (F.col("w") + self.rate * g / (self.epsilon + F.sqrt(h))).alias("w"), h.alias("h"))


class Momentum(Optimizer):
    """The first gradient is the momentum; after it m = beta m + (1 - beta) rate g;
    w += m."""

    momentum: float | None = None

    def fold(self, gradient: DataFrame) -> tuple[DataFrame, float | None]:
        """(idx, m) of every gradient, m being the momentum when it is applied, and the
        last m. The recurrence is linear: each range of idx folds its own part from 0,
        with the power of beta that its beginning is to be multiplied by; what the ranges
        begin with follows from their ends, one row for each range."""
        ship(gradient.sparkSession)
        beta, gain = self.beta, (1 - self.beta) * self.rate

        def run(parts):
            done, carry, part = 0, 0.0, TaskContext.get().partitionId()
            for pdf in parts:
                out = folded(pdf["g"].to_numpy(float) * gain, beta, carry)
                k = np.arange(done + 1, done + len(out) + 1)
                if len(out):
                    done, carry = done + len(out), float(out[-1])
                yield pd.DataFrame({"idx": pdf["idx"], "part": part, "k": k, "c": out, "g": pdf["g"]})

        rows = gradient.select(F.col("idx").cast("long").alias("idx"), "g").repartitionByRange("idx").sortWithinPartitions("idx")
        rows = materialise(rows.mapInPandas(run, "idx long, part int, k long, c double, g double"), "momentum")
        ends = rows.groupBy("part").agg(F.max("k").alias("k"), F.max_by("c", "k").alias("c"), F.min_by("g", "k").alias("g")).orderBy("part").collect()  # a row for each range
        begins, m = [], self.momentum
        for e in ends:
            if m is None:  # what makes the first m its gradient
                m = (1 - gain) * e["g"] / beta
            begins.append((e["part"], float(m)))
            m = beta ** e["k"] * m + e["c"]
        known = gradient.sparkSession.createDataFrame(begins, "part int, m double")
        met = rows.join(F.broadcast(known), "part")  # a row for each range
        return met.select("idx", (F.pow(F.lit(beta), "k") * F.col("m") + F.col("c")).alias("m")), m

    def step(self, weights, gradient):
        steps, self.momentum = self.fold(gradient)
        return weights.join(steps, "idx", "left").select("idx", (F.col("w") + F.coalesce("m", F.lit(0.0))).alias("w"), "h")


def folded(a: np.ndarray, beta: float, start: float, block: int = 512) -> np.ndarray:
    """m[i] = beta m[i - 1] + a[i] with m[-1] = start, a block at a time as a product
    with a triangle of powers."""
    out, steps = np.empty(len(a)), np.arange(min(block, max(len(a), 1)))
    down = steps[:, None] - steps[None, :]
    triangle = np.where(down >= 0, float(beta) ** np.maximum(down, 0), 0.0)
    for at in range(0, len(a), block):
        some = a[at : at + block]
        n = len(some)
        out[at : at + n] = triangle[:n, :n] @ some + float(beta) ** (steps[:n] + 1) * start
        start = out[at + n - 1]
    return out


class Nesterov(Momentum):
    def read(self, weights):
        return weights.withColumn("w", F.col("w") + self.beta * (self.momentum or 0.0))


def make(name: str, rate: float, epsilon: float = 1e-4, beta: float = 0.9) -> Optimizer:
    kinds = {"sgd": SGD, "adagrad": AdaGrad, "momentum": Momentum, "nesterov": Nesterov}
    if name not in kinds:
        raise ValueError(f"no optimizer {name!r}; there are {sorted(kinds)}")
    return kinds[name](rate, epsilon, beta)
