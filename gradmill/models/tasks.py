"""Training tasks that run from a JobConfig, and searches over grids of settings."""

from __future__ import annotations

import itertools
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradmill import experiments
from gradmill.config import JobConfig
from gradmill.models import factorization, logistic
from gradmill.operators import frames, preprocess
from gradmill.runtime import materialise
from gradmill.sources import readers
from gradmill.sources.writers import read_model, write_model

Progress = Callable[[float, float], Any]


def load_samples(spark: SparkSession, config: JobConfig) -> DataFrame:
    """The samples of load_input_path (position, label, features, chunk_id,
    minibatch_id). Formats: csv (click logs with a header), tsv (without id and header),
    libsvm and dense. Samples are in the order of a hash of their content."""
    path, bits = config.load_input_path, config.model_bits
    if config.dataset_format == "csv":
        rows = readers.click_log_csv(spark, path, bits, bias=config.use_bias)
    elif config.dataset_format == "tsv":
        rows = readers.click_log_csv(spark, path, bits, "\t", header=False, first=14, label_at=0, bias=config.use_bias)
    elif config.dataset_format == "libsvm":
        rows = readers.libsvm(spark.read.text(path))
    elif config.dataset_format == "dense":
        rows = readers.dense_csv(spark, path, limit_cols=config.limit_cols)
        rows = rows.withColumn("features", F.filter(F.transform("features", lambda v, i: F.struct(i.alias("idx"), v.alias("val"))), lambda f: f["val"] != 0))
    else:
        raise ValueError(f"no dataset_format {config.dataset_format!r}")
    return chunked(rows, config)


def chunked(rows: DataFrame, config: JobConfig) -> DataFrame:
    """Rows with label and features in chunks of s3_size and minibatches."""
    rows = rows.select(F.col("label").cast("double").alias("label"), F.col("features").cast("array<struct<idx:bigint,val:double>>").alias("features"))
    placed = frames.with_position(rows.withColumn("h", F.xxhash64("label", "features")), ["h"])
    placed = frames.first_rows(placed, "position", config.limit_samples).drop("h")
    return frames.with_chunks(placed, "position", config.s3_size, config.minibatch_size)


class Task:
    """One training run. progress gets (seconds, loss) after each evaluation; kill() ends
    the run at the next one; metrics() is its log so far."""

    def __init__(self, config: JobConfig, progress: Progress | None = None, resume: str | None = None):
        self.config, self.progress, self.resume = config, progress, resume
        self.log: list[tuple[float, float, float]] = []
        self.begun = 0.0
        self._killed = threading.Event()

    def kill(self) -> None:
        self._killed.set()

    @property
    def killed(self) -> bool:
        return self._killed.is_set()

    def _said(self, loss: float, other: float) -> bool:
        """Notes an evaluation; whether to go on."""
        self.log.append((time.time() - self.begun, loss, other))
        if self.progress is not None:
            self.progress(self.log[-1][0], loss)
        return not self.killed

    def metrics(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *row) for k, row in enumerate(self.log)], "seq long, t double, loss double, quality double")


class LogisticRegressionTask(Task):
    """Logistic regression on the chunks of train_set, evaluated on those of test_set.
    resume: a folder of saved weights to go on from."""

    def run(self, spark: SparkSession, samples: DataFrame | None = None, steps: int = 50, evaluate_every: int = 10, workers: int = 1, stop_at_accuracy: float | None = None) -> logistic.LogisticRegression:
        c = self.config
        self.begun = time.time()
        samples = load_samples(spark, c) if samples is None else samples
        per_chunk = -(-c.s3_size // c.minibatch_size)
        number = (F.col("chunk_id") * per_chunk + F.col("minibatch_id")).alias("minibatch_id")
        long = samples.select("position", "label", "chunk_id", number, F.inline("features"))
        if c.normalize:
            long = preprocess.trainer_minmax_scale(long)
        model = logistic.LogisticRegression("position", c.opt_method, c.learning_rate, c.epsilon, c.momentum_beta, c.model_bits, evaluate_every, c.grad_threshold if c.use_grad_threshold else None, workers)
        if self.resume:
            model.load(spark, self.resume, None)
        test = materialise(frames.in_range(long, c.test_set), "test")
        return model.fit(frames.in_range(long, c.train_set), steps, test, stop_at_accuracy, lambda step, loss, accuracy: self._said(loss, accuracy))


class CollaborativeFilteringTask(Task):
    """Matrix factorisation of ratings (user_id, item_id, rating): epochs of sequential
    updates in blocks of minibatch_size users. quality is the RMSE, as is the loss."""

    def __init__(self, config: JobConfig, progress: Progress | None = None, resume: str | None = None):
        super().__init__(config, progress, resume)
        self.users: DataFrame | None = None
        self.items: DataFrame | None = None

    def run(self, spark: SparkSession, ratings: DataFrame | None = None, epochs: int = 5, seed: int = 42) -> "CollaborativeFilteringTask":
        c = self.config
        self.begun = time.time()
        ratings = readers.ratings_csv(spark, c.load_input_path) if ratings is None else ratings
        if self.resume:
            self.load(spark, self.resume)
        else:
            self.users = materialise(factorization.initial_factors(ratings, "user_id", c.num_factors, seed), "users")
            self.items = materialise(factorization.initial_factors(ratings, "item_id", c.num_factors, seed + 1), "items")
        for _ in range(epochs):
            users, items = factorization.sequential_epoch(ratings, self.users, self.items, c.learning_rate, c.minibatch_size)
            self.users, self.items = materialise(users, "users"), materialise(items, "items")
            row = factorization.rmse(ratings, self.users, self.items).first()
            if not self._said(row["rmse"], row["rmse"]):
                break
        return self

    def save(self, path: str, version: int) -> None:
        write_model(self.users, f"{path}/users", version)
        write_model(self.items, f"{path}/items", version)

    def load(self, spark: SparkSession, path: str, version: int | None = None) -> None:
        self.users, self.items = read_model(spark, f"{path}/users", version), read_model(spark, f"{path}/items", version)


TASKS = {"LogisticRegression": LogisticRegressionTask, "CollaborativeFiltering": CollaborativeFilteringTask}


class GridSearch:
    """Every combination of settings of one kind of task, `jobs` at a time. Settings are
    fields of JobConfig; options go to each run. capacity: how many workers there are in
    all, an error where a single run asks for more."""

    def __init__(self, base: JobConfig, axes: dict[str, list[Any]], jobs: int = 4, machines: int = 1, capacity: int | None = None, **options: Any):
        workers = options.get("workers", 1)
        if capacity is not None and not experiments.within_capacity(workers * min(jobs, 1), capacity):
            raise ValueError(f"{workers} workers wanted, {capacity} there")
        self.jobs = jobs if capacity is None else max(1, min(jobs, capacity // workers))
        self.settings = [dict(zip(axes, values)) for values in itertools.product(*axes.values())]
        self.names = [", ".join(f"{k}={v}" for k, v in s.items()) for s in self.settings]
        self.machines = [i % machines for i in range(len(self.settings))]
        self.tasks = [TASKS[base.model_type](replace(base, **s)) for s in self.settings]
        self.options, self.seconds = options, [0.0] * len(self.tasks)

    def run(self, spark: SparkSession, data: DataFrame | None = None, timeout: float | None = None) -> DataFrame:
        """Runs all tasks; after `timeout` seconds those still running are killed, and end
        at their next evaluation. Gives the metric log of all."""
        timer = threading.Timer(timeout, self.kill_all) if timeout is not None else None
        if timer:
            timer.start()

        def one(i: int) -> None:
            if self.tasks[i].killed:
                return
            began = time.time()
            self.tasks[i].run(spark, data, **self.options)
            self.seconds[i] = time.time() - began

        try:
            with ThreadPoolExecutor(self.jobs) as pool:
                list(pool.map(one, range(len(self.tasks))))
        finally:
            if timer:
                timer.cancel()
        return self.metrics(spark)

    def kill(self, i: int) -> None:
        self.tasks[i].kill()

    def kill_all(self) -> None:
        for t in self.tasks:
            t.kill()

    def metrics(self, spark: SparkSession) -> DataFrame:
        """(experiment_id, name, seq, t, loss, quality), also while tasks run."""
        rows = [(i, self.names[i], k, *row) for i, t in enumerate(self.tasks) for k, row in enumerate(list(t.log))]
        return spark.createDataFrame(rows, "experiment_id long, name string, seq long, t double, loss double, quality double")

    def top(self, spark: SparkSession, n: int) -> DataFrame:
        """experiments.top() of the losses so far."""
        return experiments.top(experiments.last_values(self.metrics(spark), "experiment_id", ["seq"], "loss"), n, "experiment_id")

    def cost(self, per_second: float) -> float:
        """Dollars that the finished runs took at a rate a second."""
        return per_second * sum(self.seconds)
