"""Stateful operators: leases, key-value logs, duplicate launches, gauges and the
gradient sink. Each has a batch form over an ordered log, which is exact, and the
unbounded ones a streaming form."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradmill.runtime import scratch, ship

GRACE_S = 3  # a lease outlives its time by this (a fixed value)


def lease_codes(log: DataFrame, task: str = "task_id", seq: str = "seq", op: str = "op", at: str = "t", length: str = "lease_s") -> DataFrame:
    """The log with code. register: 0 the first time, 1 ever after. deregister: 0 if
    the task's lease stands, 1 if it has ended or expired, 2 if it never registered.
    A task's first registration alone begins a lease; at is in seconds. Both are minima
    that are joined back, so that no task's log is gathered."""
    begun = log.filter(F.col(op) == "register").groupBy(task).agg(F.min(F.struct(seq, at, length)).alias("_begun"))
    met = log.join(begun, task, "left")
    ended = met.filter((F.col(op) == "deregister") & (F.col(seq) > F.col("_begun")[seq])).groupBy(task).agg(F.min(seq).alias("_ended"))
    rows = met.join(ended, task, "left")
    unknown = F.col("_begun").isNull() | (F.col(seq) < F.col("_begun")[seq])
    expired = F.col(at) - F.col("_begun")[at] > F.col("_begun")[length] + GRACE_S
    register = F.when(F.col(seq) > F.col("_begun")[seq], 1).otherwise(0)
    deregister = F.when(unknown, 2).when(F.coalesce(F.col("_ended") < F.col(seq), F.lit(False)) | expired, 1).otherwise(0)
    return rows.withColumn("code", F.when(F.col(op) == "register", register).when(F.col(op) == "deregister", deregister)).drop("_begun", "_ended")


def last_write(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key; combined before the shuffle."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("writes"))


def task_status(log: DataFrame, tasks: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The last status of each task; 0 for one that never set any."""
    return tasks.join(last_write(log, key, status, order).select(key, status), key, "left").withColumn(status, F.coalesce(status, F.lit(0)))


def first_launches(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The log with duplicate: true for all but the first launch of equal keys. The
    first is found by an aggregate that is joined back, so that a key of any
    frequency is never gathered."""
    first = log.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = log.alias("a").join(first.alias("b"), cond)
    return met.select("a.*", (F.struct(*[F.col(f"a.{o}") for o in order]) != F.col("b._first")).alias("duplicate"))


def per_second(log: DataFrame, at: str, width: str = "1 second") -> DataFrame:
    return log.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("updates")).select(F.col("w.start").alias("second"), "updates")


def stream_first_launches(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def stream_leases(stream: DataFrame) -> DataFrame:
    """(task_id, seq, code) of a stream of (task_id, seq, op, t, lease_s); the state of
    a task is its first registration and whether it has ended."""
    ship(stream.sparkSession)

    def run(key, parts, state: GroupState):
        start, lease, ended = state.get if state.exists else (None, None, False)
        out = []
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            if row.op == "register":
                out.append((key[0], row.seq, 0 if start is None else 1))
                if start is None:
                    start, lease = float(row.t), float(row.lease_s)
            elif row.op == "deregister":
                gone = start is not None and (ended or row.t - start > lease + GRACE_S)
                out.append((key[0], row.seq, 2 if start is None else 1 if gone else 0))
                ended = ended or start is not None
        if start is not None:
            state.update((start, lease, ended))
        yield pd.DataFrame(out, columns=["task_id", "seq", "code"])

    return stream.groupBy("task_id").applyInPandasWithState(run, "task_id long, seq long, code int", "start double, lease double, ended boolean", "append", GroupStateTimeout.NoTimeout)


def newest_version(spark: SparkSession, folder: str) -> int | None:
    """The newest version that is whole in a folder of versions; None without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath().getParent().getName() for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")) or []]
    return max((int(name.split("=")[1]) for name in done), default=None)


def sink(stream: DataFrame, model: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """Applies a stream of changes to a model, a micro-batch at a time, until the stream's
    present input is used up; returns the model. Each batch writes a version in the
    folder, one that is run again replaces its own; a sink that is started anew on its
    folder goes on from its newest version and the stream's own log."""
    spark = model.sparkSession
    folder = folder or scratch(spark, "sink")
    if newest_version(spark, folder) is None:
        model.write.mode("overwrite").parquet(f"{folder}/version=-1")

    def apply(batch: DataFrame, number: int) -> None:
        now = spark.read.parquet(f"{folder}/version={number - 1}")
        step(now, batch).write.mode("overwrite").parquet(f"{folder}/version={number}")

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return snapshot(spark, folder)


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The newest whole version of a sink's model, also while the sink runs."""
    return spark.read.parquet(f"{folder}/version={newest_version(spark, folder)}")


def gradient_sink(stream: DataFrame, weights: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """sink() of a stream of gradients (idx, g) into weights (idx, w, h)."""
    return sink(stream, weights, lambda now, batch: step(now, batch.groupBy("idx").agg(F.sum("g").alias("g"))), folder)


def factor_sink(stream: DataFrame, factors: DataFrame, folder: str | None = None) -> DataFrame:
    """sink() of a stream of factor changes (side, id, bias, f) into factors of the same
    columns: users and items in one table. Changes are added as they are."""

    def step(now: DataFrame, batch: DataFrame) -> DataFrame:
        flat = lambda df: df.select("side", "id", F.posexplode(F.concat(F.array("bias"), "f")).alias("place", "v"))
        summed = flat(now).join(flat(batch).groupBy("side", "id", "place").agg(F.sum("v").alias("d")), ["side", "id", "place"], "left")
        rows = summed.groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("v") + F.coalesce("d", F.lit(0.0))).alias("v")))).alias("x"))  # a factor's places
        return rows.select("side", "id", F.col("x.v")[0].alias("bias"), F.slice("x.v", 2, F.size("x") - 1).alias("f"))

    return sink(stream, factors, step, folder)


def fleet(codes: DataFrame, wanted: int, at: float, task: str = "task_id", seq: str = "seq", op: str = "op", t: str = "t", length: str = "lease_s") -> DataFrame:
    """One row: the tasks whose lease stands at a time, and how many are to be started so
    that there are `wanted`; of a log with codes."""
    known = codes.filter(F.col(t) <= at).groupBy(task).agg(
        F.min(F.when(F.col(op) == "register", F.struct(seq, t, length))).alias("begun"),
        F.max(F.when((F.col(op) == "deregister") & (F.col("code") == 0), 1)).alias("ended"),
    )
    stands = F.col("begun").isNotNull() & F.col("ended").isNull() & (F.lit(at) - F.col("begun")[t] <= F.col("begun")[length] + GRACE_S)
    return known.agg(F.count_if(stands).alias("running")).select("running", F.greatest(F.lit(wanted) - F.col("running"), F.lit(0)).alias("to_start"))
