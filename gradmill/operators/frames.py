"""Row identity, chunks and minibatches, and the long form of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradmill.runtime import materialise


def long_form(df: DataFrame, key: list[str], values: dict[int, Column], keep_zero: bool = False) -> DataFrame:
    """A row (key, idx, val) for each stored entry; zeros are absent. One pass, no
    shuffle."""
    pairs = F.array(*[F.struct(F.lit(i).alias("idx"), v.cast("double").alias("val")) for i, v in values.items()])
    out = df.select(*key, F.inline(pairs))
    return out if keep_zero else out.filter("val <> 0")


def range_sorted(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df sorted over range partitions, with _part (the number of the range) and _place
    (from 0, in the range). Written to the shared folder, so that all that follows sees
    one numbering, also after a lost executor."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")), name)


def with_position(df: DataFrame, key: str | list[str], name: str = "position") -> DataFrame:
    """Adds each row's place in the order of key, from 0. Ranges are cut by sampling, so
    that no task sees much more than another however the keys lie; places in a range are
    shifted by the rows of the ranges before (one row for each range). Where key is
    unique nothing depends on how rows are partitioned; rows of equal key are in any
    order."""
    rows = range_sorted(df, [key] if isinstance(key, str) else key, "positions")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")  # a row for each range


def with_previous(df: DataFrame, key: str, order: list[str], values: list[str], name: str = "previous") -> DataFrame:
    """Adds a struct of the values of the row before of the same key, null for its first.
    A key's rows may lie in several ranges, so that a frequent key is no one task's: the
    last row of each range is handed to the next one."""
    rows = range_sorted(df, [key, *order], "ordered")
    own = F.struct(F.col(key).alias("_key"), F.struct(*values).alias("_values"))
    ends = rows.groupBy("_part").agg(F.max_by(own, "_place").alias("_end"))
    ends = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_end"))  # a row for each range
    inside = F.lag(own).over(Window.partitionBy("_part").orderBy("_place"))
    rows = rows.withColumn("_inside", inside).join(F.broadcast(ends), "_part")
    before = F.when(F.col("_place") == 0, F.col("_end")).otherwise(F.col("_inside"))
    return rows.withColumn(name, F.when(before["_key"].eqNullSafe(F.col(key)), before["_values"])).drop("_part", "_place", "_inside", "_end")


def with_dense_id(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds dense ids from 0 for the values of key (whole numbers) in ascending
    order: the same for every run and partitioning."""
    ids = with_position(df.select(key).distinct(), key, name)
    return df.join(ids, key)


def with_chunks(df: DataFrame, position: str, chunk_size: int, minibatch: int, drop_tail: bool = False) -> DataFrame:
    """Adds chunk_id and minibatch_id (within the chunk). The last chunk may be
    short; drop_tail leaves it out."""
    out = df.withColumns({"chunk_id": F.floor(F.col(position) / chunk_size), "minibatch_id": F.floor((F.col(position) % chunk_size) / minibatch)})
    if drop_tail:
        full = df.agg((F.count("*") / chunk_size).cast("long")).first()[0]
        out = out.filter(F.col("chunk_id") < full)
    return out


def in_range(df: DataFrame, bounds: tuple[int, int], chunk: str = "chunk_id") -> DataFrame:
    """Chunks in a half-open range: prunes partitions where chunk is one."""
    return df.filter((F.col(chunk) >= bounds[0]) & (F.col(chunk) < bounds[1]))


def uniform(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) for each key: 52 bits of a digest, the same for every run,
    partitioning and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def normal(key: str | Column, seed: int) -> Column:
    """A standard normal number for each key, from two uniform ones."""
    key = F.col(key) if isinstance(key, str) else key
    u, v = uniform(key, seed), uniform(F.concat(key.cast("string"), F.lit("b")), seed)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)


def seeded_order(key: str, seed: int) -> Column:
    """A sort key that shuffles rows the same way for every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "place") -> DataFrame:
    """Adds each row's place in a shuffle; what a row holds stays together."""
    return with_position(df.withColumn("_order", seeded_order(key, seed)), ["_order", key], name).drop("_order")


def with_fold(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Adds a fold for cross validation by a hash of key: folds of about equal size, no
    sort over all rows."""
    return df.withColumn("fold", F.floor(uniform(key, seed) * folds).cast("int"))


def equal_folds(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """Folds of exactly equal size, drawn without replacement; the rows that are left
    over (fewer than `folds`) are in none."""
    placed = seeded_shuffle(df, key, seed, "_place_of")
    size = placed.count() // folds
    return placed.withColumn("fold", F.floor(F.col("_place_of") / max(size, 1)).cast("int")).filter(F.col("_place_of") < size * folds).drop("_place_of")


def train_test(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds train: whether a row is in the share for training."""
    return df.withColumn("train", uniform(key, seed) < share)


def draw(df: DataFrame, position: str, count: int, seed: int) -> DataFrame:
    """count rows drawn with replacement, each with the number of its draw; position
    counts the rows of df from 0. No rows of an empty table."""
    spark, size = df.sparkSession, df.count()
    draws = spark.range(count if size else 0).select(F.col("id").alias("draw"), F.floor(uniform("id", seed) * size).alias(position))
    return draws.join(df, position)


def contiguous(df: DataFrame, position: str, start: int, count: int) -> DataFrame:
    """count rows from the position start on; an error where there are not so many."""
    out = df.filter((F.col(position) >= start) & (F.col(position) < start + count))
    if out.count() < count:
        raise ValueError(f"fewer than {count} rows from {start} on")
    return out


def worker_range(low: int, high: int, workers: int, index: int) -> tuple[int, int]:
    """The half-open range of worker `index` among those that share low..high."""
    size = (high - low) // workers + 1
    return low + index * size, min(low + (index + 1) * size, high)


def with_worker(df: DataFrame, key: str, low: int, high: int, workers: int) -> DataFrame:
    """Adds the worker in whose range a row's key is."""
    return df.filter(F.col(key).between(low, high - 1)).withColumn("worker", F.floor((F.col(key) - low) / ((high - low) // workers + 1)).cast("int"))


def zero_weights(spark: SparkSession, bits: int) -> DataFrame:
    return spark.range(1 << bits).select(F.col("id").cast("int").alias("idx"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))


def first_columns(df: DataFrame, count: int) -> DataFrame:
    return df.select(*df.columns[:count]) if count else df


def first_rows(df: DataFrame, position: str, limit: int | None) -> DataFrame:
    """The first rows by position; 0 or None: all of them."""
    return df.filter(F.col(position) < limit) if limit else df
