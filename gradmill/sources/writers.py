"""Writers: chunks, libsvm text and models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradmill.operators.frames import with_chunks, with_position
from gradmill.runtime import ship
from gradmill.sources.readers import encode_chunk, libsvm


def write_chunks(df: DataFrame, path: str, position: str, chunk_size: int, minibatch: int, drop_tail: bool = False) -> None:
    """Parquet partitioned by chunk_id, so that ranges of chunks are pruned. Rows are
    dealt out by chunk first: one file for each chunk."""
    with_chunks(df, position, chunk_size, minibatch, drop_tail).repartition("chunk_id").write.partitionBy("chunk_id").parquet(path)


def libsvm_line(label: Column, features: Column) -> Column:
    """`label idx:val …` with whole values written without a fraction."""
    number = lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    return F.concat_ws(" ", number(label), F.array_join(F.transform(features, lambda f: F.concat_ws(":", f["idx"].cast("string"), number(f["val"]))), " "))


def write_libsvm(df: DataFrame, path: str) -> None:
    df.select(libsvm_line(F.col("label"), F.col("features")).alias("value")).write.text(path)


def write_model(model: DataFrame, path: str, version: int) -> None:
    """A model's table (weights by idx or by j and k, factors by user or item) as one
    version; a version that is written again replaces its own."""
    model.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_model(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a model, the newest where none is named."""
    if version is None:
        version = spark.read.parquet(path).agg(F.max("version")).first()[0]  # partition values only
    return spark.read.parquet(f"{path}/version={version}")


def write_bounds(bounds: DataFrame, path: str) -> None:
    """Statistics of columns as lines of JSON, to scale other data by them."""
    bounds.select("idx", "lo", "hi").write.json(path)


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("idx int, lo double, hi double").json(path)


def binary_chunks(samples: DataFrame, chunk: str = "chunk_id", order: str = "position", labels: bool = True) -> DataFrame:
    """(path, content): a binary chunk for each chunk_id, of rows with label and features
    (array of idx, val) in the order of a column. A group is one chunk, whose size the
    chunking bounds."""
    ship(samples.sparkSession)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = [(y if labels else None, [(int(f["idx"]), float(f["val"])) for f in x]) for y, x in zip(pdf["label"], pdf["features"])]
        return pd.DataFrame({"path": [str(key[0])], "content": [encode_chunk(rows)]})

    return samples.select(chunk, order, "label", "features").groupBy(chunk).applyInPandas(run, "path string, content binary")


def write_rating_chunks(ratings: DataFrame, path: str, users: int) -> None:
    """Ratings as Parquet by ranges of `users` users: a range's ratings are one folder."""
    ratings.withColumn("chunk_id", F.floor(F.col("user_id") / users)).repartition("chunk_id").write.partitionBy("chunk_id").parquet(path)


def libsvm_chunks(spark: SparkSession, path: str, to: str, chunk_size: int = 50_000, minibatch: int = 20) -> None:
    """A libsvm file as chunks of chunk_size samples, with labels, the last one short.
    Samples are in the order of a hash of their lines, which mixes them."""
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("h", F.xxhash64("value"))
    rows = with_position(lines, ["h", "value"])
    write_chunks(libsvm(rows, keep=["position"]), to, "position", chunk_size, minibatch)
