"""Readers: text formats to typed tables, with explicit schemas. They lose no lines, and
give rows ids that do not depend on partitioning where the format has one. Formats of
lines are splittable; movie_blocks and binary chunks are read a file at a time."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradmill.functions.hashing import hash_counts
from gradmill.functions.scalars import to_number, tokens
from gradmill.runtime import ship


def dense_csv(spark: SparkSession, path: str, delimiter: str = ",", limit_cols: int = 0, label_col: int = 0) -> DataFrame:
    """label and features of lines of numbers; empty or other tokens are 0. Only the
    first limit_cols columns where given."""
    t = tokens(F.col("value"), delimiter)
    t = F.slice(t, 1, limit_cols) if limit_cols else t
    rows = spark.read.text(path).filter("trim(value) <> ''").select(F.transform(t, to_number).alias("t"))
    if label_col < 0:
        return rows.select(F.element_at("t", -1).alias("label"), F.slice("t", 1, F.size("t") - 1).alias("features"))
    others = F.filter("t", lambda x, i: i != label_col)
    return rows.select(F.col("t")[label_col].alias("label"), others.alias("features"))


def click_log_csv(spark: SparkSession, path: str, bits: int, delimiter: str = ",", header: bool = True, first: int = 2, label_at: int = 1, bias: bool = True) -> DataFrame:
    """(sample_id, label, features) with one row a line: every token from column `first`
    on is hashed as text, empty ones too, and counted within the line. sample_id is the
    line's first token, null where that is the label; lines of one id stay apart."""
    rows = spark.read.text(path).select(tokens(F.col("value"), delimiter).alias("t"))
    if header:
        rows = rows.filter(F.col("t")[label_at].try_cast("double").isNotNull())
    sample = F.col("t")[0] if label_at else F.lit(None).cast("string")
    return rows.select(sample.alias("sample_id"), to_number(F.col("t")[label_at]).alias("label"), hash_counts(F.slice("t", first + 1, F.greatest(F.size("t"), F.lit(1))), bits, bias).alias("features"))


def ratings_csv(spark: SparkSession, path: str, header: bool = True, user_base: int = 1, item_base: int = 0) -> DataFrame:
    """user_id (from 0), item_id and rating of lines user,item,rating[,…]."""
    t = F.split("value", ",")
    rows = spark.read.text(path).filter(F.length("value") >= 3)
    rows = rows.select((t[0].try_cast("long") - user_base).alias("user_id"), (t[1].try_cast("long") - item_base).alias("item_id"), t[2].try_cast("double").alias("rating"))
    return rows.filter("user_id is not null") if header else rows


def libsvm(lines: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """label and features (idx, val) of lines `label idx:val …`, and the columns to keep."""
    t = F.filter(F.split(F.trim(column), r"\s+"), lambda x: x != "")
    pairs = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), _pair)
    return lines.select(*(keep or []), t[0].try_cast("double").alias("label"), pairs.alias("features"))


def _pair(x):
    return F.struct(F.substring_index(x, ":", 1).cast("int").alias("idx"), F.substring_index(x, ":", -1).cast("double").alias("val"))


def multi_label(lines: DataFrame, column: str = "value", most: int = 4) -> DataFrame:
    """labels (at most `most`, each plus 1) and features of lines `l1,l2 | i:v …`;
    values are cut to whole numbers, and an index that repeats in a line is summed."""
    sides = F.split(column, r"\|")
    labels = F.transform(F.slice(F.filter(F.split(F.trim(sides[0]), ","), lambda x: F.trim(x) != ""), 1, most), lambda x: F.trim(x).cast("int") + 1)
    t = F.filter(F.split(F.trim(sides[1]), r"\s+"), lambda x: x.contains(":"))
    pairs = F.transform(t, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("idx"), F.substring_index(x, ":", -1).cast("double").cast("int").cast("double").alias("val")))
    ids = F.array_sort(F.array_distinct(pairs["idx"]))
    summed = F.transform(ids, lambda i: F.struct(i.alias("idx"), F.aggregate(F.filter(pairs, lambda p: p["idx"] == i), F.lit(0.0), lambda s, p: s + p["val"]).alias("val")))
    return lines.select("*", labels.alias("labels"), summed.alias("features"))


def unpivot_ratings(df: DataFrame, user: str, items: list[str], missing: float = 99.0, scale: float = 10.0) -> DataFrame:
    """(user, item_id, rating) of a matrix with a column for each item; the missing
    mark is left out and values are divided by scale."""
    pairs = F.array(*[F.struct(F.lit(i).alias("item_id"), F.col(c).cast("double").alias("rating")) for i, c in enumerate(items)])
    return df.select(user, F.inline(pairs)).filter(F.col("rating") != missing).withColumn("rating", F.col("rating") / scale)


def movie_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, item_id, rating) of files `item:` then lines user,rating,date."""
    files = spark.read.text(path, wholetext=True)
    block = files.select(F.explode(F.split("value", r"\n(?=\d+:)")).alias("b"))
    rows = block.select(F.substring_index("b", ":", 1).cast("long").alias("item_id"), F.explode(F.split("b", "\n")).alias("line"))
    t = F.split("line", ",")
    return rows.filter(F.size(t) >= 2).select(t[0].cast("long").alias("user_id"), "item_id", t[1].cast("double").alias("rating"))


_PAIR = np.dtype([("idx", "<i4"), ("val", "<f4")])


def decode_chunk(data: bytes, labels: bool = True) -> list[tuple[float | None, list[tuple[int, float]]]]:
    """Rows of a binary chunk: size, count, then ([label] nnz (idx val)*) of each."""
    _, count = struct.unpack_from("<ii", data)
    at, out = 8, []
    for _ in range(count):
        label = None
        if labels:
            (label,), at = struct.unpack_from("<f", data, at), at + 4
        (nnz,), at = struct.unpack_from("<i", data, at), at + 4
        out.append((label, np.frombuffer(data, _PAIR, nnz, at).tolist()))
        at += 8 * nnz
    return out


def encode_chunk(rows: list[tuple[float | None, list[tuple[int, float]]]]) -> bytes:
    body = b"".join((struct.pack("<f", label) if label is not None else b"") + struct.pack("<i", len(pairs)) + b"".join(struct.pack("<if", *p) for p in pairs) for label, pairs in rows)
    return struct.pack("<ii", len(body) + 8, len(rows)) + body


def decode_chunks(chunks: DataFrame, labels: bool = True) -> DataFrame:
    """(path, place, label, features) of rows with path and content, a binary chunk."""
    ship(chunks.sparkSession)

    def run(parts):
        for pdf in parts:
            rows = [(p, k, label, [{"idx": i, "val": v} for i, v in pairs]) for p, c in zip(pdf["path"], pdf["content"]) for k, (label, pairs) in enumerate(decode_chunk(c, labels))]
            yield pd.DataFrame(rows, columns=["path", "place", "label", "features"])

    return chunks.select("path", "content").mapInPandas(run, "path string, place int, label double, features array<struct<idx:int,val:double>>")


def binary_chunks(spark: SparkSession, path: str, labels: bool = True) -> DataFrame:
    """decode_chunks() of binary chunk files, one task for some files."""
    return decode_chunks(spark.read.format("binaryFile").load(path), labels)
