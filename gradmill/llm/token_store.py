"""Token ids as ORC files.

A store is a folder of ORC files in ascending document order. Ids are an integer
list column, which ORC keeps in run-length encoded stripes; stripes are read in
parallel, row indexes and a Bloom filter on ``doc_id`` let readers skip stripes
and row groups. Columns:

``doc_id``; ``n_tokens`` with the end id; ``shard``, the range of documents that
the row is in; ``shard_start``, ids of the shard before the document; ``ids``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradmill.llm import tokens
from gradmill.llm.common import ship, slices, whole_text

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
}
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encodes every whole text and writes the store. Null texts are empty; every
    document ends with id 0, so an empty one has that id alone. Rows with a null
    doc_id stand first; rows of equal doc_id stand by a hash of
    their text. Other columns
    are ignored, an empty table gives an empty store.

    One shuffle sorts the texts by range, so no key can make a partition large."""
    ship(docs.sparkSession)

    def encode(batches):
        enc, shard, start = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([tokens.END_ID], "<u4").tobytes()
        for batch in slices(batches, 4 << 20):
            found = [enc.encode(t) + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in found], np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + ends[:-1]), ids], schema=_ROWS)
            start += int(ends[-1])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # what is sampled for the ranges goes to the driver: no texts
    (
        docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(encode, "doc_id long, n_tokens long, shard int, shard_start long, ids array<int>")
        .write.options(**ORC_OPTIONS)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The store's rows, with low <= doc_id <= high where given; the bounds reach
    the row indexes and Bloom filters."""
    df = spark.read.schema("doc_id long, n_tokens long, shard int, shard_start long, ids array<int>").orc(path)
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    return df if high is None else df.filter(F.col("doc_id") <= high)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a store, all
    from its files. The running sum over all documents is one over the shards (a
    row for each file), added to what each shard counts itself. An empty store has no
    rows."""

    def crc(batches):
        for batch in batches:
            ids, ends = batch.column(4).flatten(), np.asarray(batch.column(4).offsets)
            data = memoryview(np.ascontiguousarray(np.asarray(ids), "<u4")).cast("B")
            ends = (ends - ends[0]) * 4
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=["doc_id", "n_tokens", "shard", "shard_start", "ids_crc32"])

    rows = read_tokens(spark, path)
    shards = rows.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shards_before"))
    return (
        rows.mapInArrow(crc, "doc_id long, n_tokens long, shard int, shard_start long, ids_crc32 long")
        .join(F.broadcast(shards), "shard")  # a row for each file of the store
        .select("doc_id", (F.col("shards_before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
    )
