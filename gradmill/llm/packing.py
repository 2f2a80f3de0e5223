"""Best-fit packing of token sequences, bulk-synchronous.

Documents become pieces of at most `capacity` tokens. Pieces are range-sorted by
length and ranked within their length; gaps (what open sequences have left) are
sorted by size. A superstep takes the pieces of one length, the longest first,
sweeps over the gaps from the successor of that length upwards, gives the r-th
piece of the length the r-th place found (so no two pieces want the same place),
and updates the gaps. Pieces of one length differ in nothing that matters here and
neither do sequences with equal gaps, so a superstep handles whole classes as
(count, first sequence) runs: the state has at most `capacity` lengths and gaps
however many documents there are. What grows with the input (lengths, ranks and
the places of the pieces) stays distributed.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradmill.llm import tokens
from gradmill.llm.common import materialise, ship, slices, whole_text

CAPACITY = 2048
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every whole text; null texts are empty and have the end id."""
    ship(docs.sparkSession)

    def encode(batches):
        enc, end = tokens.encoder(vocabulary), np.array([tokens.END_ID], "<u4").tobytes()
        for batch in slices(batches, 4 << 20):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(enc.encode(text) + end)
                out += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places as runs (length, first rank, count, first sequence, offset): piece
    rank + i of that length goes to sequence + i at that offset."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, count) that have it
    sizes: list[int] = []  # the gaps that some sequence has, ascending
    opened = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            gap = sizes[at] if at < len(sizes) else capacity
            each = gap // length  # the gap that a piece leaves is the best fit for the next one
            if at < len(sizes):
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                first, count = opened, -(-left // each)
                opened += count
            filled, rest = min(count, left // each), 0
            if filled < count:
                rest = left - filled * each
                leave(gap, first + filled + bool(rest), count - filled - bool(rest))
            for layer in range(each):
                if n := filled + (layer < rest):
                    runs.append((length, rank, n, first, capacity - gap + layer * length))
                    rank += n
            leave(gap - each * length, first, filled)
            if rest:
                leave(gap - rest * length, first + filled, 1)
            left -= filled * each + rest
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length. Equal
    rows are each placed. The rows' ranks within their length come from a range
    sort on (length, doc_id, piece), which spreads a frequent length over
    partitions, and from the counts of each partition. To the driver go those
    counts: at most one for each partition and each length."""
    spark = pieces.sparkSession
    fields = pieces.columns

    def ranked(parts):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for pdf in parts:
            pdf["part"] = part
            pdf["rank"] = pdf.groupby("length").cumcount().to_numpy() + seen[pdf["length"]]
            seen += np.bincount(pdf["length"], minlength=capacity + 1)
            yield pdf

    order = [F.col("length").desc(), "doc_id", "piece"]
    rows = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(rows.mapInPandas(ranked, f"{', '.join(f'{n} {t}' for n, t in pieces.dtypes)}, part int, rank long"), "ranked")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "part"])
    counts["base"] = counts.groupby("length")["n"].cumsum() - counts["n"]
    runs = pd.DataFrame(best_fit(counts.groupby("length")["n"].sum().to_dict(), capacity), columns=["length", "rank", "n", "first", "offset"], dtype=np.int64)
    runs["key"] = runs["length"] * (1 << 44) + runs["rank"]
    runs = runs.sort_values("key")
    known = spark.sparkContext.broadcast((counts[["length", "part", "base"]], runs[["key", "rank", "first", "offset"]].to_numpy()))

    def placed(parts):
        base, runs = known.value
        for pdf in parts:
            rank = pdf["rank"].to_numpy() + pdf[["length", "part"]].merge(base, how="left", on=["length", "part"])["base"].to_numpy()
            if not len(pdf):
                continue
            at = np.searchsorted(runs[:, 0], pdf["length"].to_numpy(np.int64) * (1 << 44) + rank, "right") - 1
            yield pdf[fields].assign(sequence_id=runs[at, 2] + rank - runs[at, 1], offset=runs[at, 3])

    return rows.mapInPandas(placed, f"{', '.join(f'{n} {t}' for n, t in pieces.dtypes)}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. A null doc_id stays null; repeated rows are each packed; an empty table
    gives no rows."""
    return place(materialise(token_pieces(docs, capacity, vocabulary), "pieces"), capacity)


def packed_sequences(docs: DataFrame, placed: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """sequence_id and ids of every sequence, from rows of pack(). doc_id has to be
    a key of docs, null among them at most once. A group holds one sequence, `capacity` ids at most."""
    ship(docs.sparkSession)

    def encode(batches):
        enc, end = tokens.encoder(vocabulary), np.array([tokens.END_ID], "<u4").tobytes()
        for batch in slices(batches, 4 << 20):
            ids = [np.frombuffer(enc.encode(t) + end, np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    ids = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")
    ids = ids.withColumnRenamed("doc_id", "own_id")
    rows = placed.join(ids, F.col("doc_id").eqNullSafe(F.col("own_id"))).select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
