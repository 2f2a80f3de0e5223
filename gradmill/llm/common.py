"""Shared pieces of the training-data operators. What outlives one job (written tables)
goes to the shared folder, see gradmill.runtime."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradmill.runtime import materialise, scratch, shared_dir, ship

__all__ = ["materialise", "scratch", "shared_dir", "ship", "whole_text", "drawn_ids", "bit_table", "flags", "slices", "text_offsets", "text_bytes"]


def whole_text(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def drawn_ids(known: DataFrame, sample: int, seed: int) -> DataFrame:
    """At most `sample` rows of known (doc_id and label), one a doc_id, the first by a
    hash of it; rows with nulls are left out. Hashes beyond what is surely enough are
    cut off first, so that not every task sends `sample` rows."""
    known = known.dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    size, h = known.count(), F.xxhash64("doc_id", F.lit(seed))
    if size > sample:
        share = min((sample + 8 * sample**0.5 + 50) / size, 1.0)
        known = known.filter(h < int((share - 0.5) * 2**64) if share < 1 else F.lit(True))
    return known.orderBy(h, "doc_id").limit(sample)


def bit_table(hashes: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash may be among those of a table: by a table of 16 bits a hash (two
    megabytes at most) that goes with the plan. It keeps most other rows out of a join
    with the hashes, which has to follow."""
    bits = min(max((16 * hashes.count()).bit_length(), 12), 24)
    low = lambda h: F.shiftrightunsigned(h, 64 - bits)
    place = lambda h: F.shiftright(low(h), 6).cast("int")
    bit = lambda h: low(h).bitwiseAND(F.lit(63).cast("long")).cast("int")
    one = F.expr("1L")
    words = hashes.groupBy(place(F.col("hash")).alias("at")).agg(F.bit_or(F.call_function("shiftleft", one, bit(F.col("hash")))).alias("word"))
    put = [0] * (1 << (bits - 6))
    for r in words.collect():  # 2 ** (bits - 6) rows at most
        put[r["at"]] = r["word"]
    table = F.from_json(F.lit(json.dumps(put)), "array<bigint>")  # a constant, folded once
    return lambda h: F.getbit(F.get(table, place(h)), bit(h)) == 1


def flags(positions: Column, total: Column, width: int = 1) -> Column:
    """An array of `total` strings, "1" where a place (from 0) is within `width` of one of
    the positions (an array of distinct numbers) and "0" elsewhere. Time and memory are
    in proportion to both."""
    at = F.array_sort(positions)
    after = F.concat(F.slice(at, 2, F.size(at)), F.array(total.cast("int")))
    mark = lambda a, b: F.concat(F.repeat(F.lit("1"), F.least(F.lit(width), b - a)), F.repeat(F.lit("0"), F.greatest(b - a - width, F.lit(0))))
    said = F.concat(F.repeat(F.lit("0"), F.get(at, F.lit(0))), F.array_join(F.zip_with(at, after, mark), ""))
    return F.when(F.size(at) > 0, F.split(said, "")).otherwise(F.array_repeat(F.lit("0"), total.cast("int")))


def slices(batches, target: int = 1 << 20, column: str = "text"):
    """Cuts record batches so that a slice holds about `target` bytes of text, or
    one longer document: what a step needs at once follows from that, not from
    the batch size."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = text_offsets(col)
        while at < n:
            to = at + 1
            start = ends[at]
            while to < n and ends[to + 1] - start <= target:
                to += 1
            yield batch.slice(at, to - at)
            at = to


def text_offsets(col: pa.Array):
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1]


def text_bytes(col: pa.Array):
    """(bytes, offsets) of a string column without nulls, as numpy arrays that
    share its memory; offsets begin at 0."""
    import numpy as np

    ends = text_offsets(col).astype(np.int64)
    data = col.buffers()[2]
    if data is None or not len(data):
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
