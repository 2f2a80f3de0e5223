"""The two Murmur3 hashes of the feature encoders.

Spark's own hash() differs from the 32-bit one (seed 42) for texts whose byte length is
no multiple of four, and products that wrap are not to be had in SQL arithmetic: both,
also the low half of the 128-bit one (seed 100), are Arrow functions over numpy arrays,
the texts of one byte length at a time. murmur3_32() is the first one as a column
expression, exact but a hundred times as slow, for where there are no Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradmill.runtime import ship

_M32 = (1 << 32) - 1
_M64 = (1 << 64) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def _times(a: Column, k: int) -> Column:
    """a * k modulo 2 ** 32 for a 32-bit a, in parts that fit a signed long."""
    low = lambda a: F.shiftleft((F.shiftright(a, 16) * k).bitwiseAND(0xFFFF), 16) + a.bitwiseAND(0xFFFF) * k
    return _let(a, lambda a: low(a).bitwiseAND(_M32))


def _left(a: Column, n: int) -> Column:
    return _let(a, lambda a: F.shiftleft(a, n).bitwiseOR(F.shiftright(a, 32 - n)).bitwiseAND(_M32))


def _fold(a: Column, n: int) -> Column:
    return _let(a, lambda a: a.bitwiseXOR(F.shiftright(a, n)))


def _scramble(k: Column) -> Column:
    return _times(_left(_times(k, 0xCC9E2D51), 15), 0x1B873593)


def murmur3_32(text: Column, seed: int = 42) -> Column:
    """Murmur3_x86_32 of the UTF-8 bytes, unsigned, as a long. Null for null."""
    digits = F.hex(F.encode(text, "UTF-8"))
    size = F.octet_length(text).cast("long")

    def number(at: Column, count: int) -> Column:
        pairs = [F.substr(digits, at + 2 * k, F.lit(2)) for k in reversed(range(count))]
        return F.conv(F.concat(*pairs), 16, 10).cast("long")

    whole = (size / 4).cast("int")
    words = F.when(whole > 0, F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda i: number(i * 8 + 1, 4))).otherwise(F.array().cast("array<long>"))
    step = lambda h, k: (_times(_left(h.bitwiseXOR(_scramble(k)), 13), 5) + 0xE6546B64).bitwiseAND(_M32)
    h = F.aggregate(words, F.lit(seed).cast("long"), step)
    rest, at = size % 4, whole * 8 + 1
    tail = F.when(rest == 1, number(at, 1)).when(rest == 2, number(at, 2)).when(rest == 3, number(at, 3)).otherwise(F.lit(0).cast("long"))
    h = h.bitwiseXOR(_scramble(tail)).bitwiseXOR(size)
    return _fold(_times(_fold(_times(_fold(h, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)


def murmur3_x64_low(data: bytes, seed: int = 100) -> int:
    """The first 64 bits of Murmur3_x64_128."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    left = lambda x, n: ((x << n) | (x >> (64 - n))) & _M64

    def last(k: int) -> int:
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            k = (k ^ (k >> 33)) * c & _M64
        return k ^ (k >> 33)

    mix1 = lambda k: left(k * c1 & _M64, 31) * c2 & _M64
    mix2 = lambda k: left(k * c2 & _M64, 33) * c1 & _M64
    h1 = h2 = seed
    whole = len(data) // 16 * 16
    for at in range(0, whole, 16):
        k1, k2 = (int.from_bytes(data[at + x : at + x + 8], "little") for x in (0, 8))
        h1 = ((left(h1 ^ mix1(k1), 27) + h2) * 5 + 0x52DCE729) & _M64
        h2 = ((left(h2 ^ mix2(k2), 31) + h1) * 5 + 0x38495AB5) & _M64
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= mix2(int.from_bytes(tail[8:], "little"))
    if tail:
        h1 ^= mix1(int.from_bytes(tail[:8], "little"))
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & _M64
    h2 = (h2 + h1) & _M64
    return (last(h1) + last(h2)) & _M64


def _left64(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _last64(k: np.ndarray) -> np.ndarray:
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = (k ^ (k >> np.uint64(33))) * np.uint64(c)
    return k ^ (k >> np.uint64(33))


def _x64_rows(rows: np.ndarray, seed: int) -> np.ndarray:
    """murmur3_x64_low of each row of bytes."""
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    n, size = rows.shape
    whole, rest = size // 16 * 16, size % 16
    h1 = h2 = np.full(n, seed, np.uint64)
    words = np.zeros((n, whole + 16), np.uint8)
    words[:, :size] = rows
    words = words.view("<u8")
    mix1 = lambda k: _left64(k * c1, 31) * c2
    mix2 = lambda k: _left64(k * c2, 33) * c1
    for at in range(0, whole // 8, 2):
        h1 = (_left64(h1 ^ mix1(words[:, at]), 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        h2 = (_left64(h2 ^ mix2(words[:, at + 1]), 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
    if rest > 8:
        h2 = h2 ^ mix2(words[:, -1])
    if rest:
        h1 = h1 ^ mix1(words[:, -2])
    h1, h2 = h1 ^ np.uint64(size), h2 ^ np.uint64(size)
    h1 = h1 + h2
    return _last64(h1) + _last64(h2 + h1)


def _x32_rows(rows: np.ndarray, seed: int) -> np.ndarray:
    """murmur3_32 of each row of bytes, unsigned."""
    n, size = rows.shape
    whole = size // 4
    words = np.zeros((n, 4 * whole + 4), np.uint8)
    words[:, :size] = rows
    words = words.view("<u4")
    left = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    scrambled = lambda k: left(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = np.full(n, seed, np.uint32)
    for at in range(whole):
        h = left(h ^ scrambled(words[:, at]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ scrambled(words[:, whole]) ^ np.uint32(size)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _by_length(texts: pa.Array, rows: Callable[[np.ndarray, int], np.ndarray], seed: int) -> np.ndarray:
    """rows() of the bytes of the texts of each length, for a string array without nulls."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sizes, out = np.diff(ends), np.zeros(len(texts), np.uint64)
    order = np.argsort(sizes, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(mine):
            out[mine] = rows(data[ends[mine][:, None] + np.arange(sizes[mine[0]])], seed)
    return out


def x64_low_array(texts: pa.Array, seed: int = 100) -> np.ndarray:
    """murmur3_x64_low of each text of a string array without nulls."""
    return _by_length(texts, _x64_rows, seed)


def x32_array(texts: pa.Array, seed: int = 42) -> np.ndarray:
    """murmur3_32 of each text of a string array without nulls."""
    return _by_length(texts, _x32_rows, seed)


def bucket_x64(text: Column, bits: int) -> Column:
    """murmur3_x64_low modulo 2 ** bits of each text; null for null."""
    ship()

    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        h = x64_low_array(values.fill_null("")) & np.uint64((1 << bits) - 1)
        return pa.array(h.astype(np.int64), mask=np.asarray(values.is_null()))

    return run(text)


def _counted(lists: pa.ListArray, bucket: Callable[[pa.Array], np.ndarray], always: int | None = None) -> pa.ListArray:
    """Of each list of tokens the buckets with their counts, by ascending bucket, and one
    more of the bucket `always`. A null list has no tokens, a null token is an empty one."""
    ends = np.asarray(lists.offsets)
    flat = lists.values.slice(ends[0], ends[-1] - ends[0]).fill_null("")
    row, idx = np.repeat(np.arange(len(lists)), np.diff(ends)), bucket(flat).astype(np.int64)
    if always is not None:
        row, idx = np.concatenate((row, np.arange(len(lists)))), np.concatenate((idx, np.full(len(lists), always, np.int64)))
    found, times = np.unique((row.astype(np.int64) << 32) + idx, return_counts=True)  # buckets are under 2 ** 32
    pairs = pa.StructArray.from_arrays([pa.array(found & 0xFFFFFFFF), pa.array(times.astype(float))], names=["idx", "val"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(found >> 32, np.arange(len(lists) + 1)).astype(np.int32)), pairs)


def count_buckets(lists: pa.ListArray, bits: int, bias: bool = True) -> pa.ListArray:
    """Counts of the tokens' murmur3_x64_low modulo 2 ** bits; with bias also of the
    constant token."""
    mask = (1 << bits) - 1
    return _counted(lists, lambda flat: x64_low_array(flat) & np.uint64(mask), murmur3_x64_low(b"bias") & mask if bias else None)


def hash_counts(tokens: Column, bits: int, bias: bool = True) -> Column:
    """count_buckets() of a column of lists: array of (idx, val), within the row."""
    ship()

    @F.arrow_udf("array<struct<idx:bigint,val:double>>")
    def run(lists: pa.Array) -> pa.Array:
        return count_buckets(lists, bits, bias)

    return run(tokens)


def hash_counts_32(tokens: Column, buckets: int) -> Column:
    """Counts of the tokens' murmur3_32 modulo buckets: array of (idx, val)."""
    ship()

    @F.arrow_udf("array<struct<idx:bigint,val:double>>")
    def run(lists: pa.Array) -> pa.Array:
        return _counted(lists, lambda flat: x32_array(flat) % np.uint64(buckets))

    return run(tokens)
