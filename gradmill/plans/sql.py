"""Pieces of DuckDB SQL for functions that it lacks."""

from __future__ import annotations

_M64 = "18446744073709551615::UHUGEINT"


def uniform(key: str, seed: int) -> str:
    """frames.uniform() of an SQL expression."""
    return f"(('0x' || substr(md5('{seed}:' || ({key})), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def normal(key: str, seed: int) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform(key, seed)})) * cos(2 * 3.141592653589793::DOUBLE * {uniform(f'({key}) || {chr(39)}b{chr(39)}', seed)}))"


def crc32(text: str) -> str:
    """The checksum of a text of ASCII characters, a bit at a time."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_transform(range(8), lambda b: (ascii(substr({text}, i, 1)) >> b::INTEGER & 1)::BIGINT)))"
    step = "xor(a >> 1, (xor(a, b) & 1) * 3988292384)"
    return f"xor(list_reduce({bits}, lambda a, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _let(value: str, name: str, use: str) -> str:
    return f"list_transform([{value}], lambda {name}: {use})[1]"


def _left(x: str, n: int, name: str) -> str:
    return _let(x, name, f"((({name} << {n}) & {_M64}) | ({name} >> {64 - n}))")


def _times(x: str, k: int) -> str:
    return f"(({x}) * {k}::UHUGEINT & {_M64})"


def _mix1(k: str) -> str:
    return _times(_left(_times(k, 0x87C37B91114253D5), 31, "r1"), 0x4CF5AD432745937F)


def _mix2(k: str) -> str:
    return _times(_left(_times(k, 0x4CF5AD432745937F), 33, "r2"), 0x87C37B91114253D5)


def _last(k: str) -> str:
    one = _let(k, "l1", _times("xor(l1, l1 >> 33)", 0xFF51AFD7ED558CCD))
    two = _let(one, "l2", _times("xor(l2, l2 >> 33)", 0xC4CEB9FE1A85EC53))
    return _let(two, "l3", "xor(l3, l3 >> 33)")


def _number(hexed: str, at: str) -> str:
    """Eight bytes from a place (from 0) of a text of hex digits, padded with zeros, the lowest first."""
    pairs = " || ".join(f"substr({hexed}, 2 * ({at} + {k}) + 1, 2)" for k in reversed(range(8)))
    return f"('0x' || {pairs})::UBIGINT::UHUGEINT"


def x64(source: str, seed: int = 100) -> str:
    """Tables up to hashed(t, h): the low half of Murmur3_x64_128 of the distinct texts t
    of a table. Needs WITH RECURSIVE."""
    k1, k2 = _number("hx", "i"), _number("hx", "i + 8")
    first = _left(f"xor(h1, {_mix1(k1)})", 27, "r3")
    second = _left(f"xor(h2, {_mix2(k2)})", 31, "r4")
    half = f"SELECT t, hx, n, i, h2, ({_times(f'({first} + h2) & {_M64}', 5)} + {0x52DCE729}) & {_M64} AS h1 FROM blocks WHERE i + 16 <= n"
    whole = f"SELECT t, hx, n, i, h1, ({second} + h1) & {_M64} AS h2 FROM ({half})"
    turn = f"SELECT t, hx, n, i + 16 AS i, h1, ({_times('h2', 5)} + {0x38495AB5}) & {_M64} AS h2 FROM ({whole})"
    return f"""words64 AS (SELECT t, hex(t) || repeat('00', 16) AS hx, strlen(t) AS n FROM (SELECT DISTINCT t FROM {source})),
blocks AS (SELECT t, hx, n, 0::BIGINT AS i, {seed}::UHUGEINT AS h1, {seed}::UHUGEINT AS h2 FROM words64 UNION ALL {turn}),
tails AS (SELECT t, n, xor(CASE WHEN n > i THEN xor(h1, {_mix1(_number('hx', 'i'))}) ELSE h1 END, n::UHUGEINT) AS h1, xor(CASE WHEN n > i + 8 THEN xor(h2, {_mix2(_number('hx', 'i + 8'))}) ELSE h2 END, n::UHUGEINT) AS h2 FROM blocks WHERE i + 16 > n),
sums AS (SELECT t, h1 + h2 & {_M64} AS h1, h2 FROM tails),
hashed AS (SELECT t, ({_last('h1')} + {_last(f'(h2 + h1 & {_M64})')}) & {_M64} AS h FROM sums)"""
