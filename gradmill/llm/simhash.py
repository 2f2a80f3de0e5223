"""SimHash near duplicates with BK-trees.

Fingerprints are reduced to their distinct values. Two of them within the radius
agree on at least one of radius + 1 bands of bits, so every (band, value) is a
shard, and a shard's BK-tree (children keyed by their integer Hamming distance to
the parent) finds the links inside it: a search follows only the edges within the
radius of its distance. Trees are built and searched where their shard is, so none
has to be sent to all executors; small shards share a task. A shard of more than
`most` fingerprints is split again by bands of the remaining bits, so that its
tree stays small. A shard reports a spanning forest of its links, not all pairs.
Components are joined by alternating star contractions, in tables.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradmill.llm.common import materialise, ship, slices, whole_text

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is in over half the hashes of the word shingles."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
        hashes = list(map(digest, map(b" ".join, zip(*(words[k:] for k in range(shingle))))))
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


@functools.cache
def _streams(words: int) -> np.ndarray:
    """Factors and summands of the words of a wide fingerprint."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, (2, words), np.uint64) | np.array([[1], [0]], np.uint64)


def wide_fingerprint(hashes: np.ndarray, bits: int) -> bytes:
    """A SimHash of more than 64 bits: each hash is mixed anew for each 64 of them, and a
    bit is set if it is in over half the mixed hashes."""
    times, plus = _streams(bits // 64)
    ones = np.zeros((8, bits // 8), np.int64)  # of the first bit of each byte, the second ones, and so on
    for at in range(0, len(hashes), 255):
        some = hashes[at : at + 255, None]
        m = -(-len(some) // 15)
        mixed = np.zeros((15 * m, bits // 64), np.uint64)
        x = np.add(np.multiply(some, times), plus, out=mixed[: len(some)])
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        # of three rows the counts of bits are two bits, of 15 four, of 255 bytes
        pairs = _halves(mixed, 1, 0x5555555555555555).reshape(2, 3, 5 * m, -1).sum(axis=1)
        fours = _halves(pairs, 2, 0x3333333333333333).reshape(2, 2, 5, m, -1).sum(axis=2)
        bytes_ = _halves(fours, 4, 0x0F0F0F0F0F0F0F0F).sum(axis=3)
        ones += bytes_.astype("<u8", copy=False).view(np.uint8).reshape(8, -1)
    return np.packbits(2 * ones.T > len(hashes), axis=1, bitorder="little").tobytes()


def _halves(x: np.ndarray, width: int, mask: int) -> np.ndarray:
    """The even and the odd fields of `width` bits."""
    out = np.empty((2, *x.shape), np.uint64)
    np.bitwise_and(x, np.uint64(mask), out=out[0])
    np.bitwise_and(x >> np.uint64(width), np.uint64(mask), out=out[1])
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the unsigned fingerprint in a signed long); null texts are
    empty, texts without words have fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, 4 << 20):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of words of 64 bits."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKTree:
    """A BK-tree over unsigned fingerprints of 64 bits, or rows of several such words,
    as arrays: the children of a node are consecutive and sorted by their distance to
    it (equal ones are a child at 0). Built and searched one level at a time for all fingerprints at
    once."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps.reshape(len(fps), -1)
        n, self.span = len(fps), 64 * self.fps.shape[1] + 1
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        at, here = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)  # who still sinks, and the node where they are
        while len(at):
            d = distances(self.fps[at], self.fps[here])
            _, first, group = np.unique(here * self.span + d, return_index=True, return_inverse=True)
            child = at[first]
            parent[child], edge[child] = here[first], d[first]
            sinks = np.ones(len(at), bool)
            sinks[first] = False
            at, here = at[sinks], child[group][sinks]
        order = np.lexsort((edge, parent))
        self.node = order
        self.key = parent[order] * self.span + edge[order]

    def within(self, radius: int, block: int = 4096):
        """Yields arrays (a, b), a < b, of the pairs of positions within radius."""
        n, step = len(self.fps), max(block // self.fps.shape[1], 1)
        for low in range(0, n, step):
            query = np.arange(low, min(low + step, n))
            node = np.zeros(len(query), np.int64)
            while len(query):
                d = distances(self.fps[query], self.fps[node])
                hit = (d <= radius) & (query < node)
                yield query[hit], node[hit]
                first = np.searchsorted(self.key, node * self.span + np.maximum(d - radius, 0))
                last = np.searchsorted(self.key, node * self.span + np.minimum(d + radius, self.span - 1), "right")
                count = last - first
                query = np.repeat(query, count)
                start = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count)
                node = self.node[start + np.arange(len(query))]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that join what the tree finds within radius."""
    root = np.arange(len(fps))
    for a, b in BKTree(fps).within(radius):
        while len(a):  # hook the larger root to the smaller one, then shorten the paths
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    member = np.flatnonzero(root != np.arange(len(fps)))
    return member, root[member]


def _bands(bits: list[int], n: int) -> list[list[int]]:
    return [list(b) for b in np.array_split(np.array(bits), n)]


def _pick(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _band(fp: Column, bits: list[int]) -> Column:
    """Consecutive bits of fp as a number."""
    return F.shiftrightunsigned(fp, int(bits[0])).bitwiseAND(F.lit((1 << len(bits)) - 1).cast("long"))


def links(distinct: DataFrame, radius: int = RADIUS, most: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are
    those of all pairs within radius. A shard over `most` is dealt out by bands of
    the bits outside its own band, for which its members differ by at most radius
    too; what is still larger after two splits agrees on most bits and is searched
    as it is. No fingerprints, no links."""
    whole = list(range(BITS))
    keyed = distinct.select("fp", F.posexplode(F.array(*[_band(F.col("fp"), b) for b in _bands(whole, radius + 1)])).alias("band", "value"))
    # a first count, combined before the shuffle, keeps out the many shards of one fingerprint
    sizes = keyed.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, ["band", "value"])
    first = _bands(whole, radius + 1)
    split = []
    for k, band in enumerate(first):
        rest = _bands([b for b in whole if b not in band], radius + 1)
        # the remaining bits can lie on both sides of the band
        parts = [_bits(F.col("fp"), bits) for bits in rest]
        split.append(F.array(*parts))
    chosen = split[-1]
    for k in range(len(split) - 1):
        chosen = F.when(F.col("band") == k, split[k]).otherwise(chosen)
    small = keyed.filter(F.col("n") <= most).select("fp", "band", "value", F.lit(-1).alias("band2"), F.lit(0).cast("long").alias("value2"))
    large = keyed.filter(F.col("n") > most).select("fp", "band", "value", F.posexplode(chosen).alias("band2", "value2"))
    both = small.unionByName(large)

    def search(parts):
        held: list[pd.DataFrame] = []  # the shard at the end of a batch may go on in the next one
        for pdf in parts:
            pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            keys = pdf[["band", "value", "band2", "value2"]].to_numpy(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.zeros(0, int)
            done = new[-1] if len(new) else 0
            held = [pdf.iloc[done:]]
            yield from shards(pdf["fp"].to_numpy(np.int64)[:done], new)
        for pdf in held:
            yield from shards(pdf["fp"].to_numpy(np.int64), np.array([0, len(pdf)]))

    def shards(fps, cuts):
        found_a, found_b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo > 1:
                mine = fps[lo:hi].view(np.uint64)
                if hi - lo == 2:
                    if int(mine[0] ^ mine[1]).bit_count() <= radius:
                        found_a.append(fps[lo : lo + 1]), found_b.append(fps[lo + 1 : hi])
                    continue
                member, root = forest(mine, radius)
                found_a.append(fps[lo:hi][member]), found_b.append(fps[lo:hi][root])
        if found_a:
            yield pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    dealt = both.repartition("band", "value", "band2", "value2").sortWithinPartitions("band", "value", "band2", "value2")
    return dealt.mapInPandas(search, "a long, b long").distinct()


def _bits(fp: Column, bits: list[int]) -> Column:
    """Ascending bits of fp as a number; runs of consecutive ones are taken whole."""
    out, width, run = None, 0, [bits[0]]
    for b in [*bits[1:], None]:
        if b is not None and b == run[-1] + 1:
            run.append(b)
            continue
        part = F.shiftleft(_band(fp, run), width)
        out = part if out is None else out.bitwiseOR(part)
        width += len(run)
        run = [b]
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node that
    links reach. Alternates large-star and small-star contractions until nothing
    changes; minima are combined before the shuffle, each round is written to the
    shared folder, and only a count and a sum come to the driver. Edges with a null or
    from a node to itself are left out; without edges there are no rows."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    that links within radius reach, of every document. Repeated rows and equal
    texts have one fingerprint; a null doc_id never names a component with others
    in it. Each fingerprint enters the search once, however many copies it has."""
    rows = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = materialise(links(distinct.select("fp"), radius), "links")
    of = components(found).withColumnRenamed("node", "fp")
    named = distinct.join(of, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
