"""Near copies by similarity: documents whose sets of word shingles have a Jaccard
similarity of at least a threshold, and their components.

Texts have SimHash fingerprints of BITS bits, BK-trees of them find the pairs within
radius(), and every pair found is verified by the similarity itself. 64 bits do not
tell such pairs: at similarity 0.8 texts differ in about ten of them, and unrelated texts
in 32 with a deviation of four. Of 2048 bits they differ in about 310 and 1024, with
deviations of 16 and 23.

As in op8, trees are built and searched in shards that texts within the radius share.
With a radius that wide, bands of the fingerprint's own bits hold three or four of them
(or the shards become hundreds), so MinHash bands deal the texts out. They only say which
texts meet in a tree: two share a band with probability 1 - (1 - s^5)^32 for similarity
s, all but three of a million pairs at 0.8, and fewer are missed above. A shard is all
that meet one leader, the least text of a band's bucket.

A shard first reports for each text the nearest one in its tree, not all pairs, and of
over `most` texts each block has its own tree, with the leader. Where the verified links
leave several components, the shard's pairs between them are searched for in full, of
over `most` texts by pairs of its blocks.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradmill.llm.common import materialise, ship, slices, whole_text
from gradmill.llm.simhash import BKTree, components, distances, wide_fingerprint

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 5
BITS = 2048


def radius(least: float, size: np.ndarray, deviations: float = 5.0) -> np.ndarray:
    """How many of BITS bits sets of similarity `least` may differ in, the smaller one of
    `size` shingles: the mean and five deviations, which less than one of a million pairs
    exceed. A bit is the side of a random plane that a set lies on, so its share is the
    angle between the sets; halves of small sets are coarse, which adds to it."""
    share = np.minimum(np.arccos(2 * least / (1 + least)) / np.pi + 0.15 / np.asarray(size), 0.5)
    return np.maximum(BITS * share + deviations * (BITS * share * (1 - share)) ** 0.5, 0).astype(np.int64)


def shingles(text: str, shingle: int = SHINGLE) -> set[bytes]:
    """The word shingles; a text of fewer words is one shingle."""
    words = text.encode().lower().split()  # as in simhash.fingerprint
    if len(words) <= shingle:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))


def similarity(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


@functools.cache
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + count)
    return rng.integers(0, 1 << 64, count, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, count, np.uint64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    return np.fromiter(map(digest, shingles(text, shingle)), np.uint64)


def band_keys(hashes: np.ndarray, block: int = 256) -> np.ndarray:
    """One key a band, of its number and the smallest values of the hashes under each of
    its permutations."""
    times, plus = _permutations(BANDS * ROWS)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), block):
        np.minimum(least, (hashes[at : at + block, None] * times + plus).min(axis=0), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, 4 << 20):
            sizes, wide, keys = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, shingle)
                sizes.append(len(hashes))
                wide.append(wide_fingerprint(hashes, BITS))
                keys.append(band_keys(hashes))
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()), lists], names=["doc_id", "h", "size", "wide", "keys"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, size long, wide binary, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of text hashes that are similar enough."""
    met = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("text_a")), "a")
    met = met.join(texts.select(F.col("h").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(parts):
        of = functools.lru_cache(64)(functools.partial(shingles, shingle=shingle))
        for pdf in parts:
            good = [similarity(of(x), of(y)) >= least for x, y in zip(pdf["text_a"], pdf["text_b"])]
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"]})[good]

    return met.mapInPandas(run, "a long, b long")


def _close(rows: DataFrame, least: float, deviations: float, whole: bool) -> DataFrame:
    """Pairs (a, b) of one shard (leader, low, high) whose fingerprints are close and whose
    sizes allow the similarity, from rows with h, size, wide, root and block. The whole
    search gives all of them that are of two components, and in a shard of two blocks of
    two blocks; the first one gives each text its nearest before it, or else after it."""

    def search(parts):
        held: list[pd.DataFrame] = []  # the shard at the end of a batch may go on in the next one
        for pdf in parts:
            pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            shard = pdf[["leader", "low", "high"]].to_numpy(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]).any(axis=1)))) if len(pdf) else np.zeros(0, int)
            done = new[-1] if len(new) else 0
            held = [pdf.iloc[done:]]
            yield from shards(pdf.iloc[:done], new)
        for pdf in held:
            yield from shards(pdf, np.array([0, len(pdf)]))

    def shards(pdf, cuts):
        h, size, root, block = (pdf[n].to_numpy(np.int64) for n in ("h", "size", "root", "block"))
        two = (pdf["low"] != pdf["high"]).to_numpy()
        wide = np.frombuffer(b"".join(pdf["wide"]), np.uint64).reshape(len(pdf), BITS // 64)
        limit = radius(least, size, deviations)
        found, none = [np.zeros((0, 2), np.int64)], np.iinfo(np.int64).max
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            n = hi - lo
            if n < 2 or whole and (root[lo:hi] == root[lo]).all():
                continue
            before, after = np.full((2, n), none)
            close = BKTree(wide[lo:hi]).within(limit[lo:hi].max()) if n > 2 else [(np.zeros(1, int), np.ones(1, int))]
            for a, b in close:
                a, b = a + lo, b + lo
                apart = distances(wide[a], wide[b])
                good = (apart <= np.maximum(limit[a], limit[b])) & (np.minimum(size[a], size[b]) > least * np.maximum(size[a], size[b]) - 1e-6)
                if whole:
                    good &= (root[a] != root[b]) & ~(two[lo] & (block[a] == block[b]))
                    found.append(np.stack((h[a[good]], h[b[good]]), axis=1))
                else:
                    a, b, apart = a[good] - lo, b[good] - lo, apart[good] * n
                    np.minimum.at(before, b, apart + a)
                    np.minimum.at(after, a, apart + b)
            at = np.where(before < none, before, after)
            has = np.flatnonzero(at < none)
            found.append(np.stack((h[lo + at[has] % n], h[lo + has]), axis=1))
        pairs = np.concatenate(found)
        if len(pairs):
            yield pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    dealt = rows.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high", "h")
    return dealt.mapInPandas(search, "a long, b long").distinct()


def text_components(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, most: int = 4096, deviations: float = 5.0) -> DataFrame:
    """h (the hash of a text), first (the smallest doc_id with it) and root (the same
    for all texts of a component), of every text of a row with a doc_id. A null text
    is an empty one; texts without words are alike; an empty table has none."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    nodes = _signatures(rows, shingle).groupBy("h").agg(F.min(F.struct("doc_id", "size", "wide", "keys")).alias("own"))
    nodes = materialise(nodes.select("h", F.col("own.doc_id").alias("first"), "own.size", "own.wide", "own.keys"), "nodes")
    keys = nodes.select("h", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("leader")).filter("n > 1").select("key", "leader")
    met = materialise(keys.join(shared, "key").select("leader", "h").distinct(), "met")
    blocks = met.groupBy("leader").agg(F.ceil(F.count("*") / most).alias("blocks"))
    met = materialise(met.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks"))), "shards")
    texts = rows.join(met.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    texts = materialise(texts, "texts")
    prints = nodes.select("h", "size", "wide")
    each = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    own = met.withColumn("low", F.explode(F.when(F.col("h") == F.col("leader"), each).otherwise(F.array("block"))))
    own = own.select("leader", "low", F.col("low").alias("high"), "h", F.col("h").alias("root"), "block")
    pairs = materialise(_close(own.join(prints, "h"), least, deviations, False), "pairs")
    links = materialise(_verified(pairs, texts, shingle, least), "links")
    of = materialise(components(links).select(F.col("node").alias("h"), F.col("root")), "components")
    left = met.join(of, "h", "left").select("leader", "h", "blocks", "block", F.coalesce("root", "h").alias("root"))
    mixed = left.groupBy("leader").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).filter("a < b and n > 2")
    left = materialise(left.join(mixed.select("leader"), "leader"), "mixed")
    if not left.isEmpty():
        two = left.withColumn("other", F.explode(each)).select("leader", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "h", "root", "block")
        more = _close(two.join(prints, "h"), least, deviations, True).join(pairs, ["a", "b"], "left_anti")
        links = links.unionByName(materialise(_verified(more, texts, shingle, least), "links"))
        of = components(links).select(F.col("node").alias("h"), F.col("root"))
    return nodes.select("h", "first").join(of, "h", "left").select("h", "first", F.coalesce("root", "h").alias("root"))


def keep_first(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The row with the smallest doc_id of each component (of its texts, the one with
    the smallest hash), and of rows that repeat it the smallest. Other rows of its
    doc_id stay where they are the first of another component. Rows with a null
    doc_id are left out of the search and stay."""
    found = text_components(docs, least, shingle)
    kept = found.groupBy("root").agg(F.min(F.struct("first", "h")).alias("kept")).select(F.col("kept.first").alias("kept_id"), F.col("kept.h").alias("kept_h"))
    known = docs.filter("doc_id is not null").join(kept, (F.col("doc_id").cast("long") == F.col("kept_id")) & (F.xxhash64(whole_text()) == F.col("kept_h")))
    one = known.groupBy("kept_id", "kept_h").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return one.select("row.*").unionByName(docs.filter("doc_id is null"))
