"""Line dedup by pairwise alignment.

Every line is hashed, and every shortest run of consecutive lines with enough words
(from each line on, and up to each line). A line or run that another document has
links a document to the first one that has it, so a group of any size gives one pair
for each member and shared line or run, never all its pairs; a common block consists
of such runs, so a first document of each of its parts is met, also where its lines
come first in different documents. The two documents' line hashes are aligned with
patience diff (lines that are unique in both anchor the alignment), and aligned
common blocks of enough words are deleted from the later document. The first
document with a block always keeps it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradmill.llm.common import flags, materialise, ship

BLOCK_WORDS = 50


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ascending matched positions (in a, in b). Common ends are matched first, then
    the longest rising run of lines unique on both sides, then what lies between
    those in the same way; without such lines, equal ones in order from the front."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = _once(a, a0, a1), _once(b, b0, b1)
        pairs = sorted((i, in_b[k]) for k, i in in_a.items() if k in in_b)
        if not pairs:
            at: dict[int, list[int]] = {}
            for j in range(b0, b1):
                at.setdefault(b[j], []).append(j)
            low = b0 - 1
            for i in range(a0, a1):
                if spots := at.get(a[i]):
                    k = bisect_left(spots, low + 1)
                    if k < len(spots):
                        low = spots[k]
                        out.append((i, low))
            continue
        tops, ends, back = [], [], []
        for k, (_, j) in enumerate(pairs):
            pile = bisect_left(tops, j)
            tops[pile : pile + 1], ends[pile : pile + 1] = [j], [k]
            back.append(ends[pile - 1] if pile else -1)
        k, chain = ends[-1], []
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        last_a, last_b = a1, b1
        for i, j in chain:  # from the back
            out.append((i, j))
            todo.append((i + 1, last_a, j + 1, last_b))
            last_a, last_b = i, j
        todo.append((a0, last_a, b0, last_b))
    return sorted(out)


def _once(lines: list[int], low: int, high: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(low, high):
        seen[lines[i]] = -1 if lines[i] in seen else i
    return {k: i for k, i in seen.items() if i >= 0}


def common_lines(first: list[int], later: list[int], words: list[int], least: int) -> list[int]:
    """Positions of later's lines in aligned common blocks (consecutive on both
    sides; lines without words may stand between) of at least `least` words."""
    out: list[int] = []
    block: list[int] = []
    total, before = 0, (-2, -2)
    for i, j in [*patience(first, later), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if total >= least:
                out += block
            block, total = [], 0
        if j >= 0:
            block.append(j)
            total += words[j]
        before = (i, j)
    return out


def links(lines: np.ndarray, words: np.ndarray, least: int) -> list[int]:
    """Hashes of the lines with words, and of the shortest runs of two or more lines
    with at least `least` words that begin, or end, at each of those."""
    wordy = np.flatnonzero(words)
    before = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))  # words before each line
    out = set(lines[wordy].tolist())
    if before[-1] >= least:
        to = np.searchsorted(before, before[wordy] + least)
        since = np.searchsorted(before, before[wordy + 1] - least, "right") - 1
        runs = set(zip(wordy[to < len(before)].tolist(), to[to < len(before)].tolist()))
        runs |= set(zip(since[since >= 0].tolist(), (wordy[since >= 0] + 1).tolist()))
        raw = np.ascontiguousarray(lines, "<i8").tobytes()
        digests = [xxhash.xxh64_intdigest(raw[8 * i : 8 * j]) for i, j in runs if j - i > 1]
        out |= set(np.array(digests, np.uint64).view(np.int64).tolist())
    return list(out)


def dedup(docs: DataFrame, least_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of docs, with the text less the deleted lines, n_lines and
    n_removed. Lines are what \\n separates; lines without words match but are not
    looked up. A null text stays null and has no lines; an empty one has one line.
    Rows with a null doc_id are left as they are. A document is a doc_id with the hash
    of a text: different texts of one doc_id are different documents, in the order of
    their hashes, and rows that repeat both are one. Columns named n_lines or
    n_removed are replaced.

    Shuffles: hashes of lines and runs twice (24 bytes each), line lists of the
    documents that share some, and the texts once, to meet the lines to delete. A
    frequent line's first document meets many later ones in one join; that side is
    one row a key, so that Spark can split a partition of the other side."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), F.split("text", "\n", -1).alias("lines")).filter("doc_id is not null and lines is not null")
    words = F.transform("lines", lambda x: F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    rows = texts.select("doc_id", "part", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), words.alias("words"))

    def link(batches):
        for batch in batches:
            h, w = batch.column(2), batch.column(3)
            found = [links(a.values.to_numpy(), b.values.to_numpy(), least_words) for a, b in zip(h, w)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "part", "h", "words", "links"])

    rows = materialise(rows.mapInArrow(link, "doc_id long, part long, h array<long>, words array<int>, links array<long>"), "lines")
    keys = rows.select(F.struct("doc_id", "part").alias("own"), F.explode("links").alias("key"))
    firsts = keys.groupBy("key").agg(F.min("own").alias("first"), F.max("own").alias("last")).filter("first < last").select("key", "first")
    pairs = keys.join(firsts, "key").filter("first < own").select("own.*", F.col("first.doc_id").alias("first_id"), F.col("first.part").alias("first_part"))
    pairs = materialise(pairs.distinct(), "pairs")
    members = pairs.select("doc_id", "part").union(pairs.select("first_id", "first_part")).distinct()
    lists = rows.select("doc_id", "part", "h", "words").join(members, ["doc_id", "part"], "left_semi")
    lists = materialise(lists.dropDuplicates(["doc_id", "part"]), "lists")
    met = pairs.join(lists, ["doc_id", "part"]).join(lists.select(F.col("doc_id").alias("first_id"), F.col("part").alias("first_part"), F.col("h").alias("first_h")), ["first_id", "first_part"])

    def align(parts):
        for pdf in parts:
            found = [common_lines(first.tolist(), h.tolist(), words.tolist(), least_words) for first, h, words in zip(pdf["first_h"], pdf["h"], pdf["words"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "part": pdf["part"], "gone": found})

    gone = (
        met.select("doc_id", "part", "first_h", "h", "words")
        .mapInPandas(align, "doc_id long, part long, gone array<int>")
        .filter("size(gone) > 0")
        .groupBy("doc_id", "part")
        .agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    )
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = gone.select(F.col("doc_id").alias(name + "_id"), F.col("part").alias(name + "_part"), F.col("gone").alias(name))
    out = docs.join(gone, (docs["doc_id"].cast("long") == gone[name + "_id"]) & (F.xxhash64(docs["text"]) == gone[name + "_part"]), "left")
    parts = F.split("text", "\n", -1)
    marks = F.zip_with(parts, flags(F.col(name), F.size(parts)), lambda x, m: F.struct(x.alias("line"), m.alias("gone")))
    kept = F.array_join(F.filter(marks, lambda x: x["gone"] == "0")["line"], "\n")
    return out.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"),
            "n_removed": F.coalesce(F.size(name), F.lit(0)).cast("long"),
            "text": F.when(F.col(name).isNull(), F.col("text")).when(F.size(name) == F.size(parts), "").otherwise(kept),
        }
    ).drop(name, name + "_id", name + "_part")
