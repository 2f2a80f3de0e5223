"""Removal of repeated byte strings by longest-previous-factor arrays.

A position repeats an earlier (later) one if its longest previous (next) factor has
at least `length` bytes: in suffix order the nearest entries with a smaller
(greater) text position share that many leading bytes with it. Suffixes are sorted
in slices: a range sort on (leading bytes, text position) lays the suffix array out
over partitions, each partition looks at its neighbours, and the first and last
rows of partitions (two for each) link the slices. Since only factors of `length`
bytes count, suffixes are sorted by that many bytes.

Sorting all suffixes would move every text hundreds of times, so the order is
refined from coarse to fine, and only suffixes that can still have a partner go on:

1.  A window of `length` bytes is named after the position of the smallest hash of
    its `GRAM`-byte strings. Windows that share that anchor are one row: their whole
    context (all bytes of these windows) is sorted by its fingerprint. A context that
    recurs makes all its windows repeats; an anchor string that does not recur ends
    them. This settles nearly all the text.
2.  The others are cut into blocks of at most `BLOCK` windows at fixed distances to
    the anchor, with the bytes that all windows of a block share (its core) as a
    fingerprint and the few bytes around it as they are. Blocks are settled likewise.
3.  What is left is sorted suffix by suffix: the core, the distance, then the bytes
    around the core, which is all that can differ.

Equal fingerprints (two 64-bit hashes) are taken as equal bytes.

Many passages that repeat are shorter than that in bytes. passages() counts the words in
runs of over 50 words that another document has too, by the same anchors over words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradmill.llm.common import bit_table, materialise, ship, slices, text_bytes, whole_text
from gradmill.llm.textarrays import Texts, mix, powers

LENGTH, GRAM, BLOCK = 400, 64, 16
#: Words of a passage, and of the strings that anchor it.
WORDS, WORD_GRAM = 51, 8
_TABLES = [np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) for seed in (1, 2)]


class Prints:
    """64-bit fingerprints of any spans of a sequence, by prefix sums of its elements'
    random values times powers of an odd number."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1])))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(mix(h) + (ends - starts).astype(np.uint64)).view(np.int64)


def byte_prints(data: np.ndarray, table: int) -> Prints:
    return Prints(_TABLES[table][data])


def word_prints(t: Texts) -> tuple[Prints, Prints]:
    h = t.word_hashes()
    return Prints(h), Prints(mix(h ^ _TABLES[1][0]))


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """The first place of the smallest value of each window of v."""
    at, done = np.arange(len(v), dtype=np.int32), 1
    while done < width:
        step = min(done, width - done)
        right = v[step:] < v[:-step]
        at, v, done = np.where(right, at[step:], at[:-step]), np.where(right, v[step:], v[:-step]), done + step
    return at


def anchors(one: Prints, two: Prints, at: np.ndarray, length: int, gram: int):
    """(document, first window, windows, anchor position, gram print, context print)
    of the runs of windows with one anchor, over all documents of a sequence; at: where
    each begins, with the end."""
    total = int(at[-1])
    if total < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    g = np.arange(total - gram + 1)
    grams = one(g, g + gram)
    spot = sliding_argmin(grams, length - gram + 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(spot)]
    window = np.flatnonzero(g[: len(spot)] + length <= at[doc + 1])
    spot, doc = spot[window], doc[window]
    new = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (doc[1:] != doc[:-1])))) if len(spot) else np.zeros(0, int)
    first, count = window[new], np.diff(np.append(new, len(spot)))
    spot, doc = spot[new].astype(np.int64), doc[new]
    return doc, first, count, spot, grams[spot], two(first, first + count - 1 + length)


def blocks(data: np.ndarray, first: np.ndarray, count: np.ndarray, spot: np.ndarray, length: int = LENGTH, size: int = BLOCK):
    """Rows of the blocks of runs of windows: (run, smallest and largest distance of
    a window to the anchor, two prints of the core, what stands before and after the
    core, each as two numbers of eight bytes)."""
    near, far = spot - first - count + 1, spot - first
    n = far // size - near // size + 1
    run = np.repeat(np.arange(len(first)), n)
    q = near[run] // size + np.arange(len(run)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    low, high = np.maximum(near[run], q * size), np.minimum(far[run], q * size + size - 1)
    begin = spot[run] - q * size
    end = begin - size + 1 + length
    one, two = byte_prints(data, 0)(begin, end), byte_prints(data, 1)(begin, end) ^ q
    span = np.arange(16)
    put = lambda a, b: _pack(np.where(span < (b - a)[:, None], data[np.minimum(a[:, None] + span, len(data) - 1)], 0).astype(np.uint8))
    return run, low, high, one, two, *put(spot[run] - high, begin), *put(end, spot[run] - low + length)


def _pack(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = np.ascontiguousarray(rows).view(">i8").astype(np.int64).reshape(-1, 2)
    return wide[:, 0], wide[:, 1]


def _unpack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a, b], axis=1).astype(">i8").view(np.uint8).reshape(-1, 16)


def windows(low, high, left, right, size: int = BLOCK):
    """(row, distance, two numbers) of every window of block rows: the bytes of the
    window around the core, size - 1 of them."""
    n = high - low + 1
    row = np.repeat(np.arange(len(low)), n)
    i = low[row] + np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    before = i % size  # bytes of the window before the core; size - 1 - before after it
    held = high[row] % size  # bytes before the core that the block row has
    k = np.arange(16)
    at = np.where(k < before[:, None], (held - before)[:, None] + k, 0)
    sig = np.where(k < before[:, None], left[row[:, None], at], 0)
    after = k - before[:, None]
    sig = np.where((after >= 0) & (after < (size - 1 - before)[:, None]), right[row[:, None], np.clip(after, 0, 15)], sig)
    return row, i, *_pack(sig.astype(np.uint8))


def suffix_slices(df: DataFrame, part: list[str], full: list[str], position: list[str], first_too: bool) -> DataFrame:
    """Sorts rows of whole numbers by full (part is a beginning of it) and position
    in slices, and keeps the rows with a neighbour that is equal in part. Adds
    earlier and later (a neighbour before or after is equal in full: the previous
    or next smaller position in suffix order has all the bytes) and goes_on (another
    full key with this part stands beside). first_too: the first row of each full
    key goes on as well."""
    names, spark = df.columns, df.sparkSession
    keys = full + position
    flags = ["prev_full", "prev_part", "next_full", "next_part"]
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)

    def run(batches):
        slice_no, held, was = TaskContext.get().partitionId(), None, (False, False)
        begun = False

        def out(batch, pf, pp, nf, np_, edge):
            cols = [*batch.columns, *(pa.array(x) for x in (pf, pp, nf, np_)), pa.array(np.full(batch.num_rows, slice_no, np.int32)), pa.array(edge)]
            return pa.RecordBatch.from_arrays(cols, names=[*names, *flags, "slice", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            cols = {k: both.column(names.index(k)).to_numpy(zero_copy_only=False) for k in full}
            same = lambda ks: np.logical_and.reduce([cols[k][1:] == cols[k][:-1] for k in ks])
            sf, sp = same(full), same(part)
            pf, pp = np.append(was[0], sf), np.append(was[1], sp)
            edge = np.zeros(both.num_rows - 1, np.int32)
            if len(edge) and not begun:
                edge[0], begun = 1, True
            keep = pp[:-1] | sp | (edge > 0)
            mask = pa.array(keep)
            if keep.any():
                yield out(both.slice(0, both.num_rows - 1).filter(mask), pf[:-1][keep], pp[:-1][keep], sf[keep], sp[keep], edge[keep])
            held, was = both.slice(both.num_rows - 1), (bool(pf[-1]), bool(pp[-1]))
        if held is not None:
            no = np.zeros(1, bool)
            yield out(held, np.array([was[0]]), np.array([was[1]]), no, no, np.array([2 if begun else 3], np.int32))

    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialise(rows.mapInArrow(run, f"{schema}, {', '.join(f'{f} boolean' for f in flags)}, slice int, edge int"), "slices")
    ends = sorted(rows.filter("edge > 0").select("slice", "edge", *full).collect())  # two rows of each slice
    fix = {f: [] for f in flags}
    for a, b in zip(ends[:-1], ends[1:]):
        if a["slice"] != b["slice"]:
            for kind, ks in (("full", full), ("part", part)):
                if all(a[k] == b[k] for k in ks):
                    fix[f"next_{kind}"].append(a["slice"])
                    fix[f"prev_{kind}"].append(b["slice"])
    for f in flags:
        if fix[f]:
            rows = rows.withColumn(f, F.col(f) | (F.col("slice").isin(fix[f]) & F.col("edge").isin([1, 3] if f.startswith("prev") else [2, 3])))
    on = (F.col("prev_part") & ~F.col("prev_full")) | (F.col("next_part") & ~F.col("next_full"))
    if first_too:
        on = on | (~F.col("prev_full") & (F.col("prev_part") | F.col("next_part")))
    return rows.filter("prev_part or next_part").select(*names, F.col("prev_full").alias("earlier"), F.col("next_full").alias("later"), on.alias("goes_on"))


def repeats(keyed: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """d, th, begin, end: spans that cover the bytes of repeated strings, of rows with
    d, th (whole numbers that name a text) and text. keep_first: of strings that
    occur earlier."""
    spark = keyed.sparkSession
    ship(spark)

    def find(batches):
        for batch in slices(batches):
            data, at = text_bytes(batch.column(2))
            doc, first, count, spot, g, c = anchors(byte_prints(data, 0), byte_prints(data, 1), at, length, GRAM)
            base, ids = at[doc], pa.array(doc)
            cols = [batch.column(0).take(ids), batch.column(1).take(ids), pa.array((first - base).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array((spot - base).astype(np.int32)), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "th", "first", "count", "spot", "g", "c"])

    runs = materialise(keyed.select("d", "th", "text").mapInArrow(find, "d long, th long, first int, count int, spot int, g long, c long"), "runs")
    runs = suffix_slices(runs, ["g"], ["g", "c"], ["d", "th", "first"], keep_first)
    hit = F.col("earlier") if keep_first else F.col("earlier") | F.col("later")
    spans = runs.filter(hit).select("d", "th", F.col("first").alias("begin"), (F.col("first") + F.col("count") - 1 + length).alias("end"))

    def refine(batches):
        for batch in slices(batches, column="text"):
            data, at = text_bytes(batch.column(2))
            of = batch.column(3)
            sizes = np.diff(np.asarray(of.offsets))
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            flat = of.flatten()
            first, count, spot = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
            run, *cols = blocks(data, first + at[doc], count, spot + at[doc], length)
            ids = pa.array(doc[run])
            cols = [batch.column(0).take(ids), batch.column(1).take(ids), pa.array(spot[run].astype(np.int32)), *(pa.array(x.astype(np.int32)) for x in cols[:2]), *(pa.array(x) for x in cols[2:])]
            yield pa.RecordBatch.from_arrays(cols, names=block_names)

    block_names = ["d", "th", "spot", "low", "high", "k1", "k2", "l1", "l2", "r1", "r2"]
    open_runs = runs.filter("goes_on").groupBy("d", "th").agg(F.collect_set(F.struct("first", "count", "spot")).alias("runs"))  # of one text
    texts = keyed.select("d", "th", "text").join(open_runs, ["d", "th"]).select("d", "th", "text", "runs")
    cut = materialise(texts.mapInArrow(refine, "d long, th long, spot int, low int, high int, k1 long, k2 long, l1 long, l2 long, r1 long, r2 long"), "blocks")
    cut = suffix_slices(cut, ["k1", "k2"], ["k1", "k2", "low", "high", "l1", "l2", "r1", "r2"], ["d", "th", "spot"], keep_first)
    spans = spans.unionByName(cut.filter(hit).select("d", "th", (F.col("spot") - F.col("high")).alias("begin"), (F.col("spot") - F.col("low") + length).alias("end")))

    def spread(batches):
        for batch in batches:
            col = {n: batch.column(k).to_numpy() for k, n in enumerate(block_names)}
            row, i, s1, s2 = windows(col["low"].astype(np.int64), col["high"].astype(np.int64), _unpack(col["l1"], col["l2"]), _unpack(col["r1"], col["r2"]))
            cols = [*(col[n][row] for n in ("d", "th", "spot")), i.astype(np.int32), col["k1"][row], col["k2"][row], s1, s2]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["d", "th", "spot", "i", "k1", "k2", "s1", "s2"])

    last = materialise(cut.filter("goes_on").select(*block_names).mapInArrow(spread, "d long, th long, spot int, i int, k1 long, k2 long, s1 long, s2 long"), "windows")
    last = suffix_slices(last, ["k1", "k2", "i"], ["k1", "k2", "i", "s1", "s2"], ["d", "th", "spot"], False)
    return spans.unionByName(last.filter(hit).select("d", "th", (F.col("spot") - F.col("i")).alias("begin"), (F.col("spot") - F.col("i") + length).alias("end")))


def passages(keyed: DataFrame, words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """d, th, n_passage_words: how many words of a text are in strings of `words` words
    that another text or doc_id has too, of rows as in repeats(). Texts without such
    words have no row; rows that repeat d and th are one text.

    Windows with one anchor are a row, as above; equal ones of a text are one, with all
    their places. Anchors of one text end there; contexts that two texts have are
    passages as a whole. Of the others those go on that share, with another text, the
    anchor and the `side` words before it, or those after it: two contexts with a window
    in common do, as half of what the window has beyond the anchor is on one side. Their
    single windows are compared, and those of one of each shared context."""
    ship(keyed.sparkSession)
    side = (words - gram + 1) // 2

    def find(batches):
        for batch in slices(batches):
            t = Texts(*text_bytes(batch.column(2)))
            one, two = word_prints(t)
            doc, first, count, spot, g, c = anchors(one, two, t.word_at, words, gram)
            order = np.lexsort((first, c, g, doc))
            new = np.flatnonzero(np.concatenate(([True], (np.diff(doc[order]) != 0) | (np.diff(g[order]) != 0) | (np.diff(c[order]) != 0)))) if len(doc) else np.zeros(0, int)
            lead = order[new]
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(order)).astype(np.int32)), pa.array((first - t.word_at[doc])[order].astype(np.int32)))
            doc, first, count, spot, g, c = (x[lead] for x in (doc, first, count, spot, g, c))
            before, after = spot - first >= side, spot - first - count + 1 < side  # whether a window has that many words on the side
            a = two(np.where(before, spot - side, spot), spot + gram)
            b = two(spot, np.where(after, spot + gram + side, spot + gram))
            ids = pa.array(doc)
            cols = [batch.column(0).take(ids), batch.column(1).take(ids), places, pa.array(count.astype(np.int32)), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(a, mask=~before), pa.array(b, mask=~after)]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "th", "places", "count", "g", "c", "a", "b"])

    def single(batches):
        for batch in slices(batches):
            t = Texts(*text_bytes(batch.column(2)))
            one, two = word_prints(t)
            of = batch.column(3)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(of.offsets)))
            flat = of.flatten()
            first, count = (np.asarray(flat.field(k)).astype(np.int64) for k in range(2))
            again = np.repeat(np.arange(len(doc)), count)
            i = first[again] + np.arange(len(again)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
            at = i + t.word_at[doc[again]]
            shared = np.asarray(flat.field(2))[again] if len(doc) else np.zeros(0, bool)
            cols = [batch.column(0).take(pa.array(doc[again])), batch.column(1).take(pa.array(doc[again])), pa.array(i.astype(np.int32)), pa.array(one(at, at + words)), pa.array(two(at, at + words)), pa.array(shared)]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "th", "i", "k1", "k2", "shared"])

    rows = keyed.select("d", "th", "text").mapInArrow(find, "d long, th long, places array<int>, count int, g long, c long, a long, b long")
    runs = materialise(rows, "runs")
    ends = [F.min(F.struct("d", "th")).alias("low"), F.max(F.struct("d", "th")).alias("high")]
    met = materialise(runs.groupBy("g").agg(*ends).filter("low < high").select("g"), "anchors")  # a table of its own, so that Spark can split the join of a frequent anchor
    runs = materialise(runs.join(met, "g"), "met")
    same = runs.groupBy("g", "c").agg(*ends, F.min(F.struct("d", "th", "places", "count", "a", "b")).alias("own"))
    same = materialise(same.filter("low < high").select("g", "c", "own"), "same")
    spans = runs.join(same.select("g", "c"), ["g", "c"]).select("d", "th", F.explode("places").alias("begin"), "count")
    spans = spans.select("d", "th", "begin", (F.col("begin") + F.col("count") - 1 + words).alias("end"))
    apart = runs.join(same, ["g", "c"], "left_anti").select("d", "th", "places", "count", "a", "b", F.lit(False).alias("shared"))
    apart = apart.unionByName(same.select("own.*", F.lit(True).alias("shared")))
    sided = apart.withColumn("key", F.explode(F.array_compact(F.array("a", "b"))))
    also = sided.groupBy("key").agg(*ends, F.max("shared").alias("any"), F.min("shared").alias("all")).filter("not all and (low < high or any)").select("key")
    also = materialise(also, "sides")
    left = sided.join(also, "key").select("d", "th", F.explode("places").alias("first"), "count", "shared")
    listed = materialise(left.groupBy("d", "th").agg(F.collect_set(F.struct("first", "count", "shared")).alias("runs")), "listed")  # of one text
    among = bit_table(listed.select(F.xxhash64("d", "th").alias("hash")))
    text = keyed.select("d", "th", "text").filter(among(F.xxhash64("d", "th")))
    alone = text.join(listed, ["d", "th"]).select("d", "th", "text", "runs").mapInArrow(single, "d long, th long, i int, k1 long, k2 long, shared boolean")
    alone = materialise(alone, "windows")
    again = alone.groupBy("k1", "k2").agg(*ends, F.max("shared").alias("any")).filter("low < high or any").select("k1", "k2")
    again = materialise(again, "again")
    spans = spans.unionByName(alone.filter("not shared").join(again, ["k1", "k2"]).select("d", "th", F.col("i").alias("begin"), (F.col("i") + words).alias("end")))
    begun = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    cover = lambda acc, x: F.struct((acc["total"] + F.greatest(x["end"] - F.greatest(x["begin"], acc["upto"]), F.lit(0))).alias("total"), F.greatest(acc["upto"], x["end"]).alias("upto"))
    found = spans.groupBy("d", "th").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))  # of one text
    return found.select("d", "th", F.aggregate("spans", begun, cover)["total"].cast("long").alias("n_passage_words"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; not
    always whole UTF-8) and n_passage_words (see passages()) of every document. A null text is empty; matches never
    reach over documents, texts under `length` bytes lose nothing. Rows of equal
    doc_id are documents of their own; repeated rows are copies of each other. With
    keep_first the first copy of a string (by doc_id, then place) stays."""
    spark = docs.sparkSession
    ship(spark)
    text = whole_text()
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"d": F.coalesce("doc_id", F.lit(-(1 << 63))), "th": F.xxhash64("text")})
    spans = repeats(keyed, length, keep_first).groupBy("d", "th").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # of one text
    shared = passages(keyed)

    def cut(batches):
        for batch in slices(batches, 8 << 20):
            out, of = [], batch.column(2)
            ends, flat = np.asarray(of.offsets), of.flatten()
            begin, end = (np.asarray(flat.field(k)) for k in range(2))
            data, at = text_bytes(batch.column(1))
            ends = ends - ends[0]
            for k in range(batch.num_rows):
                own = data[at[k] : at[k + 1]]
                a, b = begin[ends[k] : ends[k + 1]], end[ends[k] : ends[k + 1]]
                n = spans_ = 0
                if len(a):
                    depth = np.zeros(len(own) + 1, np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, b, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    n, spans_ = int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
                    kept = own[~gone].tobytes()
                else:
                    kept = own.tobytes()
                out.append((len(own), n, spans_, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds)), batch.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_words"])

    none = F.array().cast("array<struct<begin:int,end:int>>")
    rows = keyed.join(spans, ["d", "th"], "left").join(shared, ["d", "th"], "left")
    rows = rows.select("doc_id", "text", F.coalesce("spans", none).alias("spans"), F.coalesce("n_passage_words", F.lit(0).cast("long")).alias("n_passage_words"))
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passage_words long")
