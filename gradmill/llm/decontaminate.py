"""Benchmark decontamination with DataFrame operations only.

Test items become windows of ten normalised words; the hashes of the windows are a
broadcast set. A document's words are hashed once, and window hashes come from
them by doubling (2, 4, 8, then 10 words), inside arrays: no row leaves its
partition for that. Hits of a hash are verified against the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradmill.llm.common import bit_table, flags, materialise, whole_text

WINDOW = 10
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lowered, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. For an ASCII text lower()
    is the same as the translation and far cheaper."""
    plain = F.length(text) == F.octet_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BREAK), "")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n (words of the window) and words joined by spaces, distinct. An
    item of fewer words than a window is one window; one without words has none."""
    own = items.select("item_id", words(whole_text()).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    spans = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    return own.select("item_id", n.alias("n"), F.explode(spans).alias("gram")).distinct()


def _doubled(hashes: str, n: int) -> tuple[list[tuple[str, str]], str]:
    """SQL steps (name, expression) to the array of the hashes of n consecutive
    words, and the name of that array: it has size - n + 1 elements."""
    steps, have, name = [], 1, hashes
    powers = {1: hashes}
    while have * 2 <= n:
        nxt = f"h{have * 2}"
        steps.append((nxt, f"zip_with(slice({name}, 1, greatest(size({name}) - {have}, 0)), slice({name}, {have + 1}, greatest(size({name}) - {have}, 0)), (a, b) -> xxhash64(a, b))"))
        have *= 2
        name = nxt
        powers[have] = nxt
    for p in sorted(powers, reverse=True):
        if have + p <= n:
            nxt = f"h{have + p}"
            keep = f"greatest(size({name}) - {p}, 0)"
            steps.append((nxt, f"zip_with(slice({name}, 1, {keep}), slice({powers[p]}, {have + 1}, {keep}), (a, b) -> xxhash64(a, b))"))
            have += p
            name = nxt
    return steps, name


def _positions(name: str, hashes: list[int], n: int) -> Column:
    """(at, n) of the elements of the array that are in the set, from 1."""
    if not hashes:
        return F.array().cast("array<struct<at:int,n:int>>")
    among = ",".join(f"{h}L" if h >= 0 else f"({h}L)" for h in hashes)
    return F.expr(f"filter(transform({name}, (x, i) -> if(x IN ({among}), named_struct('at', i + 1, 'n', {n}), null)), y -> y is not null)")


def _joined_positions(rows: DataFrame, names: dict[int, str], keyed: dict[int, DataFrame]) -> DataFrame:
    """As _positions, by joins of hashes; row numbers repeat as the scan does."""
    found = None
    for n, name in names.items():
        known = bit_table(keyed[n])
        pairs = F.filter(F.transform(name, lambda x, i: F.struct((i + 1).alias("at"), x.alias("hash"))), lambda p: known(p["hash"]))
        one = rows.select("row", F.explode(pairs).alias("p")).select("row", "p.*").join(keyed[n], "hash").select("row", F.struct("at", F.lit(n).alias("n")).alias("hit"))
        found = one if found is None else found.unionByName(one)
    hits = found.groupBy("row").agg(F.collect_list("hit").alias("hits"))
    return rows.join(hits, "row", "left")


def _cover(acc: Column, hit: Column) -> Column:
    """Adds the words that a hit covers beyond the hits before it."""
    end = hit["at"] + hit["n"]
    return F.struct((acc["total"] + F.greatest(end - F.greatest(hit["at"], acc["upto"]), F.lit(0))).alias("total"), F.greatest(acc["upto"], end).alias("upto"))


def _located(text: DataFrame, items: DataFrame, window: int, most: int) -> tuple[DataFrame, DataFrame, bool, list[int]]:
    """text (with row, a number, and a text column) with w, its words, and hits, where
    hashes of windows of the items are in it; the windows; whether there are at most
    `most` (of all items, so that they can be broadcast); their sizes. With more, rows
    are numbered in a written table, as they are joined back by their numbers."""
    grams = materialise(benchmark_windows(items, window), "windows")
    few = grams.count() <= most
    if not few:
        text = materialise(text, "numbered")
    sizes = sorted(r["n"] for r in grams.select("n").distinct().collect())  # at most `window` numbers
    fields = text.columns
    rows = text.withColumn("w", words(whole_text()))
    rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    names = {}
    made = {"w", "h"}
    for n in sizes:
        steps, names[n] = _doubled("h", n)
        for name, expr in steps:
            if name not in made:
                rows = rows.withColumn(name, F.expr(expr))
                made.add(name)
    keyed = {}
    for n in sizes:
        one = grams.filter(F.col("n") == n).select("gram").distinct()
        one = one.withColumn("h", F.transform(F.split("gram", " "), lambda w: F.xxhash64(w)))
        for name, expr in _doubled("h", n)[0]:
            one = one.withColumn(name, F.expr(expr))
        keyed[n] = one.select(F.element_at(names[n], 1).alias("hash")).distinct()
    starts = F.array().cast("array<struct<at:int,n:int>>")
    if few:
        spans = [_positions(names[n], [r["hash"] for r in keyed[n].collect()], n) for n in sizes]
        rows = rows.withColumn("hits", F.concat(starts, *spans))
    else:
        rows = _joined_positions(rows, names, keyed)
    return rows.select(*fields, "w", "hits"), grams, few, sizes


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every
    document; docs may carry further columns, which are ignored. A null text has no
    words. Rows of equal doc_id are each scanned. An empty benchmark hits nothing, an empty
    table has no rows. Windows of items with a null item_id are hits, but name no item.

    The hashes of the windows are put into the plan as one set, and the windows are
    broadcast, where there are at most `most` of them. The hashes of a larger benchmark
    are joined as a table, to those windows of the documents that a small table of bits
    lets pass."""
    text = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    rows, grams, few, _ = _located(text, items, window, most)
    grams = grams.withColumn("real", F.lit(True))
    # verify: the words at each hit have to be a window
    candidates = rows.select(
        "row",
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.explode_outer(F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.array_join(F.slice("w", x["at"], x["n"]), " ").alias("gram")))).alias("hit"),
    ).select("row", "doc_id", "n_words", "hit.*")
    hint = F.broadcast if few else (lambda df: df)
    verified = candidates.join(hint(grams), ["n", "gram"], "left")
    per_item = verified.groupBy("row", "doc_id", "n_words").agg(
        F.collect_set("item_id").alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("real"), F.struct("at", "n")))).alias("hits"),
    )
    n_hit = F.aggregate("hits", F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto")), _cover, lambda acc: acc["total"])
    return per_item.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = 20_000) -> DataFrame:
    """All columns of docs, the text without the words that lie in windows of the
    items, from each word's beginning to its end; n_chars, where there is one, counts
    what is left. Texts without a hit stay as they are. Nulls stay null.

    The windows to verify against are put into the plan with at most `most` of them,
    else joined as in scan(), by a row number."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows, grams, few, sizes = _located(own, items, window, most)
    if few:
        known = [r["gram"] for r in grams.select("gram").distinct().collect()]  # `most` at most
        real = F.filter("hits", lambda x: F.array_join(F.slice("w", x["at"], x["n"]), " ").isin(known)) if known else F.filter("hits", lambda x: F.lit(False))
        rows = rows.withColumn("hits", real)
    else:
        one = rows.select("row", F.explode(F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.array_join(F.slice("w", x["at"], x["n"]), " ").alias("gram")))).alias("x")).select("row", "x.*")
        real = one.join(grams.select("n", "gram").distinct(), ["n", "gram"]).groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("real"))
        rows = rows.join(real, "row", "left").withColumn("hits", F.coalesce("real", F.array().cast("array<struct<at:int,n:int>>"))).drop("real")
    # words and what stands between them, in turn: text = gaps[0] w[0] gaps[1] w[1] ...
    rows = rows.withColumn("gaps", F.split("text", _WORD)).withColumn("original", F.array_remove(F.split("text", _BREAK_ANY), ""))
    marked = F.array_repeat(F.lit("0"), F.size("original"))
    for n in sizes:
        size = F.lit(n)
        at = F.array_distinct(F.transform(F.filter("hits", lambda x: x["n"] == size), lambda x: x["at"] - 1))
        marked = F.zip_with(marked, flags(at, F.size("original"), n), lambda a, b: F.greatest(a, b))
    left = F.zip_with(F.zip_with("original", marked, lambda w, m: F.when(m == "1", "").otherwise(w)), F.slice("gaps", 2, F.greatest(F.size("original"), F.lit(1))), lambda w, g: F.concat(w, F.coalesce(g, F.lit(""))))
    cut = F.concat(F.element_at("gaps", 1), F.array_join(left, ""))
    out = rows.withColumn("text", F.when(F.size("hits") > 0, cut).otherwise(F.col("text")))
    put = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.size("hits") > 0, F.length("text").cast("long")).otherwise(F.col("own.n_chars"))
    return out.select(*(put.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))
