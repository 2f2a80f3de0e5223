"""Quality rules: base rules and boosted trees over document statistics.

The trees are grown in numpy on a bounded sample of labelled rows, with monotonic
constraints on chosen statistics, and flattened into node arrays that score all
rows of a batch level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradmill.llm.common import drawn_ids, materialise, ship, slices, text_bytes, whole_text
from gradmill.llm.textarrays import Texts, mix, repeated

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_MARK = np.isin(np.arange(256), list(b"!?"))
#: (statistic, -1 where quality may only fall as it grows, 1 where only rise, 0 free)
STATISTICS = (
    ("log_words", 0),
    ("mean_word", 0),
    ("symbols_a_word", -1),
    ("dup_line_share", -1),
    ("repeat_share", -1),
    ("upper_share", -1),
    ("marks_a_word", -1),
    ("digit_share", 0),
    ("short_words", 0),
    ("words_a_line", 0),
    ("distinct_words", 0),
)
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def statistics(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The base counts of each document, and its row of STATISTICS."""
    t = Texts(data, at)
    docs, words = t.doc_of_words(), t.word_hashes()
    chars = (data & 0xC0) != 0x80
    word_chars, n_symbols = t.per_doc(chars & t.ink), t.per_doc(_SYMBOLS[data])
    starts, ends, owner = t.lines()
    _, later = repeated(mix(t.hashes(starts, ends) + owner.astype(np.uint64)))
    n_lines, n_dup = (np.bincount(owner, w, t.docs).astype(np.int64) for w in (None, later))
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= 8:
        w = words
        for k in (1, 2, 4):
            w = mix(w[:-k] * np.uint64(3) + w[k:])
        inside = np.flatnonzero(docs[7:] == docs[:-7])
        again = inside[repeated(mix(w[inside] + docs[inside].astype(np.uint64)))[0]]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 8, -1)
    n_repeat = t.per_doc_words(np.cumsum(covered[:-1]) > 0)
    once = ~repeated(mix(words + docs.astype(np.uint64)))[1]
    n = np.maximum(t.n_words, 1)
    per_char = np.maximum(word_chars, 1)
    rows = np.stack(
        [
            np.log1p(t.n_words),
            word_chars / n,
            n_symbols / n,
            n_dup / np.maximum(n_lines, 1),
            n_repeat / n,
            t.per_doc(_UPPER[data]) / per_char,
            t.per_doc(_MARK[data]) / n,
            t.per_doc(_DIGIT[data]) / per_char,
            t.per_doc_words(t.ends - t.starts <= 3) / n,
            t.n_words / np.maximum(n_lines, 1),
            t.per_doc_words(once) / n,
        ],
        axis=1,
    )
    return [t.n_words, word_chars, n_symbols, n_dup, n_repeat], rows.astype(np.float32)


class Trees:
    """Complete binary trees of one depth as arrays (trees, nodes): a node that
    does not split has the threshold infinity, so that its rows go left."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range((len(feature) + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: int = 8) -> Trees:
    """Boosting on the logistic loss with histogram splits. A split on a constrained
    statistic has to order its children's values by the sign, and their values
    bound what grows below each of them, so the sum is monotonic in it."""
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if not len(y):
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    out, all_f, all_t, all_l = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        rows, bounds, value = {0: np.arange(len(y))}, {0: (-np.inf, np.inf)}, {}
        for node in range(2 * inner + 1):
            mine, (low, high) = rows[node], bounds[node]
            value[node] = float(np.clip(g[mine].sum() / (h[mine].sum() + ridge), low, high))
            if node >= inner:
                continue
            best, g_all, h_all = (1e-6, None), g[mine].sum(), h[mine].sum()
            for j, e in enumerate(edges):
                if not len(e) or len(mine) < 2 * least:
                    continue
                gs, hs, ns = (np.cumsum(np.bincount(codes[mine, j], w, len(e) + 1))[:-1] for w in (g[mine], h[mine], None))
                left, right = np.clip(gs / (hs + ridge), low, high), np.clip((g_all - gs) / (h_all - hs + ridge), low, high)
                gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
                gain[(ns < least) | (len(mine) - ns < least) | (signs[j] * (right - left) < 0)] = 0
                if gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (j, k, float(left[k]), float(right[k])))
            a, b = 2 * node + 1, 2 * node + 2
            rows[a], rows[b], bounds[a], bounds[b] = mine, mine[:0], (low, high), (low, high)
            if best[1]:
                j, k, left, right = best[1]
                feature[node], threshold[node] = j, edges[j][k]
                goes = codes[mine, j] > k
                rows[a], rows[b] = mine[~goes], mine[goes]
                if signs[j]:
                    middle = (left + right) / 2
                    bounds[a], bounds[b] = ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle))
        leaf = np.array([value[n] * rate if len(rows[n]) else 0.0 for n in range(inner, 2 * inner + 1)])
        for n in range(inner, 2 * inner + 1):
            out[rows[n]] += leaf[n - inner]
        all_f.append(feature), all_t.append(threshold), all_l.append(leaf)
    return Trees(np.array(all_f), np.array(all_t), np.array(all_l), base)


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (the trees' probability) and
    kept of every document. A null text is empty (no words: it fails the base
    rules); rows of equal doc_id are each judged; an empty table has no rows. `labels`
    has doc_id and quality; rows with a null in either are left out, and of rows that
    repeat a doc_id one counts. The trees learn from at most `sample` labelled rows, the
    first by a hash of doc_id; with no labelled row they keep what the base rules keep.
    One pass reads the texts."""
    spark = docs.sparkSession
    ship(spark)

    def measure(batches):
        for batch in slices(batches):
            base, rows = statistics(*text_bytes(batch.column(1)))
            stats = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, base), stats], names=["doc_id", *(c.split()[0] for c in _BASE.split(", ")), "stats"])

    found = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(measure, f"doc_id long, {_BASE}, stats array<float>")
    found = materialise(found, "statistics")
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label"))
    picked = F.broadcast(drawn_ids(known, sample, 9))  # `sample` rows at most
    drawn = found.join(picked, "doc_id").groupBy("doc_id").agg(F.min(F.struct("stats", "label")).alias("own")).select("doc_id", "own.*").toPandas().sort_values("doc_id")
    x = np.array(drawn["stats"].tolist(), np.float32).reshape(-1, len(STATISTICS))
    model = spark.sparkContext.broadcast(grow(x, drawn["label"].to_numpy(float), [s for _, s in STATISTICS]))

    def score(parts):
        for pdf in parts:
            rows = np.array(pdf.pop("stats").tolist(), np.float32).reshape(-1, len(STATISTICS))
            failed = (pdf["n_words"] < 20) | (100 * pdf["n_repeat_words"] > 30 * pdf["n_words"])
            quality = model.value.score(rows)
            yield pdf.assign(base_failed=failed, quality=quality, kept=~failed & (quality >= threshold))

    return found.mapInPandas(score, f"doc_id long, {_BASE}, base_failed boolean, quality double, kept boolean")
