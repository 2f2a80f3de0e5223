"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed to rows of an embedding table; a document
is the mean of its features' rows, a softmax layer gives the classes. Table and
layer are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled rows. The layer is linear in the mean, so for scoring the table
folds to one number for each row (its margin between the classes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradmill.llm.common import drawn_ids, ship, slices, text_bytes, whole_text
from gradmill.llm.textarrays import Texts

BITS = 18
NGRAMS = (3, 4)


def features(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row of the table, document) of every word and n-gram of characters (code
    points) of every document."""
    t = Texts(data, at)
    ids = [(t.word_hashes() >> np.uint64(64 - bits)).astype(np.int32)]
    docs = [t.doc_of_words()]
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters, with the end
    of = np.searchsorted(at, starts[:-1], "right") - 1
    for n in NGRAMS:
        if len(of) >= n:
            inside = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
            ids.append((t.hashes(starts[inside], starts[inside + n]) >> np.uint64(64 - bits)).astype(np.int32))
            docs.append(of[inside])
    return np.concatenate(ids), np.concatenate(docs)


class Classifier:
    """margin: what each feature adds to the log odds; bias: of no features."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.margin, self.bias = margin, bias

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        ids, docs = features(data, at)
        n = len(at) - 1
        total, count = np.bincount(docs, self.margin[ids], n), np.bincount(docs, minlength=n)
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def train(texts: list[str], y: np.ndarray, dim: int = 8, epochs: int = 8, rate: float = 0.5, batch: int = 16, seed: int = 7) -> Classifier:
    """The log odds of the labels where all labels agree or there are none."""
    size, rng = 1 << BITS, np.random.default_rng(seed)
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    bias = np.log(np.array([1 - share, share])).astype(np.float32)
    table = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    if len(np.unique(y)) < 2:
        return Classifier(np.zeros(size, np.float32), float(bias[1] - bias[0]))
    bags = []
    for text in texts:
        raw = text.encode()
        ids, _ = features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        rows, counts = np.unique(ids, return_counts=True)
        bags.append((rows, (counts / max(counts.sum(), 1)).astype(np.float32)))
    steps, step = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            mine = order[i : i + batch]
            now = rate * (1 - step / steps)
            step += 1
            rows = np.concatenate([bags[k][0] for k in mine])
            weight = np.concatenate([bags[k][1] for k in mine])[:, None]
            at = np.repeat(np.arange(len(mine)), [len(bags[k][0]) for k in mine])
            mean = np.zeros((len(mine), dim), np.float32)
            for d in range(dim):
                mean[:, d] = np.bincount(at, table[rows, d] * weight[:, 0], len(mine))
            out = mean @ layer + bias
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(mine)), y[mine].astype(int)] -= 1
            back = p @ layer.T
            layer -= now * mean.T @ p / len(mine)
            bias -= now * p.mean(axis=0)
            # a feature's step is scaled by its document's number of features, or long documents would not move it
            many = np.array([len(bags[k][0]) for k in mine], np.float32)[at][:, None]
            push = -now * 0.1 * np.minimum(weight * many, 4) * back[at]
            distinct, place = np.unique(rows, return_inverse=True)
            for d in range(dim):
                table[distinct, d] += np.bincount(place, push[:, d], len(distinct)).astype(np.float32)
    return Classifier((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def drawn_rows(docs: DataFrame, known: DataFrame, sample: int, longest: int, seed: int = 11) -> DataFrame:
    """doc_id, text and label of at most `sample` labelled rows, the first by a hash of
    doc_id, none of over `longest` characters: that bounds what the driver gets. The ids
    are drawn first, so only their texts move; of texts under one doc_id the smallest
    is taken, however many there are."""
    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).filter(F.length("text") <= longest)
    met = texts.join(F.broadcast(drawn_ids(known, sample, seed)), "doc_id")  # `sample` rows at most
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 6_000, longest: int = 50_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels has doc_id
    and quality. Learns from at most `sample` labelled rows (of at most `longest`
    characters each; scoring takes whole texts of any length) that are not held
    out; rows with a null label or doc_id are left out of the training. Null texts
    are empty, and empty texts score the learnt prior. A null doc_id is not held
    out; rows of equal doc_id are each scored, and learnt from once; an empty table has
    no rows. labels that are empty or all alike give every row their share."""
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label")).filter(~held)
    drawn = drawn_rows(docs, known, sample, longest).toPandas().sort_values(["doc_id", "text"])
    model = spark.sparkContext.broadcast(train(drawn["text"].tolist(), drawn["label"].to_numpy(float)))

    def score(batches):
        for batch in slices(batches):
            s = model.value.score(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return (
        docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
        .mapInArrow(score, "doc_id long, score double")
        .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
