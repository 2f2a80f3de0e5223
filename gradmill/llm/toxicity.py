"""Toxicity: a support vector machine on a subsequence string kernel.

Two strings are alike to the kernel by the character subsequences they share, each
weighted down by the gaps it spans, so an insult keeps most of its likeness with
inserted or left-out characters, and with any ending. Nyström landmarks turn the
kernel into a few features for each word; a linear machine over them is trained on
labelled sentences: every sentence of a clean document is clean, and of a toxic
document the sentence that the machine finds worst is toxic (the others are left
out, as the label says nothing about them). A sentence is as toxic as its worst
word, a document as its worst sentence.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradmill.llm.common import ship, slices, text_bytes, whole_text
from gradmill.llm.quality_classifier import drawn_rows
from gradmill.llm.textarrays import Texts

ORDER, DECAY = 4, 0.7
#: Bytes of a word that the kernel sees at once; longer words are seen in overlapping parts.
PART = 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SENTENCE = re.compile(r"[.!?]\s|\n")


def _common(same: Callable[[int], np.ndarray], deep: int, shape: tuple[int, ...]) -> np.ndarray:
    """Weighted common subsequences of ORDER bytes, of pairs laid out as shape[1:].
    same(x): whether byte x of the one string is each of the shape[0] bytes of the other.
    For each order below, the state holds the sums over all beginnings of the other
    string for the one string up to x; gaps after a subsequence decay as x goes on."""
    wide, rest, decay = shape[0], shape[1:], np.float32(DECAY)
    total = np.zeros(rest, np.float32)
    state = [np.ones((wide + 1, *rest), np.float32)] + [np.zeros((wide + 1, *rest), np.float32) for _ in range(1, ORDER)]
    hit, gain, carry = np.empty(shape, np.float32), np.empty(shape, np.float32), np.empty(rest, np.float32)
    for x in range(deep):
        np.multiply(same(x), decay * decay, out=hit)
        for order in range(ORDER, 0, -1):
            np.multiply(hit, state[order - 1][:wide], out=gain)
            if order == ORDER:
                total += gain.sum(axis=0)
                continue
            for y in range(1, wide):
                np.multiply(gain[y - 1], decay, out=carry)
                gain[y] += carry
            now = state[order][1:]
            now *= decay
            now += gain
    return total


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Subsequence kernel of order ORDER between rows of s (n, width) and of t
    (m, width), uint8 padded with 0. Gives (n, m)."""
    columns = np.ascontiguousarray(t.T)[:, None, :]
    same = lambda x: (columns == s[None, :, x, None]) & (s[None, :, x, None] != 0)
    return _common(same, s.shape[1], (t.shape[1], len(s), len(t)))


def self_kernel(s: np.ndarray) -> np.ndarray:
    """k(row, row) of each row of s."""
    columns = np.ascontiguousarray(s.T)
    return _common(lambda x: (columns == columns[x]) & (columns[x] != 0), s.shape[1], columns.shape)


def padded(words: list[bytes]) -> np.ndarray:
    wide = max(map(len, words), default=1) or 1
    return np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)


def likeness(s: np.ndarray, landmarks: list[bytes], block: int = 256) -> np.ndarray:
    """Normalised kernel of rows of s to the landmarks; rows under ORDER bytes get 0.
    Rows are taken by length, so that short ones cost little."""
    t = padded(landmarks)
    own = np.sqrt(self_kernel(t))
    out = np.zeros((len(s), len(landmarks)), np.float32)
    length = (s != 0).sum(axis=1)
    order = np.argsort(length, kind="stable")
    for i in range(0, len(order), block):
        mine = order[i : i + block]
        rows = s[mine, : max(int(length[mine[-1]]), 1)]
        norm = np.sqrt(self_kernel(rows))[:, None] * own[None, :]
        out[mine] = np.divide(kernel(rows, t), norm, out=np.zeros((len(mine), len(t)), np.float32), where=norm > 0)
    return out


class Machine:
    """weight: of each landmark's likeness (the Nyström map is folded in); blend:
    of what a document's words show (see evidence)."""

    def __init__(self, landmarks: list[bytes], weight: np.ndarray, bias: float, blend: np.ndarray):
        self.landmarks, self.weight, self.bias, self.blend = landmarks, weight, bias, blend
        self.known_key, self.known_value = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def words(self, s: np.ndarray) -> np.ndarray:
        if not len(self.landmarks):
            return np.full(len(s), self.bias, np.float32)
        return likeness(s, self.landmarks) @ self.weight + self.bias

    def probability(self, shown: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(shown @ self.blend, -60, 60)))

    def documents(self, data: np.ndarray, at: np.ndarray, most: int = 4_000_000) -> np.ndarray:
        """What the words of each document show. Values of words are kept by their
        hash, of at most `most` words."""
        t = Texts(_LOWER[data], at)
        starts, ends, docs = parts(t)
        keys = t.hashes(starts, ends)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known_key, distinct)
        seen = np.zeros(len(distinct), bool)
        inside = place < len(self.known_key)
        seen[inside] = self.known_key[place[inside]] == distinct[inside]
        value = np.zeros(len(distinct), np.float32)
        value[seen] = self.known_value[place[seen]]
        fresh = np.flatnonzero(~seen)
        if len(fresh):
            a, b = starts[first[fresh]], ends[first[fresh]]
            span = np.arange(PART)
            rows = t.data[np.minimum(a[:, None] + span, len(data) - 1)]
            rows[span >= (b - a)[:, None]] = 0
            value[fresh] = self.words(rows)
            if len(self.known_key) + len(fresh) > most:
                self.known_key, self.known_value = np.zeros(0, np.uint64), np.zeros(0, np.float32)
            new = np.concatenate((self.known_key, distinct[fresh]))
            order = np.argsort(new, kind="stable")
            self.known_key, self.known_value = new[order], np.concatenate((self.known_value, value[fresh]))[order]
        return evidence(value[back], docs, t.docs)


def evidence(value: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Rows of (1, the worst value, log of the words beyond the margin, log of
    their share), of documents by their words' values; no words: as if all were
    far on the clean side."""
    worst = np.full(n, -1.5)
    np.maximum.at(worst, docs, np.clip(value, -1.5, 1.5))
    beyond, words = np.bincount(docs, value > 0.5, n), np.bincount(docs, minlength=n)
    return np.stack([np.ones(n), worst, np.log1p(beyond), np.log(beyond / np.maximum(words, 1) + 1e-3)], axis=1)


def parts(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the words, with white space between single
    characters taken as a part of the word (spelled-out words), without marks at
    the ends, and long ones as overlapping parts."""
    starts, ends, docs = t.starts, t.ends, t.doc_of_words()
    if len(starts):
        single = ends - starts == 1
        joins = single[1:] & single[:-1] & (docs[1:] == docs[:-1])
        starts, docs, ends = starts[np.concatenate(([True], ~joins))], docs[np.concatenate(([True], ~joins))], ends[np.concatenate((~joins, [True]))]
        place, mark = np.arange(len(t.data)), _MARKS[t.data]
        after = np.minimum.accumulate(np.where(mark, len(t.data), place)[::-1])[::-1]  # the next byte that is no mark
        before = np.maximum.accumulate(np.where(mark, -1, place))
        bare = after[starts] >= ends  # a word of marks keeps its first
        starts, ends = np.where(bare, starts, np.minimum(after[starts], ends - 1)), np.where(bare, starts + 1, before[ends - 1] + 1)
        extra = np.maximum(-(-(ends - starts - PART) // (PART // 2)), 0)
        again = np.repeat(np.arange(len(starts)), extra + 1)
        k = np.arange(len(again)) - np.repeat(np.concatenate(([0], np.cumsum(extra + 1)[:-1])), extra + 1)
        starts = starts[again] + k * (PART // 2)
        ends, docs = np.minimum(starts + PART, ends[again]), docs[again]
    return starts, ends, docs


_MARKS = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}<>|*#$%&-_~/\\"))


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def word_set(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    t = Texts(_LOWER[raw], np.array([0, len(raw)]))
    starts, ends, _ = parts(t)
    data = t.data.tobytes()
    return sorted({data[a:b] for a, b in zip(starts.tolist(), ends.tolist()) if b - a > 1})


def choose_landmarks(toxic: list[list[bytes]], clean: list[list[bytes]], most: int, cover: int = 3) -> tuple[list[bytes], list[bytes]]:
    """Beginnings of words (4 to 9 bytes) that are in many toxic documents which do
    not have `cover` landmarks yet, and far less often in clean ones; then frequent
    words of clean documents, a quarter of all at most."""
    stems = lambda words: {w[:k] for w in words for k in range(4, 10) if len(w) >= k}
    seen = Counter(s for words in toxic for s in stems(words))
    where: dict[bytes, set[int]] = {s: set() for s, n in seen.items() if n >= 3}
    del seen
    for i, words in enumerate(toxic):
        for s in stems(words):
            if s in where:
                where[s].add(i)
    in_clean, counts = dict.fromkeys(where, 0), {}
    for words in clean:
        for s in stems(words):
            if s in in_clean:
                in_clean[s] += 1
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    price = 4 * len(toxic) / max(len(clean), 1)
    where = {s: d for s, d in where.items() if len(d) > price * in_clean[s]}
    found: list[bytes] = []
    times = np.zeros(len(toxic), int)
    while where and len(found) < most - most // 4:
        gain = {s: sum(times[i] < cover for i in d) - price * in_clean[s] for s, d in where.items()}
        best = max(gain, key=lambda s: (gain[s], len(s), s))
        if gain[best] < max(3, len(toxic) // 100):  # beyond this, chance finds beginnings as good
            break
        found.append(best)
        times[list(where[best])] += 1
        where = {s: d for s, d in where.items() if gain[s] >= 2 and not s.startswith(best[:5]) and not best.startswith(s)}
    return found, [w for w in sorted((w for w in counts if len(w) >= 4), key=lambda w: (-counts[w], w)) if not any(w.startswith(f[:4]) for f in found)][: most // 4]


def train(texts: list[str], y: np.ndarray, landmarks: int = 32, rounds: int = 3, negatives: int = 15_000, seed: int = 5) -> Machine:
    """Without both labels among the rows every document gets the labels' share.
    Copies, also near ones (equal in the words with the smallest hashes), count
    once."""
    seen: dict = {}
    for text, v in zip(texts, y.tolist()):
        found = word_set(text)
        seen.setdefault((v, tuple(sorted(map(zlib.crc32, found))[:3])), (text, found, v))
    toxic, clean = ([x for x in seen.values() if bool(x[2]) == side] for side in (True, False))
    share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
    if not toxic or not clean:
        return Machine([], np.zeros(0, np.float32), -1.0, np.array([np.log(share / (1 - share)), 0, 0, 0]))
    bags = [[word_set(s) for s in sentences(text)] for text, _, _ in toxic]
    aims, rest = choose_landmarks([w for _, w, _ in toxic], [w for _, w, _ in clean], landmarks)
    marks = aims + rest
    gram = likeness(padded(marks), marks).astype(float)
    value, vector = np.linalg.eigh(gram + 1e-3 * np.eye(len(marks)))
    half = (vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T).astype(np.float32)  # the Nyström map
    rng = np.random.default_rng(seed)
    often: dict[bytes, int] = {}
    for _, found, _ in clean:
        for v in found:
            often[v] = often.get(v, 0) + 1
    no = sorted(often, key=lambda v: (-often[v], v))  # the frequent ones, and a sample of the rest
    if len(no) > negatives:
        no = no[: negatives // 2] + [no[i] for i in np.sort(rng.choice(np.arange(negatives // 2, len(no)), negatives - negatives // 2, replace=False))]
    words = sorted({w for d in bags for s in d for w in s} | set(no))
    place = {w: i for i, w in enumerate(words)}
    like = likeness(padded(words), marks)
    phi = like @ half
    usual = np.array([often.get(v, 0) > max(1, len(clean) // 500) for v in words])  # never what makes a sentence toxic
    no_at = np.array([place[w] for w in no])
    rows = [[np.array([place[w] for w in s]) for s in d if s] for d in bags]
    rows = [d for d in rows if d]
    decision = like[:, : len(aims)].max(axis=1) - usual if aims else -1.0 * usual  # to begin with: the word most like a landmark of the toxic side
    begins = np.array([any(v.startswith(m) for m in aims) for v in words]) & ~usual
    yes = np.unique(np.concatenate([np.zeros(0, int), *(s[begins[s]] for d in rows for s in d)]))
    w, b = np.zeros(len(marks)), 0.0
    for _ in range(rounds):
        worst = [max(d, key=lambda s: decision[s].max()) for d in rows]  # the sentence that is taken as toxic
        yes = np.unique(np.concatenate([yes, *(s[[decision[s].argmax()]] for s in worst)]))
        x = np.concatenate((phi[yes], phi[no_at]))
        target = np.concatenate((np.ones(len(yes)), -np.ones(len(no_at))))
        often_no = np.sqrt([often[v] for v in no])
        weight = np.concatenate((np.full(len(yes), 0.2 / len(yes)), 0.8 * often_no / max(often_no.sum(), 1)))
        w, b = hinge(x, target, weight)
        decision = phi @ w + b - 100 * usual
    machine = Machine(marks, (half @ w).astype(np.float32), float(b), np.zeros(4))
    both, shown = [x[0].encode() for x in [*toxic, *clean]], []
    for i in range(0, len(both), 100):
        some = both[i : i + 100]
        shown.append(machine.documents(np.frombuffer(b"".join(some), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in some])))))
    shown = np.concatenate(shown)
    machine.blend = logistic(shown, np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return machine


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient descent."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    rate = 1 / (2 * np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1] + ridge)
    w = v = np.zeros(x1.shape[1])
    for k in range(steps):
        short = np.maximum(1 - y * (x1 @ v), 0)
        grad = -2 * x1.T @ (weight * y * short) + ridge * v
        new = v - rate * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton's method on the logistic loss with a small ridge. Columns but the first
    (the constant) that would count against get no weight: the worst one is left out
    until there is none, so more evidence is never less toxic."""
    used = list(range(x.shape[1]))
    while True:
        z, a = x[:, used], np.zeros(len(used))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ a, -60, 60)))
            h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(used))
            a = a + np.clip(np.linalg.solve(h, z.T @ (y - p) - 0.1 * a), -2, 2)
        if len(used) == 1 or a[1:].min() >= 0:
            break
        used.pop(1 + int(a[1:].argmin()))
    out = np.zeros(x.shape[1])
    out[used] = a
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = 1_200, longest: int = 10_000) -> Machine:
    """A machine from at most `sample` toxic rows and three times as many others (the
    first by a hash of doc_id, none of over `longest` characters) among labels
    (doc_id, toxic). Rows with nulls are left out, a doc_id is learnt from once, by its
    smallest text. Without rows of both labels the machine gives every text the share of
    label 1 (0.01 without any row)."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label"))
    drawn = [drawn_rows(docs, known.filter(F.col("label") == side), n, longest, 5).toPandas() for side, n in ((1, sample), (0, 3 * sample))]
    rows = pd.concat(drawn).drop_duplicates("doc_id").sort_values(["doc_id", "text"])
    return train(rows["text"].tolist(), rows["label"].to_numpy(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of docs with toxicity (toxicity_ where that is a column, and so on),
    the probability of label 1, over whole texts of any length; null and empty texts get
    that of no word at all; an empty table has no rows."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(machine)
    name = next(f"toxicity{'_' * k}" for k in range(99) if f"toxicity{'_' * k}" not in docs.columns)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, 2 << 20, "text"):
            col = batch.column(at)
            col = col.fill_null("") if col.null_count else col
            p = sent.value.probability(sent.value.documents(*text_bytes(col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(float))], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = 1_200, longest: int = 10_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Labels of held-out
    rows are never learnt; a null doc_id is not held out, rows of equal doc_id are
    each scored, null texts are empty; an empty table has no rows."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    machine = learn(docs, labels.filter(~held), sample, longest)
    scored = score(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")), machine)
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
