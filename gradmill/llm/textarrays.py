"""Words, lines and hashes of many documents at once, as numpy arrays over the
bytes of an Arrow string column. Words are `[^\\x20\\x09-\\x0D]+`."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x2545F4914F6CDD1D)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """prime ** i and its inverse for i < n, modulo 2 ** 64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", int(_PRIME)), ("down", pow(int(_PRIME), -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


class Texts:
    """data: the bytes of all documents; at: where each begins, with the end."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.docs = data, at, len(at) - 1
        ink = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        self.ink = ink
        before = np.concatenate(([False], ink[:-1])) if len(data) else ink
        self.starts = np.flatnonzero(ink & (~before | edge[:-1]))
        after = np.concatenate((ink[1:], [False])) if len(data) else ink
        self.ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.word_at = np.searchsorted(self.starts, at)  # where each document's words begin
        self.n_words = np.diff(self.word_at)
        self._sums = None

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each document."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.at[1:]] - total[self.at[:-1]]

    def per_doc_words(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)))
        return total[self.word_at[1:]] - total[self.word_at[:-1]]

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.n_words)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        up, down = powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[self.data] * up[:-1])))
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, document) of all \\n-split lines that have a word."""
        cuts = np.flatnonzero(self.data == 10)
        docs = np.searchsorted(self.at, cuts, "right") - 1
        starts = np.concatenate((self.at[:-1], cuts + 1))
        owner = np.concatenate((np.arange(self.docs), docs))
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        ends = np.where(last, self.at[owner + 1], np.append(starts[1:], 0) - 1)
        worded = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        return starts[worded], ends[worded], owner[worded]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether another one equals it, and whether an earlier one does."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return any_, later
