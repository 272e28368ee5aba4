"""Words, their character n-grams and hashed count tables, vectorised with NumPy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

WORD = re.compile(r"[^\W\d_]+")
#: Entries of a worker's word cache; it is emptied when full.
CACHE_ENTRIES = 300_000
_PAD, _STOP = "\x02", "\x03"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hash(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


class Grams:
    """Hashes of the n-grams that end at each character of padded words, order by order.

    ``orders`` yields (n, n-gram hashes, hashes of their first n - 1 characters)
    and keeps two orders in memory at a time.
    """

    def __init__(self, words: list[str], order: int) -> None:
        self.order = order
        pad = _PAD * (order - 1)
        flat = "".join([f"{pad}{w}{_STOP}" for w in words])
        self.codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4")
        self.at = np.flatnonzero(self.codes != ord(_PAD)).astype(np.int32)
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def orders(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        codes = self.codes.astype(np.uint64)
        full = codes + np.uint64(1)
        yield 1, full[self.at], np.zeros(len(self.at), np.uint64)
        for n in range(2, self.order + 1):
            contexts = full[self.at - 1]
            full = np.concatenate([full[:1], full[:-1]])
            full *= _FACTOR
            full += codes
            yield n, full[self.at], contexts


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``wanted`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNeyOrder:
    """Counts of one order: n-grams by hash, and for each context its total and its number of continuations.

    Every element of ``grams`` counts ``weights`` times (once by default).
    """

    def __init__(self, grams: np.ndarray, contexts: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.grams, first, back = np.unique(grams, return_index=True, return_inverse=True)
        self.counts = np.bincount(back, weights, len(self.grams)).astype(np.float32)
        self.contexts, back = np.unique(contexts[first], return_inverse=True)
        self.kinds = np.bincount(back, self.counts > 0, len(self.contexts)).astype(np.float32)
        self.totals = np.bincount(back, self.counts, len(self.contexts)).astype(np.float32)

    def interpolate(self, grams: np.ndarray, contexts: np.ndarray, lower: np.ndarray, discount: float) -> np.ndarray:
        at, there = find(self.contexts, contexts)
        if not there.any():
            return lower
        total = np.where(there, self.totals[at], 1.0)
        kinds = np.where(there, self.kinds[at], 0.0)
        g, known = find(self.grams, grams)
        n = np.where(known, self.counts[g], 0.0)
        return np.where(there, (np.maximum(n - discount, 0.0) + discount * kinds * lower) / total, lower)


def spelling_orders(words: list[str], top: int) -> list[KneserNeyOrder]:
    """Kneser-Ney tables of the characters of word types, order 1 to ``top``.

    The top order counts n-grams; a lower order counts the distinct characters
    before its n-gram. An n-gram at a word's start has only the padding before
    it, so there each word counts.
    """
    g, out, lower = Grams(words, top), [], None
    for n, grams, contexts in g.orders():
        if lower is not None:
            _, first = np.unique(grams, return_index=True)
            opens = np.flatnonzero(g.codes[g.at - (n - 2)] == ord(_PAD)) if n > 2 else np.zeros(0, np.int64)
            keep = np.union1d(first, opens)
            out.append(KneserNeyOrder(lower[0][keep], lower[1][keep]))
        lower = grams, contexts
    if lower is not None:
        out.append(KneserNeyOrder(*lower))
    return out
