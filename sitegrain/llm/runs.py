"""Operator 11 — periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a maximal stretch of words of smallest period q and of
``max(LEAST, TIMES * q)`` words at least. Without its last q words a run is
equal to itself without its first q words, so it repeats ``max(LEAST, TIMES *
q) - q`` words at least; the least of these over all q is the k of the mask.
Every word of a run stands in a k-gram that its text holds twice. The other
words are masked, and no run can reach over a masked word, so that only the
surviving stretches (segments) are searched.

Segments are halved as Main and Lorentz do: runs that hold both words around a
segment's middle have their period p either between the middle and p words
before it or between the middle and p words after it, and common extensions
in both directions give the whole run. All segments of a batch of documents
are halved together, one level at a time, so that a level is a few array
operations. Extensions are exact: blocks of 1, 2, 4, ... words get numbers,
equal for equal blocks, and an extension adds up the blocks that agree.

Everything is local to a row: nothing is shuffled, and a lost executor costs
its own batches only. Memory is about a hundred bytes a surviving word of a
batch, and a batch holds whole texts.

Defined results: a null, empty or blank text has no words and no runs (and the
hash of nothing); a null id counts as the empty text in the planted rule;
repeated rows give repeated results; runs of equal length are told apart by
start, then period; texts of any length are read whole; an empty table gives an
empty result; only id and text are read, so further columns of any name don't
matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, text_batches

LEAST = 6  # words of a run at least
TIMES = 4  # periods of a run at least


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """k: the words that a run of any period has in common with itself, one period on."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def _repeated(ids: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Whether a word stands in a k-gram that its text holds twice. ``owner``: the text's number.

    k-grams are told apart by 64-bit hashes; a chance equality only lets
    words survive that hold no run.
    """
    n = len(ids) - k + 1
    covered = np.zeros(len(ids) + 1, np.int64)
    if n < 2:
        return covered[:-1] > 0
    h = owner[:n].astype(np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = np.flatnonzero(owner[:n] == owner[k - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + k, -1)
    return np.cumsum(covered)[:-1] > 0


def _stretches(alive: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the surviving stretches, each within one text."""
    edge = np.flatnonzero(np.diff(owner)) + 1
    before = np.concatenate([[False], alive[:-1]])
    after = np.concatenate([alive[1:], [False]])
    before[edge] = False
    after[edge - 1] = False
    return np.flatnonzero(alive & ~before), np.flatnonzero(alive & ~after) + 1


class Extensions:
    """Common extensions of positions of an array, exact, for many pairs at once."""

    def __init__(self, values: np.ndarray, most: int) -> None:
        """``most``: no two different positions agree over more words."""
        self.names = [np.unique(values, return_inverse=True)[1].astype(np.int64)]
        while (1 << len(self.names)) <= most:
            last, step = self.names[-1], 1 << (len(self.names) - 1)
            if len(last) <= step:
                break
            self.names.append(np.unique(last[:-step] * len(values) + last[step:], return_inverse=True)[1])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` (a < b) on are equal."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names = self.names[j]
            fits = np.flatnonzero(b < len(names))
            hit = fits[names[a[fits]] == names[b[fits]]]
            for x in (a, b, total):
                x[hit] += 1 << j
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` (a < b) are equal."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names, step = self.names[j], 1 << j
            fits = np.flatnonzero(a >= step)
            hit = fits[names[a[fits] - step] == names[b[fits] - step]]
            total[hit] += step
            for x in (a, b):
                x[hit] -= step
        return total


def _pairs(low: np.ndarray, high: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """The middle of every segment with every period that a run inside it may have."""
    most = (high - low) // times
    middle = np.repeat((low + high) // 2, most)
    first = np.repeat(np.cumsum(most) - most, most)
    return middle, np.arange(len(middle)) - first + 1


def _main_lorentz(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs inside the segments of ``values``, by start, then end.

    Words next to a segment differ from all words inside it.
    """
    found = []
    reach = Extensions(values, int((ends - starts).max(initial=1)))
    low, high = starts, ends
    while len(low):
        m, p = _pairs(low, high, times)
        for at in (m - p, m):  # the equal words nearest to the middle: p before it, or p after it
            inside = np.flatnonzero((at >= 0) & (at + p < len(values)))
            a, q = at[inside], p[inside]
            same = values[a] == values[a + q]
            a, q = a[same], q[same]
            right, left = reach.forward(a, a + q), reach.backward(a, a + q)
            s, e = a - left, a + q + right
            long = e - s >= np.maximum(least, times * q)
            found.append(np.stack([s[long], e[long], q[long]]))
        middle = (low + high) // 2
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        large = high - low >= least
        low, high = low[large], high[large]
    s, e, q = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.ones(len(s), bool)  # of each stretch the smallest period
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return s[first], e[first], q[first]


def runs_of_texts(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Per text (a list of words) an array of ``(start, length, period)`` rows, by start, then period."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    starts, ends = _stretches(_repeated(ids, owner, overlap(least, times)), owner)
    large = ends - starts >= least
    starts, ends = starts[large], ends[large]
    lengths = ends - starts
    # The segments side by side, a value of its own after each.
    at = np.cumsum(lengths + 1) - lengths - 1
    values = -1 - np.arange(int((lengths + 1).sum()))
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values[np.repeat(at, lengths) + inner] = ids[np.repeat(starts, lengths) + inner]
    s, e, q = _main_lorentz(values, at, at + lengths, least, times)
    segment = np.searchsorted(at, s, side="right") - 1
    text = owner[starts[segment]] if len(s) else np.zeros(0, np.int64)
    base = np.cumsum(sizes) - sizes
    begin = s - at[segment] + starts[segment] - base[text] if len(s) else s
    order = np.lexsort((q, begin, text))
    rows = np.stack([begin, e - s, q], axis=1)[order]
    return np.split(rows, np.searchsorted(text[order], np.arange(1, len(texts)))) if texts else []


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words without those that a run repeats: all of a run after its first period."""
    if not len(runs):
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    start, length, period = runs.T
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    return [w for w, d in zip(words, np.cumsum(drop), strict=False) if not d]


def _texts(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        words = [words_of(t) for t in b.column(1).to_pylist()]
        found = runs_of_texts(words, least, times)
        lists = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x in found], kind)
        texts = pa.array([b" ".join(collapsed(w, x)).decode("utf-8", "surrogatepass") for w, x in zip(words, found, strict=True)])
        yield pa.RecordBatch.from_arrays([b.column(0), lists, texts.cast(pa.string())], ["id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, runs, collapsed)`` of every row: its runs, and its text without what they repeat, words joined by one space."""
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _texts(batches, least, times)

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(doc_id: int | None, words: list) -> list:
    """The query's rule: in one document of ten the words from some word on repeat."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_pylist()
        words = [planted(i, words_of(t)) for i, t in zip(ids, b.column(1).to_pylist(), strict=True)]
        rows = []
        for w, runs in zip(words, runs_of_texts(words), strict=True):
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
            start, length, period = max(runs.tolist(), key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
            milli = None if length is None else 1000 * length // period
            rows.append((len(runs), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        arrays = [b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of all documents, with the planted repetitions: the longest, and digests of all runs and of the collapsed texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_digests, f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")
