"""Operator 10 — toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of word
pairs. The top order counts pairs (a document counts a pair once), the class's
word order counts the distinct words before a word. What its discounts free
goes to words that both classes share — continuation counts with the class as
the context, so that a word of one class only gets nothing here — and from
there to a spelling model, interpolated Kneser-Ney over the characters of the
class's word types, whose lower orders both classes share too, down to one
over the alphabet. A rare expression is thus smoothed by counts of all text at
both levels. (With a smaller discount of the shared counts a class's own words
weigh alike whether met once or often: of 427 held-out toxic documents of the
check input 399 were found at 0.99 and 384 at 0.5, instead of 422.)

A document's evidence is the log-likelihood ratio of its words, by the pair
model and by its word order alone. How far pairs count grows with the pairs of
the context in the class that has met fewer: a class that has hardly met a
context can't tell what is odd after it. The evidence is normalised by length:
over the worst windows of ``WINDOWS`` words, so that long texts don't dilute a
passage, and over all of it, which gathers faint evidence (a word counts once
in a short window). A word that neither class has met is judged by its
spelling alone. A logistic fit with slopes of zero and more on labelled
documents kept out of the counts turns the evidence into a probability, so that
no evidence of toxicity lowers a score.

The classifier is fitted on all labelled documents: words and pairs are counted
and summed by Spark, and the slopes are fitted by sums over all calibrating
documents, step by step. The model has the ``MAX_PAIRS`` most frequent pairs (of
``PAIR_DOCS`` documents and more) and the ``MAX_WORDS`` most frequent words, so
what is broadcast is bounded whatever the texts hold; one task makes it, and the
driver gets it once. ``op10_toxicity`` alone fits on a bounded sample of about
``MAX_DOCS`` labelled documents, chosen by a hash of their id. Scoring covers all
rows and whole texts.

Defined results: labels of one id that disagree count by their mean, one half
and more meaning toxic; null labels and labels without a document are ignored;
null and empty texts have no evidence and score alike; repeated rows score
alike; ties in the sample's order go by hash; an empty table gives an empty
result; without labelled documents of both classes every score is 0. A column
of the score's name keeps its place, and the score's gets underscores.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charlm import CACHE_ENTRIES, Grams, KneserNeyOrder, find, spelling_orders, word_hash, words_of
from .common import bucket_of, columns, materialise, resident, table, text_batches, trim

MAX_DOCS = 5_000
MAX_PAIRS, MAX_WORDS = 500_000, 400_000
PAIR_DOCS = 2  # documents from which a pair is in the model; of one document, the discount leaves a tenth
ORDER = 6
SHARED = 3  # character orders up to this are common to both classes
DISCOUNT, SHARED_DISCOUNT = 0.9, 1.0
EXPERIENCE = 20.0  # pairs of a context in the class that has met fewer, at which the pair order counts by half
WINDOWS = (8, 64)
LIMIT = 40.0  # of one word's log ratio, either way
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20  # bytes of a model's file in a row
START = np.uint64(1)  # stands before a document's first word


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return before * _FACTOR + word


@dataclass
class Model:
    """Hashed counts of both classes; its size follows from the sample's bounds."""

    words: np.ndarray  # sorted hashes
    left: np.ndarray  # distinct words before each, by class
    after: np.ndarray  # of each word as a context: pairs and kinds of pairs, by class
    opening: np.ndarray  # the same of START
    pairs: np.ndarray  # sorted hashes
    counts: np.ndarray  # documents with the pair, by class
    shared: list[KneserNeyOrder]
    own: list[list[KneserNeyOrder]]  # by class
    alphabet: int
    slopes: tuple[float, ...] = (0.0,) * (2 * len(WINDOWS) + 2)
    shift: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def fit(words: list[str], by_class: np.ndarray, left: np.ndarray, after: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> Model:
        """words with their documents by class, for the spelling; left and after: a word's hash and its numbers a row (START too); pairs: hashes, with counts."""
        left = left[np.argsort(left[:, 0].view(np.uint64))]
        after = after[np.argsort(after[:, 0].view(np.uint64))]
        hashed, contexts = (np.ascontiguousarray(x[:, 0]).view(np.uint64) for x in (left, after))
        at, there = find(contexts, hashed)
        given = np.where(there[:, None], after[at, 1:] if len(after) else 0, 0).astype(np.float32).reshape(len(hashed), 4)
        first = after[contexts == START, 1:]
        opening = first[0].astype(np.float64) if len(first) else np.zeros(4)
        order = np.argsort(pairs)
        alphabet = len(set().union(*words)) + 2
        shared = spelling_orders(words, SHARED + 1)[:SHARED]
        own = [spelling_orders([w for w, n in zip(words, by_class[:, y]) if n], ORDER)[SHARED:] for y in (0, 1)]
        return Model(hashed, left[:, 1:].astype(np.float32), given, opening, pairs[order], counts[order].astype(np.float32), shared, own, alphabet)

    def spelled(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word's characters, by class."""
        g = Grams(words, ORDER)
        low = np.full(len(g.at), 1.0 / self.alphabet)
        p = [low, low]
        for o, grams, contexts in g.orders():
            if o <= SHARED:
                low = self.shared[o - 1].interpolate(grams, contexts, low, DISCOUNT)
                p = [low, low]
            else:
                p = [own[o - SHARED - 1].interpolate(grams, contexts, x, DISCOUNT) for own, x in zip(self.own, p)]
        return np.column_stack([np.add.reduceat(np.log(x), g.starts) for x in p])

    def unigrams(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each word without its context, by class, and whether any class has met it."""
        at, there = find(self.words, word_hash(words))
        left = np.where(there[:, None], self.left[at] if len(self.words) else 0.0, 0.0).astype(np.float64)
        totals, kinds = self.left.sum(0, dtype=np.float64), (self.left > 0).sum(0)
        base = np.exp(np.maximum(self.spelled(words), -600.0))
        # What a class has not met falls back to words that both classes share: a word counts once for each class that has it
        # (its continuation counts with the class as the context), and what this discounts goes to its spelling in the class.
        met = (self.left > 0).sum(dtype=np.float64)
        shared = (np.maximum((left > 0).sum(1) - SHARED_DISCOUNT, 0.0)[:, None] + SHARED_DISCOUNT * len(self.left) * base) / met
        own = (np.maximum(left - DISCOUNT, 0.0) + DISCOUNT * kinds * shared) / totals
        own[~there] = base[~there]  # judged by spelling alone
        return own, there

    def log_ratios(self, hashed: np.ndarray, own: np.ndarray, there: np.ndarray, context: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Log ratios of each word of several documents in a row, by the pair model and by the word model alone.

        hashed, own, there and context are what ``unigrams`` and ``contexts``
        say of the words; firsts: where documents begin.
        """
        before = np.concatenate([[START], hashed[:-1]]) if len(hashed) else hashed
        given = np.concatenate([self.opening[None], context[:-1]]) if len(hashed) else context
        before[firsts], given[firsts] = START, self.opening
        at, known = find(self.pairs, pair_hash(before, hashed))
        n = np.where(known[:, None], self.counts[at] if len(self.pairs) else 0.0, 0.0)
        words, pairs = np.log(own), []
        for y in (0, 1):
            total, kinds = given[:, 2 * y], given[:, 2 * y + 1]
            p = (np.maximum(n[:, y] - DISCOUNT, 0.0) + DISCOUNT * kinds * own[:, y]) / np.maximum(total, 1.0)
            pairs.append(np.log(np.where(there & (total > 0), p, own[:, y])))
        word = words[:, 1] - words[:, 0]
        # A class that has hardly met a context can't say what is odd after it: the pair order counts by what the less experienced class knows.
        known = np.minimum(given[:, 0], given[:, 2])
        pair = word + known / (known + EXPERIENCE) * (pairs[1] - pairs[0] - word)
        return np.clip([pair, word], -LIMIT, LIMIT)

    def contexts(self, words: list[str]) -> np.ndarray:
        """Of each word as a context: pairs and kinds of pairs, by class."""
        at, there = find(self.words, word_hash(words))
        return np.where(there[:, None], self.after[at] if len(self.words) else 0.0, 0.0)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes, self.own = np.zeros(0, np.uint64), np.zeros((0, 2))
        self.there, self.context = np.zeros(0, bool), np.zeros((0, 4))

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            n = len(self.known)
            while n + len(part) > len(self.hashes):  # doubled, so that learning stays linear
                grown = lambda x: np.concatenate([x, np.zeros((max(1 << 15, len(x)), *x.shape[1:]), x.dtype)])
                self.hashes, self.own, self.there, self.context = map(grown, (self.hashes, self.own, self.there, self.context))
            self.known.update(zip(part, range(n, n + len(part))))
            rows = slice(n, n + len(part))
            self.hashes[rows], self.context[rows] = word_hash(part), self.model.contexts(part)
            self.own[rows], self.there[rows] = self.model.unigrams(part)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Mean log ratio of each text's worst window, by window, and of the whole text; first by pairs, then by words."""
        split = [words_of(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self._clear()
        if new := list(set().union(*split).difference(self.known)):
            self._learn(new)
        sizes = [len(words) for words in split]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        stops = np.cumsum(sizes)
        firsts = (stops - sizes)[np.array(sizes, bool)] if sizes else stops
        every = self.model.log_ratios(self.hashes[at], self.own[at], self.there[at], self.context[at], firsts)
        out = np.zeros((len(texts), 2 * len(WINDOWS) + 2))
        for row, words, stop in zip(out, split, stops.tolist()):
            if words:
                row[:] = [v for x in every[:, stop - len(words) : stop] for v in self._summed(x, words)]
        return out

    @staticmethod
    def _summed(x: np.ndarray, words: list[str]) -> list[float]:
        for i in np.flatnonzero(x > 1).tolist():
            if words[i] in words[max(0, i - WINDOWS[0] + 1) : i]:
                x[i] = 0.0
        sums = np.concatenate([[0.0], np.cumsum(x)])
        worst = [(sums[k:] - sums[: len(sums) - k]).max() / w for w in WINDOWS for k in (min(w, len(words)),)]
        return [*worst, x.mean()]

    def score(self, texts: list[str | None]) -> list[float]:
        z = self.evidence(texts) @ np.array(self.model.slopes) + self.model.shift
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def scorer(model: Model) -> Scorer:
    """The worker's scorer of a model; its word cache outlives the task."""
    return resident(("toxicity", model.key), lambda: Scorer(model))


Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]  # the sum of f(x, y) over all rows


def _logistic(total: Total, kept: list[int], scale: np.ndarray, n: float, pos: float) -> tuple[tuple[float, ...], float]:
    """Ridge logistic regression with Platt's targets, so that separable classes stay finite."""
    high, low = (pos + 1) / (pos + 2), 1 / (n - pos + 2)
    ridge = np.diag([0.1] * len(kept) + [1e-6])
    w = np.zeros(len(kept) + 1)
    for _ in range(200):

        def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            a = np.column_stack([x[:, kept] / scale[kept], np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a
            return np.concatenate([h.ravel(), a.T @ (np.where(y == 1, high, low) - p)])

        found = total(sums)
        h, gradient = found[: len(w) ** 2].reshape(len(w), len(w)), found[len(w) ** 2 :]
        step = np.linalg.solve(h + ridge, gradient - ridge @ w)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return tuple((w[:-1] / scale[kept]).tolist()), float(w[-1])


def _fitted(total: Total, width: int) -> tuple[tuple[float, ...], float] | None:
    """The logistic fit with slopes of zero and more: evidence never lowers a score; what would get a negative slope is left out, the most negative first. None without both classes."""
    first = total(lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0)]))
    n, pos = first[:2] if len(first) else (0.0, 0.0)
    if not 0 < pos < n:
        return None
    mean = first[2:] / n
    scale = np.maximum(np.sqrt(total(lambda x, y: ((x - mean) ** 2).sum(0)) / n), 1e-9)
    kept = list(range(width))
    while True:
        slopes, shift = _logistic(total, kept, scale, n, pos)
        if min(slopes, default=0.0) >= 0.0:
            out = np.zeros(width)
            out[kept] = slopes
            return tuple(out.tolist()), shift
        kept.pop(int(np.argmin(slopes)))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """The fit over rows at hand."""
    return _fitted(lambda f: f(x, y), x.shape[1])


def _total(evidence: DataFrame) -> Total:
    """Sums over ``evidence(y, x)``: tasks sum up their rows, the driver adds a few numbers a task."""

    def total(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for b in batches:
                if b.num_rows:
                    y = b.column(0).to_numpy()
                    part = f(b.column(1).flatten().to_numpy().reshape(len(y), -1), y)
                    found = part if found is None else found + part
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.float64()))], ["s"])

        parts = evidence.mapInArrow(run, "s array<double>").toArrow().column(0).to_pylist()
        return np.sum(parts, axis=0) if parts else np.zeros(0)

    return total


def labelled(docs: DataFrame, labels: DataFrame, held_out_too: bool = False, max_docs: int | None = None) -> DataFrame:
    """text, y and part (0 calibrates, 1 to 3 count) of all labelled documents, or of a bounded sample of them."""
    marks = labels.where("toxic is not null and doc_id is not null")
    fold = F.lit(True) if held_out_too else bucket_of(F.col("doc_id"), 5) != 0
    marks = marks.where(fold).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    if max_docs is not None:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(max(1, marks.count()))) < max_docs)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)).cast("int").alias("part")
    chosen = marks.select(F.col("doc_id").alias("_id"), "y", part)
    chosen = chosen.hint("merge") if max_docs is None else F.broadcast(chosen)  # all labels are as many as the documents allow
    return docs.select("doc_id", "text").where(fold).join(chosen, F.col("doc_id") == F.col("_id")).select("text", "y", "part")


def _model(gathered: DataFrame) -> Model | None:
    """The model of what is counted, made in one task and sent in pieces; None where a class has no word.

    ``gathered(kind, word, a, b, c, d, e)``: 0 words with their documents by class, 1 and 2 ``left`` and ``after``, 3 pairs with theirs.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = [], [[np.zeros((0, 5), np.int64)] for _ in range(4)]
        for b in batches:
            kind, numbers = b.column(0).to_numpy(), np.column_stack([b.column(i).to_numpy() for i in range(2, 7)])
            for k in set(kind.tolist()):
                found[k].append(numbers[kind == k])
            words += b.column(1).filter(pa.array(kind == 0)).to_pylist()
        by_class, left, after, pairs = map(np.concatenate, found)
        found.clear()
        if not all(by_class[:, :2].sum(0) > 0):
            return
        keys = pair_hash(*(np.ascontiguousarray(pairs[:, i]).view(np.uint64) for i in (0, 1)))
        data = pickle.dumps(Model.fit(words, by_class[:, :2], left[:, :3], after, keys, pairs[:, 2:4]))
        trim()
        for at in range(0, len(data), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([data[at : at + PIECE]], pa.binary())], ["at", "data"])

    pieces = materialise(gathered.repartition(1).mapInArrow(make, "at bigint, data binary"), "model")
    data = bytearray()
    for r in pieces.orderBy("at").toLocalIterator():
        data += r.data
    return pickle.loads(data) if data else None


def train(docs: DataFrame, labels: DataFrame, held_out_too: bool = False, max_docs: int | None = None) -> Model | None:
    """Fits the model, on all labelled documents or a sample of about ``max_docs``; None where a class has no labelled document."""
    text_batches(docs.sparkSession)
    sample = materialise(labelled(docs, labels, held_out_too, max_docs), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(set(words_of(text)))
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], ["word", "n0", "n1"]
            )

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros((0, 3), np.int64)]
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if words := words_of(text):
                    h = word_hash(words)
                    own = np.column_stack([np.concatenate([[START], h[:-1]]), h]).view(np.int64)
                    own = np.unique(own, axis=0)  # a document counts a pair once
                    found.append(np.column_stack([own, np.full(len(own), y)]))
            rows = np.concatenate(found)
            ones = (rows[:, 2] == 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows[:, 0], rows[:, 1], ones, 1 - ones)], ["before", "word", "n0", "n1"])

    def total(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def kind(k: int, df: DataFrame) -> DataFrame:
        numbers = [F.col(c) for c in df.columns if c != "text"]
        numbers += [F.lit(0).cast("bigint")] * (5 - len(numbers))
        text = F.col("text") if "text" in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(k).alias("kind"), text.alias("word"), *(c.alias(n) for c, n in zip(numbers, "abcde")))

    counted = sample.where("part > 0").select("text", "y")
    most_seen = (F.col("n0") + F.col("n1")).desc()
    words = total(counted.mapInArrow(count, "word string, n0 bigint, n1 bigint"), "word").orderBy(most_seen, "word").limit(MAX_WORDS)
    # what a word needs of its pairs is summed where the pairs are; only those of several documents are gathered
    pairs = materialise(total(counted.mapInArrow(count_pairs, "before bigint, word bigint, n0 bigint, n1 bigint"), "before", "word"), "pairs")
    kinds = [F.count_if(F.col(c) > 0).alias(k) for c, k in (("n0", "k0"), ("n1", "k1"))]
    left = pairs.groupBy("word").agg(F.count("*").alias("n"), *kinds).orderBy(F.desc("n"), "word").limit(MAX_WORDS).drop("n")
    after = pairs.groupBy("before").agg(F.count("*").alias("n"), F.sum("n0").alias("s0"), kinds[0], F.sum("n1").alias("s1"), kinds[1])
    after = after.orderBy(F.desc("n"), "before").limit(MAX_WORDS).drop("n")
    strong = pairs.where(F.col("n0") + F.col("n1") >= PAIR_DOCS).orderBy(most_seen, "before", "word").limit(MAX_PAIRS)
    made = [kind(k, df) for k, df in enumerate((words.withColumnRenamed("word", "text"), left, after, strong))]
    model = _model(made[0].union(made[1]).union(made[2]).union(made[3]))
    if model is None:
        return None
    trim()
    evidence = materialise(_evidence(sample.where("part = 0").select("y", "text"), model), "evidence")
    model.slopes, model.shift = _fitted(_total(evidence), len(model.slopes)) or ((0.0, 0.0, 0.0, 2.0, 0.0, 0.0), -6.0)
    model.key = uuid.uuid4().hex  # workers keep the uncalibrated model under the old one
    trim()
    return model


def _evidence(marked: DataFrame, model: Model) -> DataFrame:
    shipped = marked.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.evidence(b.column(1).to_pylist()).tolist(), pa.list_(pa.float64()))], ["y", "x"])

    return marked.mapInArrow(run, "y int, x array<double>")


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a last column, a score between 0 and 1; see the module's notes for its name."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    if model is None:
        return docs.select(*columns(docs), F.lit(0.0).alias(name))
    text_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots can't go through Arrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.score(b.column(at).to_pylist()), pa.float64())], [*b.schema.names, "score"])

    return plain.mapInArrow(run, plain.withColumn("score", F.lit(0.0)).schema).toDF(*docs.columns, name)


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that score below one half, with their columns as they are."""
    out = scored(docs, model, name="toxicity")
    return out.where(F.col(f"`{out.columns[-1]}`") < 0.5).select(*columns(docs))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document, from models that never see the held-out rows' labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels"), max_docs=MAX_DOCS))
    return out.select(
        "doc_id",
        (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
