"""Operator 9 — language identification by word-first backoff.

A known word votes with its log frequency in each language. A word never met
backs off to its character n-grams, longest first: the first order at which
any of its n-grams is known votes, with the mean of their log frequencies. A
text's language is the one with the largest sum of votes over all its words;
the score is the mean posterior of that language over the words.

The classifier is fitted on a bounded sample: about ``MAX_DOCS`` documents at
most, chosen by a hash of their id among those outside the held-out fold. Only
words and languages of the sample are in the model, of words the ``MAX_WORDS``
most frequent in documents.

Defined results: texts that are null or have no letter are ``und`` with score
0; ties go to the first language in order; repeated rows are identified alike;
very long texts are read whole; an empty table gives an empty result; without
any training document everything is ``und``. Only id, text and, in training,
lang are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charlm import CACHE_ENTRIES, Grams, find, word_hash, words_of
from .common import bucket_of, resident, table, text_batches

MAX_DOCS = 5_000
MAX_WORDS = 1_000_000
ORDER = 5
KNOWN = 2  # documents that a known word stands in, at least
SMOOTHING = 0.5


@dataclass
class Model:
    """Log frequencies by language: of known words, and of n-grams by order."""

    langs: list[str]
    words: np.ndarray
    word_logs: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def fit(langs: list[str], words: list[str], docs: np.ndarray) -> Model:
        def logs(n: np.ndarray) -> np.ndarray:
            return np.log((n + SMOOTHING) / (n.sum(0) + SMOOTHING * len(n))).astype(np.float32)

        hashed = word_hash(words)
        known = np.flatnonzero(docs.sum(1) >= KNOWN)
        known = known[np.argsort(hashed[known])]
        g, tables = Grams(words, ORDER), []
        for _, grams, _ in g.orders():
            keys, back = np.unique(grams, return_inverse=True)
            per_gram = np.column_stack([np.bincount(back, np.repeat(docs[:, i], g.lengths), len(keys)) for i in range(len(langs))])
            tables.append((keys, logs(per_gram)))
        return Model(langs, hashed[known], logs(docs[known]), tables)

    def votes(self, words: list[str]) -> np.ndarray:
        """Log frequencies (words × languages), from the first level that knows the word."""
        at, there = find(self.words, word_hash(words))
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if len(self.words):
            out[there] = self.word_logs[at[there]]
        left = np.flatnonzero(~there)
        for o in range(ORDER, 0, -1):
            if not len(left):
                break
            g = Grams([words[i] for i in left], o)
            keys, table_ = self.grams[o - 1]
            at, hit = find(keys, next(grams for n, grams, _ in g.orders() if n == o))
            n = np.add.reduceat(hit.astype(np.float32), g.starts)
            total = np.add.reduceat(table_[at] * hit[:, None], g.starts, axis=0)
            got = n > 0
            out[left[got]] = total[got] / n[got, None]
            left = left[~got]
        return out


class Identifier:
    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
            self.rows = np.concatenate([self.rows, self.model.votes(part)])

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self._clear()
        if new := [w for w in set().union(*split) if w not in self.known]:
            self._learn(new)
        langs, scores = [], []
        for text, words in zip(texts, split):
            if not words or not any(map(str.isalpha, text)):
                langs.append("und")
                scores.append(0.0)
                continue
            v = self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].astype(np.float64)
            best = int(v.sum(0).argmax())
            p = np.exp(v - v.max(1, keepdims=True))
            langs.append(self.model.langs[best])
            scores.append(float((p[:, best] / p.sum(1)).mean()))
        return langs, scores


def _identifier(model: Model) -> Identifier:
    return resident(("langid", model.key), lambda: Identifier(model))


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model | None:
    """Fits on ``docs(doc_id, text, lang)``; rows with a null language don't count."""
    text_batches(docs.sparkSession)
    usable = docs.where("lang is not null")
    pick = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(max(1, usable.select("lang").count()))) < max_docs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.update((lang, w) for w in set(words_of(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in seen], pa.string()) for i in (0, 1)] + [pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"]
            )

    counted = usable.where(pick).select("text", "lang").mapInArrow(count, "lang string, word string, n bigint")
    total = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    t = total.orderBy(F.desc("n"), "word", "lang").limit(MAX_WORDS).orderBy("word", "lang").toArrow()
    if not t.num_rows:
        return None
    langs = sorted(set(t.column("lang").to_pylist()))
    words = t.column("word").to_pylist()
    kinds = list(dict.fromkeys(words))
    row = {w: i for i, w in enumerate(kinds)}
    docs_by_lang = np.zeros((len(kinds), len(langs)))
    docs_by_lang[[row[w] for w in words], [langs.index(x) for x in t.column("lang").to_pylist()]] = t.column("n").to_numpy()
    return Model.fit(langs, kinds, docs_by_lang)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of ``docs(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    text_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = _identifier(shipped.value)
        for b in batches:
            langs, scores = identifier.identify(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(bucket_of(F.col("doc_id"), 4) != 2))
    out = identified(docs, model)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
