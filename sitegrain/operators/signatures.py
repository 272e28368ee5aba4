"""Near pages by banded MinHash signatures.

A signature is 64 numbers; two pages agree in about as many of them, as a
share, as their sets of five-word shingles are alike. Equal signatures are one
before anything is joined. The others meet in one of 16 bands of four numbers
(at a likeness of 0.8 with a probability of 0.9998), and each pair that meets is
compared on the whole signatures. Where it is only asked which pages have a near
one, as in the findings, ``near_kinds`` compares far fewer pairs.

Defined results: a page of fewer than five words of three letters has no
signature and no near pages; equal pages are near with likeness 1; rows that
repeat a page_id count as pages of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.scalars import HASH_BASES, PRIME, SLOTS, estimated_likeness
from sitegrain.functions.slices import slices
from sitegrain.operators.pages import strip_html
from sitegrain.plans.dialect import SPARK
from sitegrain.plans.stored import materialise

WORDS, BANDS = 5, 16
LIKE, ALIKE = 0.8, 0.9  # near from here; a grave finding above
_SPACE = re.compile(r"[\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")  # white space as scripts split at it
_CHUNK = 16_384  # shingles at a time, for memory


def _substrings(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash, modulo 2**32, of many stretches of an array, from one prefix sum."""
    n = len(units)
    one = np.ones(1, np.uint64)
    powers = np.cumprod(np.concatenate([one, np.full(n, base, np.uint64)]))
    inverse = np.cumprod(np.concatenate([one, np.full(n, pow(base, -1, 2**64), np.uint64)]))
    sums = np.concatenate([one - one, np.cumsum(units * inverse[1:])])  # of unit i over base ** (i + 1)
    return ((sums[ends] - sums[starts]) * powers[ends]) & np.uint64(0xFFFFFFFF)


def signature(text: str | None) -> list[int] | None:
    """The 64 least combinations of both hashes over the distinct shingles of words of three UTF-16 units and more."""
    words = [w for w in _SPACE.split((text or "").lower()) if len(w) > 2 or (len(w) == 2 and max(w) > "\uffff")]
    if len(words) < WORDS:
        return None
    units = np.frombuffer(" ".join(words).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    ends = np.append(np.flatnonzero(units == 32), len(units))
    starts, ends = np.append(0, ends[:-1] + 1)[: len(words) - WORDS + 1], ends[WORDS - 1 :]
    a, b = (_substrings(units, starts, ends, base).astype(np.uint32) for base in HASH_BASES)
    best, slots, prime = np.full(SLOTS, PRIME, np.uint32), np.arange(SLOTS, dtype=np.uint32)[:, None], np.uint32(PRIME)
    for i in range(0, len(a), _CHUNK):
        mixed = slots * b[i : i + _CHUNK]  # modulo 2 ** 32, as its type
        mixed += a[i : i + _CHUNK]
        for _ in range(2):  # the remainder: what is below the prime turns large when that is taken off
            np.minimum(mixed, mixed - prime, out=mixed)
        best = np.minimum(best, mixed.min(axis=1))
    return best.astype(np.int64).tolist()


def _signatures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for (texts,) in slices((b,) for b in batches):
        yield pd.Series([signature(t) for t in texts], dtype=object)


def signature_of(text: Column) -> Column:
    return F.pandas_udf(_signatures, "array<bigint>")(text)


def bands(slots: str | Column) -> Column:
    """A key for each band."""
    c = F.col(slots) if isinstance(slots, str) else slots
    size = SLOTS // BANDS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice(c, i * size + 1, F.lit(size))))


def near_pairs(signed: DataFrame, least: float = LIKE) -> DataFrame:
    """``signed(sig)``, distinct → ``(a, b, likeness)``: pairs of signatures, both ways, that agree from ``least`` on.

    A pair that meets is compared on the spot, in the first band that its
    signatures share, so it is made once a way and only near pairs are shuffled.
    """
    keyed = signed.select("sig", F.posexplode(bands("sig")).alias("at", "band"))
    meet = keyed.select(F.col("sig").alias("a"), "at", "band").join(keyed.select(F.col("sig").alias("b"), "at", "band"), ["at", "band"]).where(F.col("a") < F.col("b"))
    size = SLOTS // BANDS
    earlier = F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: (i < F.col("at")) & (F.slice("a", i * size + 1, F.lit(size)) == F.slice("b", i * size + 1, F.lit(size))))
    near = meet.withColumn("likeness", estimated_likeness(F.col("a"), F.col("b"))).where((F.col("likeness") >= least) & ~earlier)
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return near.select(both.alias("p"), "likeness").select("p.a", "p.b", "likeness")


def signed_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, sig)`` of the pages that have a signature."""
    return pages.select("page_id", signature_of(F.expr(strip_html(SPARK, "coalesce(html, '')"))).alias("sig")).where("sig is not null")


def near_among(signed: DataFrame) -> DataFrame:
    """``signed(page_id, sig)`` → ``(page_id, likeness, n_others)``: pages that others come near to, the greatest likeness and how many."""
    groups = signed.groupBy("sig").agg(F.count("*").alias("n"))
    pairs = near_pairs(groups.select("sig"))
    around = pairs.join(groups.withColumnRenamed("sig", "b"), "b").groupBy("a").agg(F.max("likeness").alias("likeness"), F.sum("n").alias("near"))
    best = groups.join(around.withColumnRenamed("a", "sig"), "sig", "left").select(
        "sig", F.when(F.col("n") > 1, 1.0).otherwise(F.col("likeness")).alias("likeness"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_others")
    )
    return signed.join(best.where("n_others > 0"), "sig").select("page_id", "likeness", "n_others")


def near_pages(pages: DataFrame) -> DataFrame:
    """The same over pages; signatures are written first, as they are read often."""
    return near_among(materialise(signed_pages(pages), "signatures"))


def _parts(n: int) -> Column:
    """A key for each of ``n`` stretches of a signature: two that differ in fewer than ``n`` slots agree in one."""
    at = [SLOTS * i // n for i in range(n + 1)]
    return F.array(*(F.xxhash64(F.lit(i), F.slice("sig", a + 1, z - a)) for i, (a, z) in enumerate(zip(at, at[1:]))))


def _with_another(sigs: DataFrame, least: int) -> DataFrame:
    """``sigs(sig, sought)``, distinct → ``(sig)``, distinct: at least those sought that agree with another in ``least`` slots, and none that don't.

    Signatures are compared with the first of each key; only those that find
    none there, and for which it matters, meet all that share a key with them.
    Joins sort both sides: a signature's file is a sixth of its rows, by which
    Spark would broadcast them.
    """
    keyed = sigs.select("sig", "sought", F.posexplode(_parts(SLOTS - least + 1)).alias("at", "key"))
    first = keyed.groupBy("at", "key").agg(F.count("*").alias("n"), F.min_by("sig", F.xxhash64("sig")).alias("other")).where("n > 1")
    met = materialise(keyed.join(first.drop("n").hint("merge"), ["at", "key"]), "met")
    near = lambda a, b: (F.col(a) != F.col(b)) & (estimated_likeness(F.col(a), F.col(b)) >= least / SLOTS)
    found = met.where(near("sig", "other")).select(F.explode(F.array("sig", "other")).alias("sig")).distinct()
    found = materialise(found, "found")
    left = met.where("sought").join(found.hint("merge"), "sig", "left_anti").select("at", "key", F.col("sig").alias("own"))
    rest = left.join(met.select("at", "key", "sig").hint("merge"), ["at", "key"]).where(near("own", "sig")).select(F.col("own").alias("sig"))
    return found.union(rest).distinct()


def near_kinds(signed: DataFrame) -> DataFrame:
    """``signed(page_id, sig)`` → ``(page_id, likeness)`` of the pages that others come near to: 1 where one is above ALIKE, else LIKE.

    Which pages these are is exact; how many others there are, and their
    greatest likeness, is not asked, so that a page that has found one above
    ALIKE meets no more.
    """
    groups = materialise(signed.groupBy("sig").agg((F.count("*") > 1).alias("repeated")), "groups")
    grave = _with_another(groups.select("sig", (~F.col("repeated")).alias("sought")), int(ALIKE * SLOTS) + 1)
    grave = materialise(groups.where("repeated").select("sig").union(grave).distinct(), "grave")
    marked = groups.join(grave.withColumn("grave", F.lit(True)).hint("merge"), "sig", "left").select("sig", F.col("grave").isNull().alias("sought"))
    like = _with_another(marked, math.ceil(LIKE * SLOTS))
    kinds = grave.withColumn("likeness", F.lit(1.0)).union(like.join(grave.hint("merge"), "sig", "left_anti").withColumn("likeness", F.lit(LIKE)))
    return signed.join(kinds.hint("merge"), "sig").select("page_id", "likeness")
