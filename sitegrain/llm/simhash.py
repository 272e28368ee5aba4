"""Operator 1 — SimHash near-dedup by anchor-point covering.

A document's 64-bit fingerprint is the bitwise majority over the XXH64
hashes of its word shingles. Two fingerprints that differ in at most three
bits differ in at most one bit in one of their two 32-bit halves. Each half
is covered by the anchors of a fixed code: the perfect [31, 26] Hamming code
on 31 bits times both values of the last bit. Its covering radius is R = 1,
so with the half's threshold t = 1 every fingerprint is replicated to the
anchors within R + t = 2 (at most 17 a half, found from the syndrome without
search), and compared at each anchor with the fingerprints that have it as
their nearest anchor. No pair within the threshold is lost: if x's nearest
anchor is a, then d(a, y) <= d(a, x) + d(x, y) <= 2.

Equal fingerprints are collapsed before the join, so a group of copies costs
one row. A home meets about (fingerprints / 2^27) times 17 guests a half, so
the join grows with the square only once fingerprints outnumber the anchors;
beyond that (``FINER_FROM``) a byte of the other half joins the key, which
leaves 10^10 fingerprints about 80 strangers each instead of 2,500.

Defined results: null and empty texts have fingerprint zero and link to each
other; null ids are kept and never become a component's id unless it has no
other; rows that repeat an id or a text each get their row; an empty table
gives an empty result; very long texts are hashed whole, a chunk at a time.
Only id and text are read, so further columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, materialise, text_batches
from .components import connected_components

THRESHOLD = 3
FINER_FROM = 1 << 27  # distinct fingerprints, as many as a half has anchors: from here on anchors are divided by a byte
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of k words, in order and a chunk at a time; fewer words are one shingle, none give nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    digest = xxhash.xxh64_intdigest
    if 0 < len(words) < k:
        yield np.array([digest(b" ".join(words), 42)], dtype="<u8")
    for at in range(0, len(words) - k + 1, _CHUNK):
        part = words[at : at + _CHUNK + k - 1]
        yield np.array([digest(s, 42) for s in map(b" ".join, zip(*(part[i:] for i in range(k))))], dtype="<u8")


def fingerprint_of(chunks: Iterable[np.ndarray]) -> int:
    """The bitwise majority of the hashes as an unsigned integer; zero without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in chunks:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint64(text: str | None, k: int = 3) -> int:
    """The SimHash of one text as an unsigned integer; see the module's notes."""
    return fingerprint_of(shingle_hashes(text, k))


def simhash(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the fingerprint of every document as a signed 64-bit integer."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint64(t, k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp bigint")


#: Parity masks of the Hamming code on positions 1..31 (bit p-1 of the half is position p).
_MASKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def _halves(fp: Column) -> Column:
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    return F.explode(F.array(*(F.struct(F.lit(i).alias("half"), h.alias("x")) for i, h in enumerate((low, high)))))


def _with_code(fps: DataFrame) -> DataFrame:
    """Adds half, x (its 32 bits), syndrome and the nearest anchor."""
    df = fps.select("fp", _halves(F.col("fp")).alias("h")).select("fp", "h.half", "h.x")
    syndrome = sum(
        (F.shiftleft((F.bit_count(F.col("x").bitwiseAND(F.lit(m))) % 2).cast("int"), j) for j, m in enumerate(_MASKS)),
        start=F.lit(0),
    )
    df = df.withColumn("s", syndrome)
    return df.withColumn(
        "home", F.expr("if(s = 0, x, x ^ shiftleft(1L, s - 1))")
    )


def _bytes_of_other_half() -> Column:
    """(number, value) of the four bytes of the half that the anchor doesn't cover."""
    other = F.when(F.col("half") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.array(*(F.shiftright(other, 8 * i).bitwiseAND(F.lit(255)) + F.lit(256 * i) for i in range(4)))


def linked_pairs(fps: DataFrame, threshold: int = THRESHOLD, finer: bool = False) -> DataFrame:
    """Distinct ``fps(fp)`` → ``(u, v)``, u < v: every pair that differs in at most ``threshold`` (<= 3) bits.

    A pair may be found at several anchors and then comes as often. ``finer``
    also joins on a byte of the other half: that half differs in at most three
    bits, so one of its four bytes is equal, and nothing is lost; rows are
    replicated four times as often and meet 64 times fewer strangers.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("two halves with one differing bit each cover thresholds up to 3")
    coded = _with_code(fps)
    keys = ["half", "anchor"]
    if finer:
        coded, keys = coded.withColumn("byte", F.explode(_bytes_of_other_half())), [*keys, "byte"]
    homes = coded.withColumnsRenamed({"fp": "u", "home": "anchor"}).select("u", *keys)
    guests = coded.withColumn(
        "anchor",
        F.explode(
            F.expr(
                """concat(
                     array(home, home ^ 2147483648L),
                     if(s = 0, array(),
                        transform(filter(sequence(1, 31), i -> (i ^ s) > i AND (i ^ s) <= 31),
                                  i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))))"""
            )
        ),
    ).select(F.col("fp").alias("v"), *keys)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold
    return homes.join(guests, keys).where(near & (F.col("u") < F.col("v"))).select("u", "v")


def near_duplicate_components(
    docs: DataFrame, k: int = 3, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, fp, component_id)`` for every row: component_id is the least id reachable over links.

    Copies are never expanded into pairs; every link between different
    fingerprints counts.
    """
    fps = materialise(simhash(docs, k, id_col, text_col), "fps")
    reps = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")), "reps")
    comp = connected_components(linked_pairs(reps.select("fp"), threshold, reps.count() > FINER_FROM))
    rooted = reps.join(comp, reps.fp == comp.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialise(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(ids, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component: the row of its least id, of least text hash among rows that repeat the id.

    A component without an id keeps one of its rows, likewise by text hash.
    Further columns of any name stay as they are.
    """
    row = fresh(docs, "_simhash_row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicate_components(rows, k, threshold, id_col=row)  # components by row, so that no id has to be unique
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), F.col(row).alias("row"))
    placed = rows.select(F.col(row).alias("id"), place.alias("place")).join(groups, "id")
    chosen = placed.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.row").alias(row))
    return rows.join(materialise(chosen, "chosen").hint("merge"), row, "left_semi").select(*columns(docs))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from .common import table

    out = near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
