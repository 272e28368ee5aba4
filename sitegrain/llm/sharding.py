"""Operator 4 — sharding by sampled splitters (law ``bytes``: shard sizes near equal).

Records are ordered by the hash of their text, so that equal texts stand
together. A size-weighted sample of keys gives quantile boundaries for many
fine ranges (a fixed number a shard). Exact sizes of the ranges follow in one
aggregation; a range that came out overfull — one hot key, or one huge group
of copies — is subdivided by a second hash. Other equal texts share a shard. The units are dealt to the shards
largest first, each to the lightest shard, and rows get gapless slots from a
prefix sum over small blocks. Only slim rows (id, key, size, checksum) are
ever shuffled, never texts.

Everything on the executors is DataFrame expressions. The driver sees at most
the sample (about ``shards * RANGES * SAMPLES`` keys) and the units' sizes
(at most three times ``shards * RANGES`` rows, whatever the input).

Defined results: a null text counts as empty with size 8; repeated rows each
get a slot; rows tied by key stand in the order of their row number; very long
texts are only hashed and measured; an empty table gives an empty result. Only
id and text are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local_rows, materialise, table

RANGES = 64  # fine ranges a shard
SAMPLES = 8  # sampled keys a fine range
OVERFULL = 8  # a range above one in so many of a shard is subdivided
BLOCK_ROWS = 20_000  # rows a block of slots, about
_CELL_BITS = 12


def slim_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, seq (a unique row number), key (text hash), size and text_crc32 of every row, written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("seq"),
            F.xxhash64(text).alias("key"),
            (F.octet_length(text).cast("bigint") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "slim",
    )


def _unit_hash(salt: str):
    """A number in [0, 1) from the row's number."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col("seq")), 11) / F.lit(float(1 << 53))


def splitters(slim: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of the keys, from a sample in which each row counts by its size."""
    step = max(1, total // (ranges * SAMPLES))
    weight = F.floor(F.col("size") / F.lit(step) + _unit_hash("sample")).cast("bigint")
    sample = slim.select("key", weight.alias("w")).where("w > 0").groupBy("key").agg(F.sum("w").alias("w")).collect()
    cuts, seen = [], 0
    for key, w in sorted((r.key, r.w) for r in sample):
        if seen // SAMPLES != (seen + w) // SAMPLES:
            cuts.append(key)
        seen += w
    return cuts[:-1]


def _range_of(slim: DataFrame, cuts: list[int]) -> DataFrame:
    """Adds ``range``: how many boundaries lie below the key. Boundaries are looked up in the key's cell."""
    spark = slim.sparkSession
    cells: list[list[int]] = [[] for _ in range(1 << _CELL_BITS)]
    for c in cuts:
        cells[(c >> (64 - _CELL_BITS)) + (1 << (_CELL_BITS - 1))].append(c)
    rows, base = [], 0
    for i, c in enumerate(cells):
        rows.append({"cell": i, "base": base, "cuts": c})
        base += len(c)
    lookup = local_rows(spark, rows, "cell bigint, base bigint, cuts array<bigint>")
    cell = F.shiftright("key", 64 - _CELL_BITS) + (1 << (_CELL_BITS - 1))
    return slim.withColumn("cell", cell).join(F.broadcast(lookup), "cell").withColumn(
        "range", F.expr("base + size(filter(cuts, c -> c < key))")
    ).drop("cell", "base", "cuts")


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row; see the module's notes."""
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    slim = slim_rows(docs, id_col, text_col)
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = shards * RANGES
    target = max(1, total // ranges)
    ranged = _range_of(slim, splitters(slim, total, ranges))

    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()
    parts = {r["range"]: -(-r["bytes"] // target) for r in sizes if r["bytes"] * shards * OVERFULL > total}
    over = local_rows(spark, [{"range": k, "parts": n} for k, n in parts.items()], "range bigint, parts bigint")
    united = (
        ranged.join(F.broadcast(over), "range", "left")
        .withColumn("sub", F.floor(_unit_hash("sub") * F.coalesce("parts", F.lit(1))).cast("bigint"))
        .drop("parts")
    )
    units = united.groupBy("range", "sub").agg(F.sum("size").alias("bytes")).collect()
    loads = [(0, i) for i in range(shards)]
    dealt = []
    for u in sorted(units, key=lambda u: (-u["bytes"], u["range"], u["sub"])):
        load, i = heapq.heappop(loads)
        dealt.append({"range": u["range"], "sub": u["sub"], "shard": i})
        heapq.heappush(loads, (load + u["bytes"], i))
    placed = united.join(
        F.broadcast(local_rows(spark, dealt, "range bigint, sub bigint, shard int")), ["range", "sub"]
    )

    blocks = max(1, -(-rows // (shards * BLOCK_ROWS)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "seq"), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("seq"))
    return placed.withColumn("at", within).join(bases, ["shard", "block"]).select(
        "id", "size", "text_crc32", "shard", (F.col("base") + F.col("at") - 1).alias("slot")
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23."""
    out = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
