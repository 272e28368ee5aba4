"""Operator 8 — document fingerprints from closed syncmers.

A text is a sequence of tokens: white-space words of up to 32 code points,
and single characters of scripts written without spaces. Of every window of
``K`` = 5 tokens the inner substrings are its four pairs of neighbours; the
window is a closed syncmer if the least hash among them stands first or last.
Whether a window is chosen depends on the window alone, so an edit elsewhere
never changes it, and about half of all windows are chosen. The fingerprint
keeps the ``SKETCH`` least distinct 32-bit hashes of the chosen windows as
hex; the likeness of two fingerprints is the share of common hashes among the
least of both together, an estimate of the Jaccard likeness of the syncmer
sets (exact while both are complete). With each hash the sketch holds the
token position of its first anchor: ``aligned`` matches common anchors by
position and gives the share of them that lie at the commonest shift, near 1
where a passage was copied in one piece, low where its parts moved. ``anchors``
gives all syncmers with their positions.

A document's successor is found without a global sort: ids are cut into
buckets along their approximate quantiles (an id that many rows repeat gets
buckets of its own, cut by text hash), and the first row of each bucket also
stands as a ghost at the end of the bucket before. Everything is DataFrame
expressions.

Defined results: null counts as empty; an empty text has an empty fingerprint;
a text of fewer than five tokens has one anchor, the hash of all of them; two
empty fingerprints have likeness 1, an empty and another 0. Rows that repeat
an id follow each other by text hash, largest first; null ids come last. An
empty table gives an empty result; a single row is its own successor. Very
long texts are read whole. Only id and text are read, so further columns of
any name don't matter.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

K = 5
SKETCH = 64
SEGMENTS = 1024
BUCKET_ROWS = 1_500
CELL = 32  # segment bounds that one step of the lookup compares

_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_TOKEN = rf"[{_ALONE}]|[^ \t\n\x0B\f\r{_ALONE}]{{1,32}}"


def _with_anchors(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds ``name``: array of (hash, position) of the closed syncmers, in order."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    hashed = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), 0), lambda t: F.xxhash64(t))
    df = df.select(*keep, hashed.alias("_h"))
    pairs = F.expr(
        "if(size(_h) < 2, cast(array() as array<bigint>), transform(sequence(0, size(_h) - 2), i -> xxhash64(_h[i], _h[i + 1])))"
    )
    df = df.select(*keep, "_h", pairs.alias("_m"))
    chosen = F.expr(
        """case when size(_h) = 0 then cast(array() as array<struct<hash:bigint,position:int>>)
                when size(_h) < 5 then array(named_struct('hash', xxhash64(array_join(transform(_h, x -> string(x)), ' ')), 'position', 0))
                else filter(transform(sequence(0, size(_h) - 5), i -> if(
                       least(_m[i], _m[i + 3]) <= least(_m[i + 1], _m[i + 2]),
                       named_struct('hash', xxhash64(_m[i], _m[i + 2], _m[i + 3]), 'position', i), null)), x -> x is not null) end"""
    )
    return df.select(*keep, chosen.alias(name))


def anchors(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with anchors: (hash, position) of every closed syncmer, in order."""
    return _with_anchors(docs, F.coalesce(F.col(text_col), F.lit("")), "anchors")


def with_sketch(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the least distinct 32-bit anchor hashes, ascending, each with its first position in the lower 31 bits."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = _with_anchors(df, text, "_anchors")
    placed = F.transform("_anchors", lambda a: F.shiftleft(F.shiftrightunsigned(a["hash"], 32), 31).bitwiseOR(a["position"].cast("bigint")))
    df = df.select(*keep, F.sort_array(placed).alias("_placed"))
    first = F.expr("filter(_placed, (x, i) -> i = 0 or shiftrightunsigned(x, 31) <> shiftrightunsigned(_placed[greatest(i - 1, 0)], 31))")
    return df.select(*keep, F.slice(first, 1, SKETCH).alias(name))


def hashes(sketch: str) -> Column:
    """The hashes of a sketch, without positions."""
    return F.transform(sketch, lambda x: F.shiftrightunsigned(x, 31))


def as_text(hashes_: str) -> Column:
    """The fingerprint: eight hex digits an anchor."""
    return F.array_join(F.transform(hashes_, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Bottom-sketch estimate of the Jaccard likeness of two arrays of hashes, 0 to 1."""
    return F.expr(
        f"""case when size({a}) = 0 and size({b}) = 0 then 1D
                 else size(array_intersect(array_intersect(slice(sort_array(array_union({a}, {b})), 1, {SKETCH}), {a}), {b}))
                      / least({SKETCH}, size(array_union({a}, {b}))) end"""
    )


def with_aligned(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the share of two sketches' common anchors that lie at their commonest shift; null without common anchors."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    common = f"filter({{0}}, x -> array_contains(array_intersect(transform({a}, y -> shiftrightunsigned(y, 31)), transform({b}, y -> shiftrightunsigned(y, 31))), shiftrightunsigned(x, 31)))"
    df = df.select(*keep, F.expr(common.format(a)).alias("_ca"), F.expr(common.format(b)).alias("_cb"))  # both by hash, so they pair up
    df = df.select(*keep, F.expr("sort_array(zip_with(_ca, _cb, (x, y) -> (y & 2147483647) - (x & 2147483647)))").alias("_shifts"))
    runs = "aggregate(_shifts, named_struct('last', cast(null as bigint), 'run', 0, 'most', 0), (s, x) -> if(s.last <=> x, named_struct('last', x, 'run', s.run + 1, 'most', greatest(s.most, s.run + 1)), named_struct('last', x, 'run', 1, 'most', greatest(s.most, 1))), s -> s.most)"
    return df.select(*keep, F.expr(f"{runs} / nullif(size(_shifts), 0)").alias(name))


def _order_key() -> Column:
    """Place among rows of one id: by text hash, largest first, as a number from 0 to 1."""
    return F.xxhash64("text") / F.lit(2.0**64) + F.lit(0.5)


def _bucketed(docs: DataFrame) -> DataFrame:
    """Adds a segment and a bucket that rise with doc_id, a bucket of about BUCKET_ROWS rows or, for clustered ids, at most a segment."""
    at = [i / SEGMENTS for i in range(1, SEGMENTS)]
    n, low, high, cuts = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", at, 10_000)).first()
    if low is None:
        return docs.withColumn("_segment", F.lit(0).cast("int")).withColumn("_bucket", F.floor(_order_key() * max(1, n // BUCKET_ROWS)).cast("bigint"))
    share = n / SEGMENTS / BUCKET_ROWS  # buckets a segment
    subs = max(1, -(-n // (SEGMENTS * BUCKET_ROWS)))
    times = Counter(cuts)
    starts = {low: subs} | {c: subs for c in cuts}
    for c, k in times.items():  # an id at two quantiles and more fills a segment of its own
        if k > 1:
            starts[c] = max(1, round((k + 1) * share))
            if c < 2**63 - 1:
                starts.setdefault(c + 1, subs)
    bounds = sorted(starts)
    about = [
        {"at": x, "span": float(max(1, y - x)), "subs": starts[x], "alone": times[x] > 1} for x, y in zip(bounds, [*bounds[1:], high + 1])
    ]
    # literals as JSON, which the optimizer folds once; an id's segment is the number of bounds not above it, found in two steps
    cells = [bounds[i : i + CELL] for i in range(0, len(bounds), CELL)]
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), f"array<{kind}>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    df = docs.withColumn("_cell", F.coalesce(below(literal([c[0] for c in cells], "bigint")), F.lit(0)))
    inside = F.coalesce(below(F.get(literal(cells, "array<bigint>"), F.greatest(F.col("_cell") - 1, F.lit(0)))), F.lit(0))
    df = df.withColumn("_segment", F.when(F.col("_cell") > 0, (F.col("_cell") - 1) * CELL + inside).otherwise(0)).drop("_cell")
    own = F.get(literal(about, "struct<at:bigint,span:double,subs:bigint,alone:boolean>"), F.greatest(F.col("_segment") - 1, F.lit(0)))
    unnamed = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(1.0).alias("span"), F.lit(max(1, n // BUCKET_ROWS)).cast("bigint").alias("subs"), F.lit(True).alias("alone"))
    df = df.withColumn("_own", F.when(F.col("doc_id").isNull(), unnamed).otherwise(own))
    part = F.when(F.col("_own.alone"), _order_key()).otherwise((F.col("doc_id").cast("double") - F.col("_own.at").cast("double")) / F.col("_own.span"))
    sub = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * F.col("_own.subs"))
    sub = F.least(sub, F.col("_own.subs") - 1)
    return df.withColumn("_bucket", F.col("_segment").cast("bigint") * (1 << 32) + sub).drop("_own")


def with_next(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``next``: a struct of the fields of the row that follows in descending doc_id (of the first, after the last)."""
    head = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    placed = _bucketed(docs)
    heads = placed.groupBy("_segment", "_bucket").agg(F.max(head).alias("_head"))
    # the bucket before, inside a segment; before a segment's top bucket, the lowest of the next segment (of all, before the first)
    before = F.lag("_bucket").over(Window.partitionBy("_segment").orderBy(F.col("_bucket").desc()))
    heads = materialise(heads.select("_segment", F.col("_bucket").alias("_of"), "_head", before.alias("_inside")), "heads")
    segments = heads.groupBy("_segment").agg(F.min("_of").alias("low"))  # SEGMENTS * 2 rows at most
    order = Window.orderBy(F.col("_segment").desc())
    lows = segments.select("_segment", F.coalesce(F.lag("low").over(order), F.min("low").over(Window.partitionBy())).alias("_low"))
    ghosts = heads.join(F.broadcast(lows), "_segment").select("_of", "_head", F.coalesce("_inside", "_low").alias("_before"))
    # written first, so that its true size is known and texts aren't shuffled to meet a few rows
    ghosts = materialise(ghosts, "ghosts")
    placed = placed.join(
        ghosts, (F.col("_bucket") == F.col("_of")) & head.eqNullSafe(F.col("_head")), "left"
    ).select(*docs.columns, "_bucket", "_before")
    copies = F.array(
        F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("ghost")),
        F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("ghost")),
    )
    copies = F.filter(copies, lambda c: c["bucket"].isNotNull())
    dealt = placed.select(*docs.columns, F.explode(copies).alias("_at"))
    row = Window.partitionBy("_at.bucket").orderBy(
        "_at.ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()
    )
    led = dealt.withColumn("next", F.lead(F.struct(*fields)).over(row))
    return led.where("not _at.ghost").drop("_at")


def op8_syncmers(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(with_sketch(docs, F.col("text"), "sketch"), ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    df = df.select("doc_id", "sketch", n.cast("bigint").alias("n_chars"), edited.alias("edited"), F.col("next.sketch").alias("next_sketch"))
    df = df.select("doc_id", "n_chars", "sketch", "next_sketch", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    df = with_sketch(df, F.col("edited"), "edited_sketch").drop("edited")
    df = with_aligned(df, "sketch", "edited_sketch", "aligned_edited")
    df = df.select("doc_id", "n_chars", "edited_sha256", "aligned_edited", *(hashes(c).alias(c) for c in ("sketch", "next_sketch", "edited_sketch")))
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
        "aligned_edited",
    )
