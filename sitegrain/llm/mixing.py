"""Operator 13 — mixing sources to target weights by capped water-filling.

Every source has a weight and gets that share of the wanted total; a source
whose share is above ``most`` times its size is clamped there, and the excess
is dealt anew among the others by weight, until none is above. The share a
source gets is then taken in whole and fractional repetitions of its
documents: all of them ``floor(target / size)`` times, and once more those that
come first in a seeded order, until what is still wanted is reached; the
document at that point is taken if more than half of it is wanted. So a
source's words miss its target by half its longest document at most, and no
document is taken more than ``most`` times.

No source is ever sorted or gathered. The seeded order is that of a hash, read
digit by digit: its first three hexadecimal digits give 4,096 cells a source,
whose sizes are summed up on the map side; the cell in which the target lies is
cut by the next three digits likewise, and only one of these cells, one row in
16 million, is sorted. The sources' table is joined by broadcast up to
``SMALL`` sources, beyond that by a salted join, so that a hot source's rows
stay spread. The driver gets two numbers a round of the filling.

Defined results: a null source is a source of its own, the last; a null, empty
or blank text has size 0, and a source of such texts the target 0; rows that
repeat an id are told apart by size and text hash, equal rows are
interchangeable; an empty table gives an empty result; texts of any length are
counted whole; only id, text and source are read, so further columns of any
name don't matter. The same rows and seed give the same mix, however they are
partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, fresh, materialise, table

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST = 3  # repetitions of a document at most
SMALL = 10_000  # sources whose table is broadcast
SALTS = 64
_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +"))).cast("bigint")


def slim_rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    """row (its number), id, source, size, order (the seeded hash of the id) and tie (the text's hash) of every row, written once."""
    order = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 16)
    return materialise(
        docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order.alias("order"), F.xxhash64(text_col).alias("tie")),
        "slim",
    )


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0, by code point, null last): rows are numbered in their sorted partitions, and these are counted."""
    part = F.spark_partition_id()
    placed = materialise(sources.orderBy(F.asc_nulls_last("source")).withColumn("part", part), "sources")
    sizes = placed.groupBy("part").agg(F.count("*").alias("rows")).collect()
    before, seen = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        before[r.part] = seen
        seen += r.rows
    base = F.coalesce(F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("part")], F.lit(0)) if before else F.lit(0)
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return placed.withColumn("rank", (base + at - 1).cast("bigint")).drop("part")


def water_filled(sources: DataFrame, total: int, most: int = MOST) -> DataFrame:
    """``sources(size, weight, ...)`` with ``target``: the share of ``total`` by weight, clamped at ``most`` sizes and redistributed."""
    cap = F.col("size") * most
    held = F.lit(False)  # clamped so far
    while True:
        weight, kept = sources.agg(F.sum(F.when(~held, F.col("weight"))), F.coalesce(F.sum(F.when(held, cap)), F.lit(0))).first()
        if not weight:
            return sources.withColumn("target", cap.cast("double"))
        level = (total - kept) / weight
        above = held | (F.col("weight") * F.lit(float(level)) > cap)
        if not sources.where(above & ~held).limit(1).count():
            return sources.withColumn("target", F.when(held, cap.cast("double")).otherwise(F.col("weight") * F.lit(float(level))))
        held = above


def _joined(rows: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the facts of their source (``of``), null where it has none: broadcast where sources are few, else salted."""
    if few:
        return rows.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    salted = facts.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return rows.join(salted.hint("merge"), F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")), "left").drop("of", "salt", "salt_of")


def _cut(rows: DataFrame, digits: Column, want: str, name: str) -> DataFrame:
    """Per source the cell of the seeded order in which ``want`` lies, and what is wanted of it: ``(of, cell, left)``."""
    cells = rows.groupBy("source", digits.alias("cell")).agg(F.sum("size").alias("words"), F.first(want).alias("want"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    found = cells.withColumn("before", before).where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("words")))
    return materialise(found.select(F.col("source").alias("of"), F.col("cell").alias(name), (F.col("want") - F.col("before")).alias(f"{name}_left")), name)


def _times(slim: DataFrame, weights: Sequence[int], most: int, total: int | None) -> DataFrame:
    """The slim rows with their source's size and target and ``times``, how often the mix takes them."""
    sources = ranked(slim.groupBy("source").agg(F.sum("size").alias("size")))
    sources = sources.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod("rank", F.lit(len(weights))).cast("int")])
    there, n_sources = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    few = n_sources <= SMALL
    filled = water_filled(sources, min(there if total is None else total, most * there), most)
    whole = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(most))).otherwise(0).cast("bigint")
    filled = filled.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", whole.alias("whole"))
    facts = materialise(filled.withColumn("want", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "targets")
    rows = _joined(slim, facts, few)
    first, second = F.substring("order", 1, _DIGITS), F.substring("order", 1 + _DIGITS, _DIGITS)
    rows = _joined(rows, _cut(rows, first, "want", "one"), few)
    rows = _joined(rows, _cut(rows.where(first == F.col("one")), second, "one_left", "two"), few)
    in_cell = F.coalesce((first == F.col("one")) & (second == F.col("two")), F.lit(False))
    earlier = F.coalesce((first < F.col("one")) | ((first == F.col("one")) & (second < F.col("two"))), F.lit(False))
    up_to = Window.partitionBy("source").orderBy("order", "id", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("size").over(up_to) - F.col("size") / 2.0
    at_cut = rows.where(in_cell).withColumn("more", middle <= F.col("two_left"))
    out = rows.where(~in_cell).withColumn("more", earlier).union(at_cut)
    times = F.least(F.col("whole") + F.col("more").cast("bigint"), F.lit(most)).cast("bigint")
    return out.select("row", "id", "source", "size", "source_size", "target", times.alias("times"))


def _checked(weights: Sequence[int], most: int) -> None:
    if most < 1 or not weights or min(weights) <= 0:
        raise ValueError("positive weights and one repetition at least")


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, total: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size, source_size, target, times)`` of every row: how often the mix takes it.

    ``weights`` are those of the sources in order of their names, repeating;
    ``total``: words wanted, all that there are if it is None, and never more
    than ``most`` times that.
    """
    _checked(weights, most)
    return _times(slim_rows(docs, seed, id_col, text_col, source_col, F.monotonically_increasing_id()), weights, most, total).drop("row")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, total: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as it takes them."""
    _checked(weights, most)
    own = fresh(docs, "_mix_row")
    rows = materialise(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    times = _times(slim_rows(rows, seed, id_col, text_col, source_col, F.col(own)), weights, most, total)
    taken = times.where("times > 0").select(F.col("row").alias(own), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias(f"{own}_copy"))
    return rows.join(taken.hint("merge"), own).select(*columns(docs))


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents by source, weights 5, 2, 1, as many words as there are."""
    out = mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


#: Clamped sources are a prefix in order of size against weight; the seeded order is summed up over all rows.
ORACLE = """with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    substr(md5('0' || coalesce('|' || cast(doc_id as varchar), '')), 1, 16) as o from documents),
  s as (select source, cast(sum(size) as bigint) as size, row_number() over (order by source nulls last) - 1 as r from d group by source),
  w as (select *, [5, 2, 1][(r % 3) + 1] as weight, 3 * size as cap from s),
  c as (select *, row_number() over q as k, sum(size) over () - coalesce(sum(cap) over (q rows between unbounded preceding and 1 preceding), 0) as words,
          sum(weight) over () - coalesce(sum(weight) over (q rows between unbounded preceding and 1 preceding), 0) as weights from w window q as (order by cap / weight, r)),
  l as (select min(k) as k, arg_min(cast(words as double) / cast(weights as double), k) as level from c where weight * (cast(words as double) / cast(weights as double)) <= cap),
  t as (select c.source, c.size as source_size, case when c.k < l.k then cast(cap as double) else weight * level end as target from c, l),
  f as (select *, case when source_size > 0 then least(3, cast(floor(target / source_size) as bigint)) else 0 end as whole from t),
  m as (select d.*, source_size, target, whole, greatest(0, target - whole * source_size) as want,
          sum(size) over (partition by d.source order by o, doc_id, size rows unbounded preceding) - size / 2.0 as middle from d join f on d.source is not distinct from f.source)
  select doc_id, size, source_size, target, cast(size * least(3, whole + case when middle <= want then 1 else 0 end) as bigint) as taken from m"""
