"""Operator 12 — pairs of overlapping intervals by overlap interval partitioning, counted by relation.

Intervals are whole slots, both ends included; an open end is infinite. Both
sides are first summed up by ``(key, first slot, last slot)``, before they are
shuffled for the join: a hot key has no more of these than its span of time
has, whatever its rows.

The inner side (sessions) is grouped by logarithmic length class — class c
holds lengths up to ``FINEST * RATIO**c`` slots, open intervals are a class of
their own — and by the granule of its start, once at each granule size from
its class's own upwards. An outer interval (a sale) chooses for each class the
least of these sizes at which it spans ``SPAN`` granules at most, and probes
those in which an overlapping interval of the class can start: from one
granule before its own start, as none is longer than its granule, or from the
table's first granule for open ones. The probes meet the groups in one
equi-join on (key, class, granule size, granule), and each candidate is
verified by its slots. Intervals of a class stand in one granule of each size,
and a probe of a class has one size, so that each pair meets once.

An outer interval makes about ``SPAN + 2`` probes a class that occurs, and a
join key holds no more than a granule's worth of distinct intervals on either
side, so neither a hot key nor an open end piles up in a task. The driver
gets one row: the first and last start, and which classes occur.

Sessions come from pieces of 15 minutes (the gap): clicks of a piece always
belong together, so they are summed up before any sort; pieces are chained
within a day of a client, and only the sessions at either end of a day, two a
day at most, are chained across days.

Defined results: rows with a null key, start or time don't take part; a null
end is an error of the caller's (``OPEN`` stands for infinite); repeated clicks
change nothing; rows that repeat a sale_id are summed up (a repeated sale
counts twice, as does a null sale_id, which gets no lines); an end before its
start counts as the start; empty tables give an empty result; further columns
of any name don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialise, table

GAP = 15 * 60 * 1_000_000  # microseconds between a session's clicks at most
DAY = 24 * 3600 * 1_000_000
SLOT_HOURS = 6
OPEN = 2**31 - 1  # the last slot of an open interval
FINEST, RATIO, SPAN = 32, 4, 4  # slots of the least granule, from size to size, granules that an outer interval spans at most


def micros(col: str | Column) -> Column:
    """Whole microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    c = F.col(col) if isinstance(col, str) else col
    of_day = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(c.cast("date")) * F.lit(DAY) + of_day.cast("bigint") * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def slot(col: str | Column) -> Column:
    """The slot of a timestamp without a zone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_date(c.cast("date")) * (24 // SLOT_HOURS) + F.floor(F.hour(c) / SLOT_HOURS).cast("int")


def _chained(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, first, tail)`` rows, chained where no gap lies between: ``tail`` is the last time and whether an error stands there."""
    order = Window.partitionBy(*keys).orderBy("first")
    before = F.lag("tail.at").over(order)
    cut = F.when(F.col("first") - before <= GAP, 0).otherwise(1)
    numbered = rows.withColumn("cut", cut).withColumn("n", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "n").agg(F.min("first").alias("first"), F.max("tail").alias("tail")).drop("n")


def sessions(clicks: DataFrame) -> DataFrame:
    """``clicks(client_id, ts, kind)`` → ``(client, first, last, is_open)`` a session, times in microseconds."""
    at = clicks.where("client_id is not null and ts is not null").select(F.col("client_id").alias("client"), micros("ts").alias("at"), F.coalesce(F.col("kind") == "error", F.lit(False)).alias("error"))
    piece = F.expr(f"(at - pmod(at, {GAP}L)) div {GAP}L")
    pieces = at.groupBy("client", piece.alias("piece")).agg(F.min("at").alias("first"), F.max(F.struct("at", "error")).alias("tail"))
    day = F.expr(f"(first - pmod(first, {DAY}L)) div {DAY}L")
    daily = materialise(_chained(pieces.select("client", day.alias("day"), "first", "tail"), ["client", "day"]), "daily")
    reaches = (F.col("first") - F.col("day") * F.lit(DAY) < GAP) | (F.col("tail.at") >= (F.col("day") + 1) * F.lit(DAY) - GAP)
    across = _chained(daily.where(reaches).select("client", "first", "tail"), ["client"])
    return daily.where(~reaches).select("client", "first", "tail").union(across).select("client", "first", F.col("tail.at").alias("last"), F.col("tail.error").alias("is_open"))


def session_intervals(clicks: DataFrame) -> DataFrame:
    """``(key, s, e, n, crc)``: sessions summed up by client and slots; crc: the sum of the crc32 of their first times."""
    slots = F.lit(SLOT_HOURS * 3600 * 1_000_000)

    def at(name: str) -> Column:
        return F.floor((F.col(name) - F.pmod(F.col(name), slots)) / slots).cast("int")

    crc = F.crc32(F.col("first").cast("string").cast("binary"))
    each = sessions(clicks).select(F.col("client").alias("key"), at("first").alias("s"), F.when(F.col("is_open"), OPEN).otherwise(at("last")).alias("e"), crc.alias("crc"))
    return each.groupBy("key", "s", "e").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """``(sale_id, key, s, e)`` of every sale that has a client and a time."""
    shipped = lines.where("sale_id is not null and shipped_at is not null").select("sale_id", slot("shipped_at").alias("shipped"))
    shipped = shipped.groupBy("sale_id").agg(F.max("shipped").alias("shipped"))
    each = sales.where("client_id is not null and sold_at is not null").select("sale_id", F.col("client_id").alias("key"), slot("sold_at").alias("s"), (F.col("status") == "open").alias("unended"))
    end = F.when(F.col("unended"), OPEN).otherwise(F.greatest("s", "shipped"))
    return each.join(shipped.hint("merge"), "sale_id", "left").select("sale_id", "key", "s", end.alias("e"))


def relation() -> Column:
    """The relation of the outer interval ``(s, e)`` to the inner one ``(s2, e2)``."""
    by_end = lambda earlier, equal, later: F.when(F.col("e") < F.col("e2"), earlier).when(F.col("e") == F.col("e2"), equal).otherwise(later)
    return (
        F.when(F.col("s") < F.col("s2"), by_end("overlaps", "finished_by", "contains"))
        .when(F.col("s") == F.col("s2"), by_end("starts", "equals", "started_by"))
        .otherwise(by_end("during", "finishes", "overlapped_by"))
    )


def _size(c: int) -> int:
    return FINEST * RATIO**c


def _class_of(slots: Column, last: int, span: int = 1) -> Column:
    """The least class whose granules, ``span`` of them, are no shorter."""
    out = F.lit(last)
    for c in range(last - 1, -1, -1):
        out = F.when(slots <= span * _size(c), c).otherwise(out)
    return out


def overlapping(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """``outer(key, s, e)``, ``inner(key, s, e, n, crc)``, both distinct → ``(key, s, e, relation, n_pairs, overlap_slots, crc)``."""
    inner = materialise(inner.withColumn("e", F.greatest("s", "e")), "inner")
    length = F.col("e") - F.col("s") + 1
    first, last, longest, opened = inner.agg(F.min("s"), F.max("s"), F.max(F.when(F.col("e") < OPEN, length)), F.max(F.col("e") == OPEN)).first()
    if first is None:
        first = last = 0
    top = 0
    while SPAN * _size(top) < last - first + 1 or (longest or 0) > _size(top):
        top += 1
    closed = inner.where(F.col("e") < OPEN).withColumn("c", _class_of(length, top)).withColumn("least", F.col("c"))
    unended = inner.where(F.col("e") == OPEN).withColumn("c", F.lit(-1)).withColumn("least", F.lit(0))
    occurring = [*([-1] if opened else []), *sorted(r.c for r in closed.select("c").distinct().collect())]
    sizes = F.array(*(F.lit(_size(c)) for c in range(top + 1)))
    granule = lambda at, size: F.floor((at - F.lit(first)) / size).cast("int")
    groups = closed.union(unended).withColumn("size", F.explode(F.slice(sizes, F.col("least") + 1, top + 1)))
    groups = groups.select("key", "c", "size", granule(F.col("s"), F.col("size")).alias("granule"), F.col("s").alias("s2"), F.col("e").alias("e2"), "n", "crc")
    begin, end = F.greatest("s", F.lit(first)), F.least("e", F.lit(last))
    probes = []
    for c in occurring:  # a class's probes: the granule size, and the granules from and to
        level = _class_of(end - (F.lit(first) if c < 0 else begin) + 1, top, SPAN)
        size = F.get(sizes, level if c < 0 else F.greatest(level, F.lit(c)))
        start = F.lit(0) if c < 0 else F.greatest(granule(begin, size) - 1, F.lit(0))
        probes.append(F.struct(F.lit(c).alias("c"), size.alias("size"), start.alias("from"), granule(end, size).alias("to")))
    probing = outer.withColumn("probe", F.explode(F.array(*probes) if probes else F.expr("array(named_struct('c', 0, 'size', 1, 'from', 0, 'to', -1))")))
    probing = probing.where("probe.to >= probe.from").select("key", "s", "e", "probe.c", "probe.size", F.explode(F.sequence("probe.from", "probe.to")).alias("granule"))
    pairs = probing.join(groups.hint("merge"), ["key", "c", "size", "granule"]).where("s2 <= e and s <= e2")
    shared = F.least("e", "e2") - F.greatest("s", "s2") + 1
    both_open = (F.col("e") == OPEN) & (F.col("e2") == OPEN)
    pairs = pairs.select("key", "s", "e", relation().alias("relation"), "n", F.when(~both_open, shared * F.col("n")).alias("slots"), "crc")
    return pairs.groupBy("key", "s", "e", "relation").agg(F.sum("n").alias("n_pairs"), F.sum("slots").alias("overlap_slots"), F.sum("crc").alias("crc"))


def related_sales(sales: DataFrame, lines: DataFrame, clicks: DataFrame) -> DataFrame:
    """``(sale_id, relation, n_pairs, overlap_slots, sessions_crc)`` of every sale that shares a slot with a session of its client."""
    each = materialise(sale_intervals(sales, lines), "sales")
    found = overlapping(each.select("key", "s", "e").distinct(), session_intervals(clicks))
    placed = each.join(found.hint("merge"), ["key", "s", "e"])
    return placed.groupBy("sale_id", "relation").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("overlap_slots").alias("overlap_slots"), F.sum("crc").alias("sessions_crc"))


def op12_overlaps(spark, sf_dir: str) -> DataFrame:
    """All sales with the click sessions of their clients, by relation."""
    sales, lines, clicks = (table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clicks"))
    return related_sales(sales, lines, clicks)


#: DuckDB has no crc32: its table by rule, then one fold over the digits.
_CRC = """crc_table as (select list(c order by i) as t from (select i, list_reduce(list_prepend(cast(i as bigint), cast(range(8) as bigint[])),
    lambda a, b: case when a % 2 = 1 then xor(3988292384, a >> 1) else a >> 1 end) as c from range(256) r(i)))"""
_CRC_OF = """xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(f as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)))"""

ORACLE = f"""with {_CRC},
  k as (select client_id, ts, kind, case when ts - lag(ts) over w <= interval 15 minute then 0 else 1 end as cut from clicks
        where client_id is not null and ts is not null window w as (partition by client_id order by ts)),
  n as (select *, sum(cut) over (partition by client_id order by ts rows unbounded preceding) as n from k),
  g as (select client_id, n, min(ts) as a, max(ts) as z from n group by all),
  q as (select g.client_id, epoch_us(a) as f, epoch_us(z) as l, bool_or(n.kind = 'error') as opened from g join n on n.client_id = g.client_id and n.n = g.n and n.ts = g.z group by all),
  i as (select client_id, {_CRC_OF} as crc, cast(floor(f / 21600000000) as bigint) as s2, case when coalesce(opened, false) then 9999999999 else cast(floor(l / 21600000000) as bigint) end as e2 from q, crc_table),
  h as (select sale_id, max(shipped_at) as shipped from sale_lines group by 1),
  o as (select sale_id, client_id, cast(floor(epoch_us(sold_at) / 21600000000) as bigint) as s,
          case when status = 'open' then 9999999999 else cast(floor(epoch_us(greatest(sold_at, coalesce(shipped, sold_at))) / 21600000000) as bigint) end as e
        from sales left join h using (sale_id) where client_id is not null and sold_at is not null),
  p as (select sale_id, crc, case when e = 9999999999 and e2 = 9999999999 then null else least(e, e2) - greatest(s, s2) + 1 end as shared,
          case when s < s2 then case when e < e2 then 'overlaps' when e = e2 then 'finished_by' else 'contains' end
               when s = s2 then case when e < e2 then 'starts' when e = e2 then 'equals' else 'started_by' end
               else case when e < e2 then 'during' when e = e2 then 'finishes' else 'overlapped_by' end end as relation
        from o join i using (client_id) where s2 <= e and s <= e2)
  select sale_id, relation, count(*) as n_pairs, cast(sum(shared) as bigint) as overlap_slots, cast(sum(crc) as bigint) as sessions_crc from p group by 1, 2"""
