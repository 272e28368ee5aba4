"""Structured data over all pages: one Arrow pass gives items, issues, nodes and references; the rest is joins and aggregations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions import structured as one
from sitegrain.functions.html import read_page, schema_items
from sitegrain.functions.slices import slices

SCHEMA = """items array<struct<seq:int,kind:string,id:string,json:string,issues:array<struct<level:string,property:string,message:string>>>>,
nodes array<struct<seq:int,kind:string,id:string,json:string>>, refs array<struct<seq:int,property:string,kind:string,id:string>>,
roots array<int>, tree array<struct<node:int,parent:int,depth:int,circular:boolean>>"""


def _page(html: str | None, url: str | None) -> dict:
    facts = read_page(html, url)
    found = [x for raw in facts["json_ld"] for x in schema_items(raw)] + one.microdata(html) + one.rdfa(html)
    items = one.merge_items(found)
    page = facts | {"url": url}
    sound = [x for x in items if not x.get("__error")]
    nodes, references = one.entities(sound)
    roots, tree = one.hierarchy(sound)
    text = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False)
    name = lambda x: x.get("@id") if isinstance(x.get("@id"), str) else None
    return {
        "items": [{"seq": i, "kind": one.kind_of(x), "id": name(x), "json": text(x), "issues": [dict(zip(("level", "property", "message"), y)) for y in one.issues(x, page)]} for i, x in enumerate(items)],
        "nodes": [{"seq": i, "kind": one.kind_of(x), "id": name(x), "json": text(x)} for i, x in enumerate(nodes)],
        "refs": [{"seq": i, "property": k, "kind": one.kind_of(t), "id": name(t)} for i, k, t in references],
        "roots": roots, "tree": [dict(zip(("node", "parent", "depth", "circular"), r)) for r in tree],
    }


def _read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for html, url in slices(batches):
        yield pd.DataFrame([_page(h, u) for h, u in zip(html, url)], columns=["items", "nodes", "refs", "roots", "tree"])


def read_structured(html: str | Column, url: str | Column) -> Column:
    return F.pandas_udf(_read, SCHEMA)(html, url)


def extracted(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` → url and the columns of SCHEMA; write it once, the functions below read it."""
    return pages.select("url", read_structured("html", "url").alias("s")).select("url", "s.*")


def validated(found: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """One row an item: url, seq, kind, errors, warnings, valid; of the given kinds only, if any."""
    rows = found.select("url", F.explode("items").alias("x")).select("url", "x.*")
    level = lambda name: F.size(F.filter("issues", lambda i: i["level"] == name))
    said = lambda text: F.size(F.filter("issues", lambda i: i["message"].startswith(text)))
    rows = rows.select(
        "url", "seq", "kind", "id", level("error").alias("errors"), level("warning").alias("warnings"), said("mismatch").alias("mismatches"),
        said("authority").alias("authorities"), (said("unreadable") > 0).alias("unreadable"),
    ).withColumn("valid", F.col("errors") == 0)
    return rows.where(F.lower("kind").isin([k.lower() for k in kinds])) if kinds else rows


def issue_rows(found: DataFrame) -> DataFrame:
    """One row an issue: url, seq, kind, level, property, message."""
    rows = found.select("url", F.explode("items").alias("x"))
    return rows.select("url", "x.seq", "x.kind", F.explode("x.issues").alias("i")).select("url", "seq", "kind", "i.*")


def totals(items: DataFrame) -> DataFrame:
    """Items, valid and invalid ones, errors, warnings and the completeness index, in one row."""
    points = -15 * F.col("errors") - 5 * F.col("warnings") - 5 * F.col("mismatches") + F.least(F.lit(15), 5 * F.col("authorities"))
    points = F.when(F.col("unreadable"), -50).otherwise(points)
    return items.withColumn("points", points).agg(
        F.count("*").alias("items"), F.count_if("valid").alias("valid"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"),
        F.greatest(F.lit(0), F.least(F.lit(100), 100 + F.coalesce(F.sum("points"), F.lit(0)))).alias("completeness"),
    )


def nodes(found: DataFrame) -> DataFrame:
    return found.select("url", F.explode("nodes").alias("n")).select("url", "n.*")


def edges(found: DataFrame) -> DataFrame:
    """References with the node they lead to, on any page for an id; resolved where that node has an id and is known."""
    refs = found.select("url", F.explode("refs").alias("r")).select("url", "r.*")
    own = nodes(found).select("url", "seq", F.col("kind").alias("from_kind"), F.col("id").alias("from_id"))
    known = nodes(found).where("id is not null").groupBy(F.col("id").alias("to_id")).agg(F.min("kind").alias("to_kind"))
    rows = refs.join(own, ["url", "seq"]).join(known, refs.id == known.to_id, "left")
    kind = F.coalesce("to_kind", F.when(F.col("kind") != "", F.col("kind")))
    return rows.select("url", "from_kind", "from_id", "property", kind.alias("to_kind"), F.col("id").alias("to_id"), F.col("to_kind").isNotNull().alias("resolved"))


def unresolved(found: DataFrame) -> DataFrame:
    """References by id alone to an entity that no page describes."""
    return edges(found).where("to_id is not null and not resolved and to_kind is null").drop("resolved", "to_kind")


def isolated(found: DataFrame) -> DataFrame:
    """Named nodes without any edge."""
    e = edges(found)
    linked = e.select(F.col("from_id").alias("id")).union(e.select(F.col("to_id").alias("id"))).where("id is not null").distinct()
    return nodes(found).where("id is not null").join(linked, "id", "left_anti").select("url", "kind", "id")


def conflicts(found: DataFrame) -> DataFrame:
    """Properties of which nodes of one type and id hold several values; nodes without id are compared with each other."""
    entries = F.map_entries(F.from_json("json", "map<string,string>"))
    props = nodes(found).where("kind <> ''").select("kind", "id", F.explode(entries).alias("e")).where(~F.col("e.key").isin("@id", "@type", "@context"))
    counted = props.groupBy("kind", "id", F.col("e.key").alias("property")).agg(F.count_distinct("e.value").alias("n_values"), F.count("*").alias("n_nodes"))
    return counted.where("n_values > 1")


def coverage(found: DataFrame) -> DataFrame:
    """One row: entities, references, resolved ones and their share, types present and those expected but missing."""
    n = nodes(found).agg(F.count("*").alias("entities"), F.array_sort(F.collect_set(F.when(F.col("kind") != "", F.col("kind")))).alias("types"))
    e = edges(found).agg(F.count("*").alias("refs"), F.count_if("resolved").alias("resolved"))
    share = F.when(F.col("refs") > 0, F.floor(F.col("resolved") * 100.0 / F.col("refs") + 0.5)).otherwise(100)
    expected = F.array(*map(F.lit, one.EXPECTED_TYPES))
    return n.crossJoin(e).select("entities", "refs", "resolved", share.cast("int").alias("coverage"), "types", F.array_except(expected, "types").alias("missing"))


def mermaid(edges_: DataFrame) -> DataFrame:
    """The entity graph as text, one line an edge in order, in one row of the report."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("unnamed")), r"[^A-Za-z0-9_]", "_")
    line = F.concat(F.lit("  "), safe(F.coalesce("from_id", "from_kind")), F.lit(" -->|"), F.col("property"), F.lit("| "), safe(F.coalesce("to_id", "to_kind")))
    return edges_.select(line.alias("line")).distinct().agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("graph"))
