"""Internal link plan: orphans and priority pages as targets, scored sources for each, suggestions under joint caps.

``facts(url, title, h1, h2, depth, in_degree, out_degree, authority, is_orphan, n_schemas, links)`` holds a row a page;
links are structs of url and is_internal. Targets are at most ``ORPHANS + PRIORITIES`` rows, so pairing them with all
pages is a scan of the pages. A target needs no more than ``POOL`` sources, as its few places and the sources that
other targets can use up are bounded; only these rows reach the driver, for the greedy choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.functions.scalars import anchor_text, anchor_theme

#: URL patterns, hub bounds, numbers of hubs, targets and suggestions.
COMMERCIAL = "/product|/products|/service|/services|/pricing|/buy|/shop|/checkout|/cart"
UTILITY = ("/login", "/logout", "/register", "/signup", "/admin", "/account", "/privacy", "/terms", "/search", "/contact", "/about", "/faq", "/help", "/sitemap")
HUB_LINKS, HUB_AUTHORITY, HUB_INCOMING, HUBS = 5, 50, 10, 20
ORPHANS, PRIORITIES, FEW_INCOMING = 20, 15, 3
PER_TARGET, PER_SOURCE, MOST = 5, 10, 50
POOL = PER_TARGET + (ORPHANS + PRIORITIES) * PER_TARGET // PER_SOURCE + 1


def normalised(facts: DataFrame) -> DataFrame:
    """Facts with defaults in place of nulls and the URL's classes."""
    low = F.lower("url")
    utility = F.lit(False)
    for p in UTILITY:
        utility = utility | low.endswith(p) | low.contains(p + "/")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("depth", "in_degree", "out_degree", "authority", "n_schemas")}
    return facts.withColumns(zero | {"is_orphan": F.coalesce("is_orphan", F.lit(False)) | (F.coalesce("in_degree", F.lit(0)) == 0), "is_commercial": low.rlike(COMMERCIAL), "is_utility": utility})


def target_score() -> Column:
    score = F.when(F.col("is_orphan"), 25).otherwise(0) + F.when(F.col("is_commercial"), 15).otherwise(0) + F.when(F.col("n_schemas") > 0, 8).otherwise(0)
    score = score + 2 * F.greatest(F.lit(0), 10 - F.col("depth")) + 3 * F.greatest(F.lit(0), 5 - F.col("in_degree"))
    return F.when(F.col("is_utility"), -10).otherwise(score)


def orphans(facts: DataFrame) -> DataFrame:
    """Pages without incoming links, best target first."""
    return normalised(facts).where("is_orphan").withColumn("target_score", target_score()).orderBy(F.desc("target_score"), "url")


def priorities(facts: DataFrame) -> DataFrame:
    """Commercial pages and pages with structured data that are linked already."""
    rows = normalised(facts).where("not is_orphan and (is_commercial or n_schemas > 0)").withColumn("target_score", target_score())
    return rows.where("target_score > 0").orderBy(F.desc("target_score"), "url")


def hubs(facts: DataFrame, most: int = HUBS) -> DataFrame:
    rows = normalised(facts).where(f"not is_utility and (out_degree > {HUB_LINKS} or authority > {HUB_AUTHORITY} or in_degree > {HUB_INCOMING})")
    return rows.orderBy(F.desc("authority"), "url").limit(most)


def _words(*texts: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), r"\s+"), lambda w: F.length(w) > 3))


def _segments(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(url), "/"), lambda s: s != ""))


def _tokens() -> Column:
    last = F.element_at(F.filter(F.split("url", "/"), lambda s: s != ""), -1)
    own = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(last, F.lit("")), "[-_]", " ")), r"\s+"), lambda w: F.length(w) > 2)
    return F.array_distinct(F.concat(_words(F.col("title"), F.array_join("h1", " "), F.array_join("h2", " ")), own))


def _prepared(facts: DataFrame) -> DataFrame:
    return facts.select(
        "url", "title", "depth", "in_degree", "out_degree", "authority", "is_orphan", "is_commercial", "is_utility", _tokens().alias("tokens"),
        _words(F.col("title")).alias("wt"), _words(F.array_join("h1", " ")).alias("w1"), _words(F.array_join("h2", " ")).alias("w2"), _segments(F.col("url")).alias("ws"),
        F.transform(F.filter("links", lambda x: x["is_internal"]), lambda x: x["url"]).alias("out"),
    )


def _shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def candidates(facts: DataFrame) -> DataFrame:
    """Scored pairs of a source and a target, the best ``POOL`` of each target that pass its filters."""
    rows = normalised(facts)
    first = lambda df, n, kind: df.limit(n).withColumns({"_kind": F.lit(kind), "_place": F.row_number().over(Window.orderBy(F.desc("target_score"), "url"))})  # noqa: E731  n rows
    chosen = first(orphans(facts), ORPHANS, 0).unionByName(first(priorities(facts), PRIORITIES, 1).where(F.col("in_degree") < FEW_INCOMING))
    places = chosen.select("url", "_kind", "_place", "target_score")
    t = _prepared(chosen).join(places, "url")
    t = t.select(*(F.col(c).alias(f"t_{c}") for c in t.columns))
    s = _prepared(rows.where("not is_utility")).join(hubs(facts).select(F.col("url").alias("_hub")), F.col("url") == F.col("_hub"), "left")
    pairs = s.join(F.broadcast(t), (F.col("url") != F.col("t_url")) & ~F.array_contains("t_out", F.col("url")) & ~F.array_contains("out", F.col("t_url")))
    size = F.greatest(F.size("tokens"), F.size("t_tokens"))
    topic = F.when((F.size("tokens") > 0) & (F.size("t_tokens") > 0), _shared("tokens", "t_tokens") / size).otherwise(0.0)
    source = F.least(F.lit(30.0), F.col("authority") / 3) + F.least(F.lit(20.0), F.col("in_degree") / 2) + 10 + topic * 15 - 0.5 * F.greatest(F.lit(0), F.col("out_degree") - 50)
    segments = F.size(F.filter(F.array_intersect("ws", "t_ws"), lambda x: F.length(x) > 2)) / F.greatest(F.lit(1), F.size(F.array_union("ws", "t_ws")))
    parts = (("shared title term", _shared("wt", "t_wt"), 3.0), ("shared H1 term", _shared("w1", "t_w1"), 4.0), ("shared H2 term", _shared("w2", "t_w2"), 2.0), ("shared path segment", segments, 2.5))
    relevance = sum((n * w for _, n, w in parts), start=F.lit(0.0))
    signals = F.filter(F.array(*(F.when(n > 0, F.lit(name)) for name, n, _ in parts)), lambda x: x.isNotNull())
    df = pairs.withColumns({"source_score": source, "relevance": relevance, "signals": signals}).where("source_score > 0 and (relevance >= 0.1 or (t__kind = 0 and _hub is not null))")
    score = F.least(F.lit(25.0), F.col("authority") / 3) + F.least(F.lit(15.0), F.col("in_degree") / 2) + F.when(F.col("t_is_orphan"), 20).otherwise(0) + F.when(F.col("t_is_commercial"), 10).otherwise(0)
    score = score + 2 * F.greatest(F.lit(0), 8 - F.col("t_in_degree")) + 1.5 * F.greatest(F.lit(0), 5 - F.col("t_depth")) + 5 * F.col("relevance")
    score = score - F.when(F.col("t_is_utility"), 20).otherwise(0) - 0.3 * F.greatest(F.lit(0), F.col("out_degree") - 40)
    sure = 50 + F.when(F.col("authority") > 70, 20).when(F.col("authority") > 40, 10).otherwise(0) + F.when(F.col("in_degree") > 50, 15).when(F.col("in_degree") > 20, 10).otherwise(0)
    sure = sure + F.when(F.col("t_is_orphan"), 15).otherwise(0) + F.when(F.col("t_is_commercial"), 5).otherwise(0) + F.when(F.col("relevance") > 2, 15).when(F.col("relevance") > 0.5, 8).otherwise(0)
    sure = F.least(F.lit(100), sure + F.when(F.size("signals") >= 2, 5).otherwise(0))
    strength = F.when(F.col("authority") > 50, "High authority ").when(F.col("authority") > 20, "Good authority ").otherwise("")
    goal = F.when(F.col("t_is_orphan"), "linking to orphan page").when(F.col("t_is_commercial"), "linking to underlinked commercial page").otherwise("linking to priority page")
    reason = F.concat(strength, F.lit("page ("), F.col("in_degree").cast("string"), F.lit(" in-links) "), goal)
    rank = F.row_number().over(Window.partitionBy("t_url").orderBy(F.desc("source_score"), "url"))
    return df.select(
        F.col("t__kind").alias("kind"), F.col("t__place").alias("place"), F.col("url").alias("source_url"), F.col("t_url").alias("target_url"), rank.alias("rank"),
        F.greatest(F.lit(0.0), F.floor(score * 10 + 0.5) / 10).alias("score"), F.floor(sure + 0.5).cast("int").alias("confidence"), "relevance", "signals", reason.alias("reason"),
        anchor_text(F.col("t_url"), F.col("t_title")).alias("anchor_text"), anchor_theme(F.col("t_url"), F.col("t_title")).alias("anchor_theme"),
    )


def suggestions(facts: DataFrame, least_confidence: int = 0, most: int = MOST) -> DataFrame:
    """The plan: targets in order, each with its best sources, at most PER_TARGET a target and PER_SOURCE a source; best first."""
    pool = candidates(facts).where((F.col("confidence") >= least_confidence) & (F.col("rank") <= POOL + 100 * (least_confidence > 0)))
    schema, taken, by_source, by_target = pool.schema, [], {}, {}
    for r in pool.orderBy("kind", "place", "rank").collect():  # at most (ORPHANS + PRIORITIES) * POOL rows, or POOL + 100 with a floor
        if by_target.get(r.target_url, 0) < PER_TARGET and by_source.get(r.source_url, 0) < PER_SOURCE:
            by_target[r.target_url] = by_target.get(r.target_url, 0) + 1
            by_source[r.source_url] = by_source.get(r.source_url, 0) + 1
            taken.append(r)
    out = facts.sparkSession.createDataFrame(taken, schema).drop("kind", "place", "rank")
    return out.orderBy(F.desc("score"), F.desc("confidence"), "source_url", "target_url").limit(most)
