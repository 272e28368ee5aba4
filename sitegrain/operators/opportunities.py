"""Search opportunities: six generators over pages, findings and search data, merged, ranked and counted.

Inputs: ``pages(url, title, depth, in_degree, is_orphan, n_schemas, has_vitals)``,
``findings(url, rule_id, severity, category, message, recommendation)``,
``gsc(url, impressions, clicks, ctr, position)`` and ``crux(url, lcp, cls, inp)``;
the last two may be None. Side data joins by exact URL. Nulls in depth count as
depth 3; a page or URL without search data is scored by depth alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds, what easiness adds, severity points, valuable paths, utility paths, thresholds.
EASE = {"metadata": 10, "schema": 5, "content": 2, "internal-links": 0, "performance": -5, "indexing": -10}
SEVERITY_POINTS = {"critical": 10, "error": 7, "warning": 4}
VALUABLE = r"/product|/service|/pricing|/checkout|/cart|/store|\.(?:com|org)/?$"
UTILITY = r"/login|/logout|/register|/admin|/api/|/search\?|/cdn-cgi/"
SCHEMA_UTILITY = r"/login|/logout|/register|/api/|/cdn-cgi/"
CONTENT_RULES, CONTENT_MESSAGES = "thin|content|word-count|duplicate|heading|h1", "content|word count|thin text"
SCHEMA_NEEDS = (
    ("Product Schema", r"/product|/item|/store", "product|shop"), ("Article Schema", "/blog|/article|/news|/post", "article|blog"),
    ("FAQ Schema", "/faq", "faq|frequently asked questions"), ("AboutPage Schema", "/about", "about us|who we are"),
)
HIGH, MEDIUM, NO_SEARCH_DATA = 70, 40, 0.8
KINDS = tuple(EASE)
GSC = "url string, impressions bigint, clicks bigint, ctr double, position double"
CRUX = "url string, lcp double, cls double, inp double"


def _round(x: Column) -> Column:
    return F.floor(x + 0.5)


def score(kind: Column, severity: Column) -> Column:
    """1 to 100: visibility .4, severity .3 and business value .3, plus the ease of a fix, less without search data."""
    known, depth = F.col("known"), F.coalesce("depth", F.lit(3))
    by_depth = lambda a, b, c, d: F.when(depth == 0, a).when(depth == 1, b).when(depth == 2, c).otherwise(d)
    seen = F.least(F.lit(6.0), F.log10(F.col("impressions") + 1.0) * 1.5)
    placed = F.when(F.coalesce("position", F.lit(99.0)) <= 10, 4).when(F.col("position") <= 20, 2).otherwise(0)
    visibility = F.when(known, F.least(F.lit(10.0), F.when(F.col("impressions") > 0, seen).otherwise(0.0) + placed)).otherwise(by_depth(8, 6, 4, 2))
    points = F.lit(1)
    for s, n in reversed(SEVERITY_POINTS.items()):
        points = F.when(severity == s, n).otherwise(points)
    points = F.when(severity.isNull(), 5).otherwise(points)
    business = F.when(F.lower("url").rlike(VALUABLE), 10).otherwise(by_depth(10, 8, 6, 4))
    ease = F.lit(0)
    for k, n in EASE.items():
        ease = F.when(kind == k, n).otherwise(ease)
    raw = (visibility * 0.4 + points * 0.3 + business * 0.3) * 10 + ease
    return _round(F.greatest(F.lit(1.0), F.least(F.lit(100.0), raw)) * F.when(known, 1.0).otherwise(NO_SEARCH_DATA))


def priority(score_: Column) -> Column:
    return F.when(score_ >= HIGH, "high").when(score_ >= MEDIUM, "medium").otherwise("low")


def _known(pages: DataFrame, gsc: DataFrame | None) -> DataFrame:
    """Pages with their search data; a URL that the export repeats counts by its last values."""
    spark = pages.sparkSession
    rows = gsc if gsc is not None else spark.createDataFrame([], GSC)
    rows = last_rows(rows).withColumn("known", F.lit(True))
    return pages.join(rows, "url", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "impressions": F.coalesce("impressions", F.lit(0)), "ctr": F.coalesce("ctr", F.lit(0.0))})


def _grouped(findings: DataFrame, cond: Column) -> DataFrame:
    worst = F.when(F.bool_or(F.col("severity") == "critical"), "critical").otherwise("error")
    return findings.where(cond).groupBy("url").agg(
        worst.alias("severity"), F.count("*").alias("n_findings"), F.array_sort(F.collect_set("rule_id")).alias("rules"),
        F.bool_or(F.col("rule_id").rlike("thin|word-count")).alias("thin"),
    )


def _severe(category: str) -> Column:
    return (F.col("category") == category) & F.col("severity").isin("error", "critical")


def _made(df: DataFrame, kind: str, first: Column, boosts: list[tuple[Column, Column, str]], high: Column | None = None) -> DataFrame:
    """Applies boosts (condition, points, signal) to the first score; the priority rises to high at HIGH where a boost held."""
    total, signals, rose = first, [], F.lit(False)
    for cond, points, signal in boosts:
        held = F.coalesce(cond, F.lit(False))
        total = F.when(held, F.least(F.lit(100), total + points)).otherwise(total)
        signals.append(F.when(held, F.lit(signal)))
        rose = rose | held
    named = F.when(rose & (total >= HIGH), "high").otherwise(priority(first)) if high is None else high
    return df.select(
        F.lit(kind).alias("kind"), "url", "title", total.cast("bigint").alias("score"), named.alias("priority"),
        F.filter(F.array(*signals), lambda s: s.isNotNull()).alias("signals"), F.lit(ACTIONS[kind]).alias("action"),
    )


#: What each kind asks for.
ACTIONS = {
    "metadata": "Complete the title and the description", "performance": "Make images and scripts lighter", "indexing": "Review canonical, robots and alternate tags",
    "internal-links": "Link to the page from strong pages", "schema": "Describe the page in structured data", "content": "Deepen the text and its headings",
}


def metadata(pages: DataFrame, findings: DataFrame) -> DataFrame:
    df = _grouped(findings, _severe("metadata")).hint("merge").join(pages, "url")
    low = (F.col("impressions") > 1000) & (F.col("ctr") < 0.02)
    return _made(df, "metadata", score(F.lit("metadata"), F.col("severity")), [(low, F.lit(15), "seen often and clicked rarely")])


def performance(pages: DataFrame, findings: DataFrame, crux: DataFrame | None = None) -> DataFrame:
    df = _grouped(findings, _severe("performance")).hint("merge").join(pages, "url")
    field = crux if crux is not None else pages.sparkSession.createDataFrame([], CRUX)
    df = df.join(field.dropDuplicates(["url"]).select("url", F.lit(True).alias("field")), "url", "left")
    visible = (F.col("known") & ((F.col("impressions") > 500) | (F.col("position") < 20))) | F.col("url").rlike("/product|/service|/pricing")
    visible = F.coalesce(visible, F.lit(False))
    first = score(F.lit("performance"), F.col("severity"))
    total = F.when(visible & (first < 60), F.least(F.lit(100), first + 15)).otherwise(first)
    named = F.when(visible, F.when(total >= HIGH, "high").otherwise(priority(first))).otherwise(F.when(priority(first) == "high", "medium").otherwise(priority(first)))
    return _made(df, "performance", first, [(visible & (first < 60), F.lit(15), "visible or important"), (F.col("field"), F.lit(0), "measured by visitors")], named)


def indexing(pages: DataFrame, findings: DataFrame) -> DataFrame:
    df = _grouped(findings, _severe("indexing")).hint("merge").join(pages, "url")
    df = df.where(~(F.lower("url").rlike(UTILITY) | F.coalesce(F.col("depth") >= 4, F.lit(False))))
    strong = F.col("known") & ((F.col("impressions") > 100) | F.coalesce(F.col("position") < 20, F.lit(False)))
    near = ~strong & (F.col("depth") <= 1)
    return _made(df, "indexing", score(F.lit("indexing"), F.col("severity")), [(strong, F.lit(15), "ranks in spite of it"), (near, F.lit(5), "close to the start page")])


def internal_links(pages: DataFrame) -> DataFrame:
    df = pages.where((F.col("is_orphan") | (F.coalesce("in_degree", F.lit(0)) == 0)) & ~F.lower("url").rlike(UTILITY))
    valuable = F.col("known") & (F.col("impressions") > 100)
    return _made(df, "internal-links", score(F.lit("internal-links"), F.lit(None).cast("string")), [(valuable, F.lit(20), "an orphan that is found in search")])


def schema(pages: DataFrame) -> DataFrame:
    df = pages.where((F.coalesce("n_schemas", F.lit(0)) == 0) & ~F.lower("url").rlike(SCHEMA_UTILITY))
    need = F.when(F.coalesce(F.col("depth") == 0, F.lit(False)), "Organization / WebSite Schema")
    for name, in_url, in_title in reversed(SCHEMA_NEEDS):
        need = F.when(F.lower("url").rlike(in_url) | F.lower(F.coalesce("title", F.lit(""))).rlike(in_title), name).otherwise(need)
    df = df.withColumn("need", need)
    deep = F.col("need").isNull() & (F.coalesce("depth", F.lit(3)) > 2) & ~(F.col("known") & (F.col("impressions") > 100))
    product, ranks = F.coalesce(F.col("need") == "Product Schema", F.lit(False)), F.col("known") & F.coalesce(F.col("position") < 30, F.lit(False))
    first = score(F.lit("schema"), F.lit(None).cast("string"))
    total = F.least(F.lit(100), first + F.when(product, 10).otherwise(0) + F.when(ranks, 10).otherwise(0))
    return _made(df.where(~deep), "schema", first, [(product, F.lit(10), "a product page"), (ranks, F.lit(10), "on the first pages of search")], priority(total))


def content(pages: DataFrame, findings: DataFrame) -> DataFrame:
    cond = F.lower("rule_id").rlike(CONTENT_RULES) | F.lower(F.coalesce("message", F.lit(""))).rlike(CONTENT_MESSAGES)
    df = _grouped(findings, cond).hint("merge").join(pages, "url")
    mismatch = (F.col("position") < 15) & (F.col("ctr") < 0.015) & (F.col("impressions") > 300)
    thin = F.col("thin") & (F.col("impressions") > 500)
    return _made(df, "content", score(F.lit("content"), F.col("severity")), [(mismatch, F.lit(15), "ranks well and is clicked rarely"), (thin, F.lit(10), "thin and seen often")])


def opportunities(pages: DataFrame, findings: DataFrame, gsc: DataFrame | None = None, crux: DataFrame | None = None) -> DataFrame:
    """One row a kind and URL: the best score, the union of signals and actions; see ``ranked`` for the order."""
    known = _known(pages, gsc)
    every = [metadata(known, findings), performance(known, findings, crux), indexing(known, findings), internal_links(known), schema(known), content(known, findings)]
    union = every[0]
    for df in every[1:]:
        union = union.unionByName(df)
    return merged(union)


def merged(rows: DataFrame) -> DataFrame:
    """Rows of one kind and URL as one: the best score and its priority, all actions and signals once."""
    return rows.groupBy("kind", "url").agg(
        F.max("title").alias("title"), F.max("score").alias("score"), F.max_by("priority", "score").alias("priority"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("signals"), F.array_sort(F.collect_set("action")).alias("actions"),
    )


def ranked(rows: DataFrame, top: int | None = None, least: str = "low") -> DataFrame:
    """Score first, then priority, then URL in dictionary order; ``top`` and ``least`` are the report's limits."""
    order = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    rows = rows.where(order <= {"high": 0, "medium": 1, "low": 2}[least]).orderBy(F.desc("score"), order, F.collate("url", "UNICODE"), "kind")
    return rows.limit(top) if top is not None else rows


def summary(rows: DataFrame) -> DataFrame:
    """Opportunities by kind and priority, kinds without any included."""
    kinds = rows.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    counts = rows.groupBy("kind").pivot("priority", ["high", "medium", "low"]).count()
    return kinds.join(counts, "kind", "left").na.fill(0)


def enriched_pages(pages: DataFrame, gsc: DataFrame, crux: DataFrame) -> int:
    """How many pages have search or field data."""
    return pages.join(gsc.select("url").union(crux.select("url")).distinct(), "url", "left_semi").distinct().count()


def last_rows(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The last row of each URL, for exports that repeat URLs: by ``seq``, and without one the greatest by its values, so that reruns agree."""
    rest = [c for c in rows.columns if c not in ("url", seq)]
    order = F.struct(*([seq] if seq in rows.columns else []), *rest)
    return rows.groupBy("url").agg(F.max_by(F.struct(*rest), order).alias("_last")).select("url", "_last.*")
