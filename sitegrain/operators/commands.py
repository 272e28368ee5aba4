"""What the commands compute beyond single operators: crawl admission, site listings, comparisons, breakdowns and the assembled result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category groups of a comparison, steps of grades, weights of the assistant breakdown, deductions of the printed breakdowns.
FOCUS = {
    "technical": ("performance", "indexing", "accessibility", "mobile_seo", "security"), "content": ("metadata", "seo", "links"), "ai-visibility": ("ai_visibility",),
    "backlinks": ("backlink_intelligence",), "mobile": ("mobile_seo", "performance"),
}
AI_WEIGHTS = {
    "ai-extractability": 17, "ai-entity-clarity": 17, "ai-citation-readiness": 17, "ai-structural-organization": 17, "ai-retrieval-friendliness": 16, "ai-authority-signals": 16,
}
AI_GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))
BACKLINK_POINTS = {"missing-backlink-data": 20, "low-authority-backlinks": 50, "missing-high-authority-backlinks": 40}


def glob_pattern(glob: str) -> str:
    """``*`` is any text, ``?`` any character; anchored, without case."""
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def url_match(url: Column, globs: tuple[str, ...]) -> Column:
    """Whether any glob fits the path with its query or the whole URL."""
    rel = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)", 1)
    out = F.lit(False)
    for g in globs:
        out = out | url.rlike(glob_pattern(g)) | rel.rlike(glob_pattern(g))
    return out


def admitted(links: DataFrame, seen: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), disallowed: DataFrame | None = None, max_pages: int = 100) -> DataFrame:
    """The next round of a crawl: ``links(url, depth)`` that are new, wanted and allowed, as many as still fit, in order of depth and URL.

    ``seen(url)`` holds all queued and visited pages, ``disallowed(host, pattern)`` the robots rules of hosts.
    """
    new = links.groupBy("url").agg(F.min("depth").alias("depth")).join(seen.select("url").distinct(), "url", "left_anti")
    if exclude:
        new = new.where(~url_match(F.col("url"), exclude))
    if include:
        new = new.where(url_match(F.col("url"), include))
    if disallowed is not None:
        new = new.withColumn("_host", F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1))).withColumn("_path", F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+([^#]*)", 1))
        new = new.join(disallowed, (F.col("_host") == F.col("host")) & F.expr("_path rlike pattern"), "left_anti").select("url", "depth")
    return new.orderBy("depth", "url").limit(max(0, max_pages - seen.select("url").distinct().count()))


def crawled(pages: DataFrame) -> DataFrame:
    """What a crawl lists: url, status and load time in order of capture."""
    return pages.select("url", "status_code", "load_time_ms").orderBy("crawl_seq")


def sitemap_check(locations: DataFrame, pages: DataFrame) -> DataFrame:
    """``locations(host, loc)`` → locations, answered with 200, answered otherwise and not captured, by host."""
    status = pages.groupBy(F.col("url").alias("loc")).agg(F.max("status_code").alias("status"))
    rows = locations.distinct().join(status, "loc", "left")
    return rows.groupBy("host").agg(F.count("*").alias("listed"), F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") != 200).alias("failed"), F.count_if(F.col("status").isNull()).alias("unknown"))


def external_links(links: DataFrame, status: DataFrame) -> DataFrame:
    """``links(url, target)``, ``status(target, status_code)`` → links whose target, asked once, doesn't answer well; null counts as not asked."""
    asked = status.groupBy("target").agg(F.max("status_code").alias("status_code"))
    return links.distinct().join(asked, "target").where((F.col("status_code") >= 400) | (F.col("status_code") == 0))


def site_probes(probes: DataFrame) -> DataFrame:
    """``probes(origin, redirects_to_https, has_security_txt)`` → the two findings that belong to a site."""
    each = F.array(F.when(~F.col("redirects_to_https"), F.struct(F.lit("no-https-redirect").alias("sub_check"), F.lit("warning").alias("severity"))), F.when(~F.col("has_security_txt"), F.struct(F.lit("missing-security-txt").alias("sub_check"), F.lit("info").alias("severity"))))
    return probes.select(F.col("origin").alias("url"), F.lit("security").alias("rule_id"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("url", "rule_id", "f.*", F.lit("security").alias("category"))


def focused(rows: DataFrame, focus: str | None) -> DataFrame:
    """Rows of the categories of a comparison's focus; all without one."""
    return rows if focus is None else rows.where(F.col("category").isin(*FOCUS[focus]))


def strong_categories(scores: DataFrame, gap: int = 15) -> DataFrame:
    """``scores(category, score_a, score_b)`` in which the first site leads by a gap."""
    return scores.where(F.col("score_a") - F.col("score_b") >= gap)


def assistant_breakdown(parts: DataFrame) -> DataFrame:
    """``parts(area, score)`` → one row: the weighted score (100 only if all are) and its grade."""
    weight = F.lit(0)
    for area, n in AI_WEIGHTS.items():
        weight = F.when(F.col("area") == area, n).otherwise(weight)
    total = F.floor(F.sum(F.col("score") * weight) / F.sum(weight) + 0.5)
    one = parts.agg(F.when(F.min("score") < 100, F.least(F.lit(99), total)).otherwise(total).cast("int").alias("score"))
    grade = F.lit("F")
    for least, letter in reversed(AI_GRADES):
        grade = F.when(F.col("score") >= least, letter).otherwise(grade)
    return one.withColumn("grade", grade)


def backlink_breakdown(findings: DataFrame, pages: int) -> DataFrame:
    """One row: 100 less the points of each backlink finding over the number of pages."""
    points = F.lit(0)
    for rule, n in BACKLINK_POINTS.items():
        points = F.when(F.col("rule_id") == rule, n).otherwise(points)
    return findings.agg(F.greatest(F.lit(0), F.floor(100 - F.coalesce(F.sum(points), F.lit(0)) / max(1, pages) + 0.5)).cast("int").alias("score"))


def image_variants(images: DataFrame) -> DataFrame:
    """``images(src)`` → (src, variants): other images whose address begins with the same stem."""
    path = F.regexp_extract("src", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    stems = images.withColumn("stem", F.substring_index(F.substring_index(path, "-", 1), "_", 1))
    return stems.join(stems.groupBy("stem").agg((F.count("*") - 1).alias("variants")), "stem").select("src", "variants")


def diff_settings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two ``(key, value)`` tables → keys whose JSON values differ, with both values."""
    a, b = (x.groupBy("key").agg(F.max("value").alias(n)) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, "key", "full").where(~F.col("before").eqNullSafe(F.col("after")))


def audit_result(findings: DataFrame, pages: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: pages audited (failed ones too), findings by severity, category scores as a map and the time."""
    by = findings.groupBy("severity").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("findings"))
    cats = scores.agg(F.map_from_entries(F.collect_list(F.struct("category", F.col("score").cast("int")))).alias("scores"))
    return pages.agg(F.count("*").alias("pages")).join(by).join(cats).withColumn("audited_at", F.current_timestamp())  # three single rows
