"""Backlinks from several sources as one table, and the rules over them.

``links(source_url, target_url, anchor_text, is_dofollow, domain_authority, page_authority, spam_score, first_seen, last_seen, source)``;
columns that a source lacks are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = {
    "source_url": "string", "target_url": "string", "anchor_text": "string", "is_dofollow": "boolean", "domain_authority": "double", "page_authority": "double",
    "spam_score": "double", "first_seen": "timestamp", "last_seen": "timestamp", "source": "string",
}
#: Fixed values of the rules: repeated anchors, weak and spammy links, strong links.
ANCHORS, ANCHOR_SHARE, WEAK, SPAM, RISKY, RISKY_SHARE, STRONG, STRONG_LINKS = 4, 0.5, 15, 50, 3, 0.35, 60, 3


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def completed(links: DataFrame, source: str) -> DataFrame:
    """A source's rows with all columns, named after it."""
    have = set(links.columns)
    return links.select(*((F.col(c) if c in have else F.lit(source) if c == "source" else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()))


def export_links(rows: DataFrame, target: str, most: int = 5000) -> DataFrame:
    """An export's rows whose target is the audited URL or its host, at most ``most`` as the export's own limit says."""
    same = (F.regexp_replace("target_url", "/+$", "") == target.rstrip("/")) | (host(F.col("target_url")) == host(F.lit(target)))
    return completed(rows.where(same & F.col("source_url").isNotNull()).orderBy("source_url", "target_url").limit(most), "gsc")


def log_links(log: DataFrame, origin: str) -> DataFrame:
    """``log(line)`` in combined format → links from foreign referrers of answered requests."""
    pattern = r'^\S+ \S+ \S+ \[([^\]]+)\] "\S+ (\S+) [^"]*" (\d{3}) \S+ "([^"]*)"'
    part = lambda i: F.regexp_extract("line", pattern, i)
    seen = F.try_to_timestamp(part(1), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    rows = log.select(part(4).alias("source_url"), F.concat(F.lit(origin.rstrip("/")), part(2)).alias("target_url"), part(3).alias("status"), seen.alias("first_seen"), seen.alias("last_seen"))
    own = host(F.lit(origin))
    rows = rows.where((F.col("status") >= "200") & (F.col("status") < "400") & ~F.col("source_url").isin("-", "") & (host(F.col("source_url")) != own) & (host(F.col("source_url")) != ""))
    return completed(rows.drop("status"), "logs")


def merged(*sources: DataFrame) -> DataFrame:
    """All sources as one row a source and target: the longest anchor, first and last sighting, first known flags, largest authorities."""
    union = reduce(DataFrame.unionByName, sources)
    return union.groupBy("source_url", "target_url").agg(
        F.max_by("anchor_text", F.struct(F.length("anchor_text"), "anchor_text")).alias("anchor_text"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min_by("is_dofollow", "source").alias("is_dofollow"), F.max("domain_authority").alias("domain_authority"), F.max("page_authority").alias("page_authority"),
        F.min_by("spam_score", "source").alias("spam_score"), F.array_sort(F.collect_set("source")).alias("sources"),
    )


def profile(links: DataFrame, reported: int = 0) -> DataFrame:
    """One row: links (the reported number if that is larger), referring hosts, whether any metric is known."""
    known = F.coalesce("domain_authority", "page_authority", "spam_score").isNotNull()
    return links.agg(F.greatest(F.lit(reported), F.count("*")).alias("total"), F.count_distinct(host(F.col("source_url"))).alias("referring_domains"), F.coalesce(F.bool_or(known), F.lit(False)).alias("has_metrics"))


def findings(links: DataFrame, sources: dict[str, str], first_page: str) -> DataFrame:
    """Findings of the four rules on the first page; sources: name to status (ok, error, not-configured)."""
    spark = links.sparkSession
    row = lambda rule, sub, severity: F.struct(F.lit(rule).alias("rule_id"), F.lit(sub).alias("sub_check"), F.lit(severity).alias("severity"))
    weak = (F.col("domain_authority") <= WEAK) | (F.col("spam_score") >= SPAM)
    known = F.coalesce("domain_authority", "spam_score").isNotNull()
    n = links.agg(F.count("*").alias("n"), F.count_if(weak).alias("weak"), F.count_if(known).alias("known"), F.count_if(F.col("domain_authority") >= STRONG).alias("strong"))
    low, high = "low-authority-backlinks", "missing-high-authority-backlinks"
    risk = F.when(F.col("n") == 0, row(low, "none", "info")).when(F.col("known") == 0, row(low, "limited-metrics", "info"))
    risk = risk.when((F.col("weak") >= RISKY) | (F.col("weak") >= RISKY_SHARE * F.col("n")), row(low, "risky-profile", "warning"))
    strong = F.when((F.col("known") > 0) & (F.col("strong") < STRONG_LINKS), row(high, "too-few", "warning"))
    rows = n.select(F.explode(F.array(risk, strong)).alias("f")).where("f is not null").select("f.*", F.lit(None).cast("string").alias("evidence"))
    anchor = F.lower(F.trim("anchor_text"))
    counts = links.where(anchor != "").groupBy(anchor.alias("evidence")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    heavy = counts.join(F.broadcast(total)).where((F.col("c") >= ANCHORS) | (F.col("c") >= ANCHOR_SHARE * F.col("total")))  # total: one row
    rows = rows.unionByName(heavy.select(F.lit("anchor-text-over-optimization").alias("rule_id"), F.lit("repeated-anchor").alias("sub_check"), F.lit("warning").alias("severity"), "evidence"))
    if "ok" not in sources.values():
        sub = "source-error" if "error" in sources.values() else "not-configured"
        rows = rows.unionByName(spark.createDataFrame([("missing-backlink-data", sub, "info", None)], "rule_id string, sub_check string, severity string, evidence string"))
    return rows.withColumn("url", F.lit(first_page)).withColumn("category", F.lit("backlink_intelligence"))
