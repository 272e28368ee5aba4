"""Images of a site: discovery in page html, rules over image records, scores.

An image record has src, alt, loading, decoding, fetchpriority, width, height, has_aspect_ratio, is_preload, pages (array), seq (order of
discovery) and, where fetched, decoded or rendered: status_code, fetch_failed, bytes, cache_control, is_cdn, format, decoded_width,
is_animated, has_alpha, decode_failed, rendered_width, natural_width, in_viewport, is_lcp. What a table lacks is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.html import resolve
from sitegrain.functions.scalars import cache_facts
from sitegrain.functions.slices import slices

#: Deductions, sizes and budgets in bytes, widths, the images taken to be above the fold.
DEDUCTIONS = {"critical": 35, "error": 20, "warning": 10, "info": 2}
KB = 1024
HEAVY, LEGACY, PNG, PAGE_BUDGET, WASTE = 500 * KB, 50 * KB, 30 * KB, 3 * 512 * KB, 100 * KB
WIDE, DENSITY, SLACK, FOLD, DAY = 600, 1.5, 1.2, 3, 86400
RECORD = {
    "alt": "string", "loading": "string", "decoding": "string", "fetchpriority": "string", "width": "int", "height": "int", "has_aspect_ratio": "boolean", "is_preload": "boolean",
    "pages": "array<string>", "seq": "bigint", "status_code": "int", "fetch_failed": "boolean", "bytes": "bigint", "cache_control": "string", "is_cdn": "boolean", "format": "string",
    "decoded_width": "int", "is_animated": "boolean", "has_alpha": "boolean", "decode_failed": "boolean", "rendered_width": "int", "natural_width": "int", "in_viewport": "boolean", "is_lcp": "boolean",
}
FOUND = "src string, alt string, loading string, decoding string, fetchpriority string, width int, height int, has_aspect_ratio boolean, is_preload boolean"


class _Images(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__()
        self.base, self.found, self.picture = base, [], 0

    def _add(self, src: str | None, **more) -> None:
        if src and not src.startswith("data:") and (url := resolve(src, self.base)):
            names = [f.split()[0] for f in FOUND.split(", ")]
            self.found.append({n: None for n in names} | {"src": url, "has_aspect_ratio": False, "is_preload": False} | more)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v for k, v in reversed(attrs)}
        style = a.get("style") or ""
        size = lambda k: int(m[0]) if (m := re.match(r"\d+", (a.get(k) or "").strip())) else None
        candidates = [p.strip().split(" ")[0] for p in (a.get("srcset") or a.get("imagesrcset") or "").split(",") if p.strip()]
        if tag == "img":
            own = {k: a.get(k) for k in ("alt", "loading", "decoding", "fetchpriority")} | {"width": size("width"), "height": size("height"), "has_aspect_ratio": "aspect-ratio" in style}
            for src in [a.get("src") or a.get("data-src"), *candidates]:
                self._add(src, **own)
        elif tag == "source":
            for src in candidates:
                self._add(src)
        elif tag == "link" and "preload" in (a.get("rel") or "").lower().split() and (a.get("as") or "").lower() == "image":
            self._add(a.get("href"), is_preload=True, fetchpriority=a.get("fetchpriority"))
        for src in re.findall(r"""(?i)url\s*\(\s*['"]?([^'")]+)['"]?\s*\)""", style):
            self._add(src.strip())


def _discover(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, url in slices(batches):
        out = []
        for h, u in zip(html, url):
            p = _Images(u or "")
            p.feed(h or "")
            p.close()
            out.append(p.found)
        yield pd.Series(out)


def discovered(pages: DataFrame) -> DataFrame:
    """``pages(url, html, crawl_seq)`` → one record a src: the first known value of each attribute, all pages it stands on."""
    found = F.pandas_udf(_discover, f"array<struct<{FOUND}>>")("html", "url")
    rows = pages.select("url", "crawl_seq", F.posexplode(found).alias("at", "i")).select("url", "crawl_seq", "at", "i.*")
    order = F.struct("crawl_seq", "at")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    merged = rows.groupBy("src").agg(
        F.min(order).alias("_first"), *map(first, ("alt", "loading", "decoding", "fetchpriority", "width", "height")),
        F.bool_or("has_aspect_ratio").alias("has_aspect_ratio"), F.bool_or("is_preload").alias("is_preload"), F.array_sort(F.collect_set("url")).alias("pages"),
    )
    return merged.withColumn("seq", F.col("_first.crawl_seq") * 1_000_000 + F.col("_first.at")).drop("_first")


def completed(images: DataFrame) -> DataFrame:
    have = set(images.columns)
    return images.select("src", *((F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in RECORD.items()))


def with_runtime(images: DataFrame, runtime: DataFrame) -> DataFrame:
    """Joins ``runtime(src, current_src, rendered_width, natural_width, in_viewport, is_lcp)`` by either of its addresses."""
    keyed = runtime.select(F.explode(F.array_distinct(F.array("src", "current_src"))).alias("src"), "rendered_width", "natural_width", "in_viewport", "is_lcp").where("src is not null").dropDuplicates(["src"])
    return images.drop("rendered_width", "natural_width", "in_viewport", "is_lcp").join(keyed, "src", "left")


def _stem() -> Column:
    path = F.regexp_extract("src", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.substring_index(F.substring_index(path, "-", 1), "_", 1)


def findings(images: DataFrame, threshold_kb: int = 100, rendered: bool = False) -> DataFrame:
    """``(subject, rule_id, severity)``: all image rules in one projection, the variants by an equi-join on file stems, page budgets by one sum."""
    df = completed(images)
    lead = df.orderBy("seq").limit(FOLD).select(F.col("src").alias("_lead"))  # the records found first
    df = df.join(F.broadcast(lead), df.src == lead._lead, "left").withColumn("above", F.coalesce("in_viewport", F.col("_lead").isNotNull())).drop("_lead")
    stems = df.select("src", _stem().alias("stem")).where("stem not in ('', '/')").groupBy("stem").agg(F.count("*").alias("alike"))
    df = df.withColumn("stem", _stem()).join(stems, "stem", "left").withColumn("cache", cache_facts(F.col("cache_control"), F.col("src")))
    yes, fine = lambda c: F.coalesce(F.col(c), F.lit(False)), ~(F.coalesce("fetch_failed", F.lit(False)) | F.coalesce("decode_failed", F.lit(False)))
    lazy, above, preload = F.coalesce(F.col("loading") == "lazy", F.lit(False)), F.col("above"), yes("is_preload")
    broken = yes("fetch_failed") | F.coalesce((F.col("status_code") >= 400) | (F.col("status_code") == 0), F.lit(False))
    kind, size = F.lower("format"), F.coalesce("bytes", F.lit(0))
    moving, solid = (kind == "gif") & yes("is_animated"), (kind == "png") & (F.col("has_alpha") == F.lit(False)) & (size > PNG)
    legacy = kind.isin("jpeg", "png") & (size > LEGACY)
    fit = F.floor(F.col("rendered_width") * DENSITY + 0.5)
    waste = size * (1 - (fit / F.col("natural_width")) * (fit / F.col("natural_width")))
    oversized = fine & (F.col("rendered_width") > 0) & (size > 0) & (F.col("natural_width") > fit * SLACK) & F.lit(rendered)
    lcp = yes("is_lcp") & F.lit(rendered)
    sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)) | yes("has_aspect_ratio")
    old = F.coalesce("cache_control", F.lit("")) == ""
    checks = [
        ("image-weight", "critical", size > HEAVY), ("image-weight", "warning", (size > threshold_kb * KB) & (size <= HEAVY)),
        ("image-format", "warning", fine & (moving | solid | legacy)),
        ("image-delivery", "error", oversized & (waste > WASTE)), ("image-delivery", "warning", oversized & (waste <= WASTE)),
        ("image-loading", "error", above & lazy), ("image-loading", "warning", ~above & ~lazy & ~preload), ("image-decoding", "info", ~above & ~F.coalesce(F.col("decoding") == "async", F.lit(False)) & ~preload),
        ("image-cls", "error", ~sized),
        ("image-lcp", "critical", lcp & lazy), ("image-lcp", "warning", lcp & ~F.coalesce(F.col("fetchpriority") == "high", F.lit(False))), ("image-lcp", "warning", lcp & ~preload),
        ("image-lcp", "warning", lcp & F.col("format").isNotNull() & ~F.col("format").isin("webp", "avif", "svg")),
        ("image-responsive", "info", ~yes("fetch_failed") & (F.coalesce("decoded_width", "width") > WIDE) & (F.coalesce("alike", F.lit(1)) <= 1)),
        ("image-caching", "warning", F.col("status_code").isNotNull() & ~broken & (old | ((F.col("cache.max_age") < DAY) & ~F.col("cache.no_cache")))),
        ("image-cdn", "info", F.col("is_cdn") == F.lit(False)), ("image-immutable", "info", F.col("cache.hashed_name") & ~F.col("cache.immutable") & (F.col("cache.max_age") >= DAY)),
        ("image-alt", "warning", F.trim(F.coalesce("alt", F.lit(""))) == ""),
        ("image-broken", "critical", broken), ("image-mixed-content", "error", ~broken & F.col("src").startswith("http://") & F.exists(F.coalesce("pages", F.array()), lambda p: p.startswith("https://"))),
        ("image-decode-failed", "warning", ~broken & yes("decode_failed")),
    ]
    fired = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(i).alias("place"))) for i, (r, s, c) in enumerate(checks)))
    rows = df.select(F.col("src").alias("subject"), F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("f")).select("subject", "f.*")
    heavy = page_weights(images).where(F.col("bytes") > PAGE_BUDGET)
    return rows.unionByName(heavy.select(F.col("page").alias("subject"), F.lit("page-total-image-weight").alias("rule_id"), F.lit("error").alias("severity"), F.lit(len(checks)).alias("place")))


def page_weights(images: DataFrame) -> DataFrame:
    """``(page, bytes)`` over images of known size."""
    rows = completed(images).where("bytes is not null").select(F.explode("pages").alias("page"), "bytes")
    return rows.groupBy("page").agg(F.sum("bytes").alias("bytes"))


def scores(images: DataFrame, found: DataFrame) -> DataFrame:
    """``(src, bytes, score, worst_rule)``: 100 less each finding's deduction; the first rule among those that cost most."""
    cost = F.lit(0)
    for s, n in DEDUCTIONS.items():
        cost = F.when(F.col("severity") == s, n).otherwise(cost)
    by = found.withColumn("cost", cost).groupBy(F.col("subject").alias("src")).agg(F.sum("cost").alias("lost"), F.max_by("rule_id", F.struct("cost", -F.col("place"))).alias("worst_rule"))
    rows = completed(images).select("src", "bytes").join(by, "src", "left")
    return rows.select("src", "bytes", F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).cast("int").alias("score"), "worst_rule")


def site_score(scores_: DataFrame) -> DataFrame:
    """One row: images and their score weighted by bytes (plain where no size is known)."""
    weighed = F.sum(F.col("score") * F.col("bytes")) / F.sum(F.when(F.col("bytes") > 0, F.col("bytes")))
    return scores_.agg(F.count("*").alias("images"), F.floor(F.coalesce(weighed, F.avg("score")) + 0.5).cast("int").alias("score"))
