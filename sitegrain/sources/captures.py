"""Captured responses and side data as tables: page scans, redirects, caches, response weights, search and field data, backlink exports, images."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hops of a redirect chain, bytes of unknown assets, assets weighed a kind, CDN headers and servers, query modifiers, vitals' steps.
HOPS = 5
UNKNOWN_BYTES, WEIGHED = {"js": 35000, "css": 15000, "image": 60000}, 40
CDN_HEADERS = ("x-cache", "cf-ray", "cf-cache-status", "x-amz-cf-id", "x-cloudfront", "x-fastly", "fastly-rekey", "x-akamai-cln", "x-edge-location", "x-sucuri-id", "server-timing")
CDN_SERVERS = "cloudflare|cloudfront|akamai|fastly"
GENERIC_MODIFIERS = ("best", "how to", "guide", "services", "pricing", "alternatives", "tips", "near me", "examples", "solutions")
QUESTIONS = ("who", "what", "when", "where", "why", "how", "can", "is", "are", "does")
CAPTURE = {
    "status_code": ("int", "200"), "load_time_ms": ("bigint", "0"), "content_type": ("string", "'text/html'"), "headers": ("map<string,array<string>>", "map()"),
    "error": ("string", "null"), "raw_html": ("string", "null"), "redirect_chain": ("array<struct<url:string,status_code:int>>", "array()"),
}


def capture_scan(pages: DataFrame, seq: str | None = None) -> DataFrame:
    """Captures with every column of the record; what a table doesn't have takes its default. crawl_seq is the order of capture."""
    have = {c.lower() for c in pages.columns}
    missing = [F.expr(f"cast({default} as {kind})").alias(c) for c, (kind, default) in CAPTURE.items() if c not in have]
    order = F.col(seq) if seq else F.monotonically_increasing_id() if "page_id" not in have else F.col("page_id")
    return pages.select("*", *missing, *([] if "crawl_seq" in have else [order.cast("bigint").alias("crawl_seq")]))


def redirect_chains(start: DataFrame, redirects: DataFrame, hops: int = HOPS) -> DataFrame:
    """``start(url)``, ``redirects(url, target, status)`` → (url, final, chain, looped, broken_off): at most ``hops`` equi-joins."""
    at = start.select("url", F.col("url").alias("final"), F.array().cast("array<struct<url:string,status:int>>").alias("chain"), F.lit(False).alias("looped"))
    steps = redirects.select(F.col("url").alias("_from"), "target", F.col("status").cast("int").alias("status"))
    for _ in range(hops):
        on = (F.col("final") == F.col("_from")) & ~F.col("looped")
        at = at.join(steps, on, "left").select(
            "url", F.coalesce("target", "final").alias("final"),
            F.when(F.col("target").isNotNull(), F.concat("chain", F.array(F.struct(F.col("_from").alias("url"), "status")))).otherwise(F.col("chain")).alias("chain"),
            (F.col("looped") | F.coalesce(F.exists(F.transform("chain", lambda c: c["url"]), lambda u: u == F.col("target")) | (F.col("target") == F.col("_from")), F.lit(False))).alias("looped"),
        )
    more = steps.select(F.col("_from").alias("final")).distinct().withColumn("broken_off", F.lit(True))
    return at.join(more, "final", "left").select("url", "final", "chain", "looped", F.coalesce(F.col("broken_off") & ~F.col("looped"), F.lit(False)).alias("broken_off"))


def cached(entries: DataFrame, now: Column | None = None) -> DataFrame:
    """Cache entries that hold; the key is the URL's SHA-256."""
    return entries.where(F.col("expires_at") >= (F.current_timestamp() if now is None else now)).withColumn("key", F.sha2("url", 256))


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def response_weights(responses: DataFrame) -> DataFrame:
    """``responses(page, resource_type, content_type, bytes)`` → bytes and requests by page and kind, of any browser capture."""
    kind = (
        F.when((F.col("resource_type") == "script") | F.col("content_type").contains("javascript"), "js")
        .when((F.col("resource_type") == "stylesheet") | F.col("content_type").contains("css"), "css")
        .when((F.col("resource_type") == "image") | F.col("content_type").startswith("image/"), "image")
        .when((F.col("resource_type") == "document") | F.col("content_type").contains("html"), "html").otherwise("other")
    )
    return responses.groupBy("page", kind.alias("kind")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("requests"))


def asset_weights(assets: DataFrame, sizes: DataFrame) -> DataFrame:
    """``assets(page, kind, url)``, ``sizes(url, bytes)`` → bytes by page and kind: known sizes of the first assets of a kind, the estimate for the rest."""
    rank = F.row_number().over(Window.partitionBy("page", "kind").orderBy("url"))
    guess = F.lit(0)
    for k, n in UNKNOWN_BYTES.items():
        guess = F.when(F.col("kind") == k, n).otherwise(guess)
    rows = assets.distinct().withColumn("rn", rank).join(sizes.dropDuplicates(["url"]), "url", "left")
    return rows.groupBy("page", "kind").agg(F.sum(F.when(F.col("rn") <= WEIGHED, F.coalesce("bytes", guess)).otherwise(guess)).alias("bytes"), F.count("*").alias("requests"))


def _norm(url: str) -> Column:
    return F.regexp_replace(F.lower(url), "/+$", "")


def vitals_score(lcp: Column, cls: Column, inp: Column) -> Column:
    """0 to 100: .4 for paint, .3 for shift, .3 for response."""
    a = F.when(lcp > 4000, 50 - (lcp - 4000) / 50).when(lcp > 2500, 100 - (lcp - 2500) / 15).otherwise(100)
    b = F.when(cls > 0.1, 100 - (cls - 0.1) * 333).otherwise(100)
    c = F.when(inp > 200, 100 - (inp - 200) / 3).otherwise(100)
    whole = 0.4 * F.greatest(F.lit(0.0), a) + 0.3 * F.greatest(F.lit(0.0), b) + 0.3 * F.greatest(F.lit(0.0), c)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), whole)) + 0.5)


def overlaid(pages: DataFrame, lab: DataFrame | None = None, field: DataFrame | None = None) -> DataFrame:
    """``pages(url, lcp, cls, inp, performance)`` with laboratory values in place of estimates and field values over both, metric by metric.

    ``lab(url, score, lcp, cls, inp)`` joins by URL, ``field(url, lcp, cls, inp)`` by the URL without case and final slash.
    """
    df = pages.withColumn("vitals_source", F.lit("estimated"))
    if lab is not None:
        l = lab.dropDuplicates(["url"]).select(F.col("url").alias("_u"), F.col("score").alias("_s"), *(F.col(c).alias(f"_{c}") for c in ("lcp", "cls", "inp")))  # noqa: E741
        df = df.join(l, df.url == l._u, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("lcp", "cls", "inp")})
        df = df.withColumns({"performance": F.coalesce(F.floor(F.col("_s") * 100 + 0.5), "performance"), "vitals_source": F.when(F.col("_u").isNotNull(), "lab").otherwise(F.col("vitals_source"))})
        df = df.drop("_u", "_s", "_lcp", "_cls", "_inp")
    if field is not None:
        f = field.withColumn("_u", _norm("url")).dropDuplicates(["_u"]).select("_u", *(F.col(c).alias(f"_{c}") for c in ("lcp", "cls", "inp")))
        any_ = F.coalesce("_lcp", "_cls", "_inp").isNotNull()
        df = df.join(f, _norm("url") == F.col("_u"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("lcp", "cls", "inp")})
        df = df.withColumns({"performance": F.when(any_, vitals_score(F.col("lcp"), F.col("cls"), F.col("inp"))).otherwise(F.col("performance")), "vitals_source": F.when(any_, "field").otherwise(F.col("vitals_source"))})
        df = df.drop("_u", "_lcp", "_cls", "_inp")
    return df


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a JSON export, a list or one object with its rows under data, rows or pages, as JSON text with their place."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    rows = F.coalesce(*(F.expr(f"try_variant_get(v, '{p}', 'array<variant>')") for p in ("$", "$.data", "$.rows", "$.pages")))
    return raw.select(F.posexplode(rows).alias("seq", "v"))


def _url(alias: str = "v") -> Column:
    return F.coalesce(*(F.expr(f"try_variant_get({alias}, '$.{k}', 'string')") for k in ("url", "page", "pageUrl")))


def search_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows: url, impressions, clicks, ctr, position, seq; one row: malformed). All four numbers are required."""
    num = lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'double')").alias(k)
    rows = _records(spark, path).select("seq", _url().alias("url"), *map(num, ("impressions", "clicks", "ctr", "position")))
    good = F.col("url").isNotNull() & F.expr("impressions is not null and clicks is not null and ctr is not null and position is not null")
    return rows.where(good), rows.agg(F.count_if(~good).alias("malformed"))


def field_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows: url, lcp, cls, inp, seq; one row: malformed). Metrics may be absent but must be numbers."""
    names = ("lcp", "cls", "inp")
    num = lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'double')").alias(k)
    there = [F.expr(f"try_variant_get(v, '$.{k}', 'string')").alias(f"_{k}") for k in names]
    rows = _records(spark, path).select("seq", _url().alias("url"), *map(num, names), *there)
    good = F.col("url").isNotNull()
    for k in names:
        good = good & (F.col(k).isNotNull() | F.col(f"_{k}").isNull())
    return rows.where(good).drop(*(f"_{k}" for k in names)), rows.agg(F.count_if(~good).alias("malformed"))


def suggestion_queries(seeds: DataFrame, modifiers: tuple[str, ...] = GENERIC_MODIFIERS) -> DataFrame:
    """``seeds(seed)`` → (seed, source, query): the seed itself, with modifiers, with question words, with each letter."""
    pick = lambda source, xs, front: F.transform(F.array(*map(F.lit, xs)), lambda x: F.struct(F.lit(source).alias("source"), (F.concat(x, F.lit(" "), "seed") if front else F.concat("seed", F.lit(" "), x)).alias("query")))
    letters = tuple("abcdefghijklmnopqrstuvwxyz")
    direct = F.array(F.struct(F.lit("direct").alias("source"), F.col("seed").alias("query")))
    every = F.concat(direct, pick("semantic", modifiers, False), pick("question", QUESTIONS, True), pick("alphabetical", letters, False))
    return seeds.select("seed", F.explode(every).alias("q")).select("seed", "q.*")


def search_rank(results: DataFrame, domain: str, top: int = 10) -> DataFrame:
    """``results(keyword, position, url)`` → the first position of the domain or a sub-domain among the top, null without one."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    own = (host == domain.lower()) | host.endswith("." + domain.lower())
    return results.groupBy("keyword").agg(F.min(F.when(own & (F.col("position") <= top), F.col("position"))).alias("position"))


def first_engine(hits: DataFrame, order: tuple[str, ...] = ("bing", "brave", "mojeek", "duckduckgo"), top: int = 10) -> DataFrame:
    """``hits(query, engine, position, url)`` → distinct hits of the first engine that has any, at most ``top`` a query."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("engine"))
    ranked = hits.withColumn("_e", place).where("_e > 0").groupBy("query", "_e", "url").agg(F.min("engine").alias("engine"), F.min("position").alias("position"))
    ranked = ranked.withColumn("_first", F.min("_e").over(Window.partitionBy("query"))).where("_e = _first")
    return ranked.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy("position", "url"))).where(F.col("rn") <= top).select("query", "engine", "position", "url")


def is_cdn(headers: Column) -> Column:
    """Whether a response's headers name a delivery network."""
    low = F.transform_keys(headers, lambda k, _: F.lower(k))
    server = F.lower(F.coalesce(F.try_element_at(low, F.lit("server")), F.lit("")))
    return F.arrays_overlap(F.map_keys(low), F.array(*map(F.lit, CDN_HEADERS))) | server.rlike(CDN_SERVERS)


def jpeg_quality(n_bytes: Column, width: Column, height: Column, entropy: Column) -> Column:
    """Estimate from bytes a pixel and entropy, 10 to 100."""
    return F.greatest(F.lit(10.0), F.least(F.lit(100.0), F.floor(n_bytes / (width * height) / F.greatest(entropy, F.lit(1e-9)) * 400 + 0.5)))


def image_header(raw: bytes | None) -> tuple[str | None, int | None, int | None, bool]:
    """(format, width, height, animated) from an image's first bytes; unknown formats give nulls."""
    raw = raw or b""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return "png", *struct.unpack(">II", raw[16:24]), b"acTL" in raw[:1024]
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return "gif", *struct.unpack("<HH", raw[6:10]), raw.count(b"\x21\xf9\x04") > 1
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" and len(raw) >= 30:
        if raw[12:16] == b"VP8X":
            return "webp", 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little"), bool(raw[20] & 2)
        if raw[12:16] == b"VP8L":
            bits = int.from_bytes(raw[21:25], "little")
            return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), False
        return "webp", int.from_bytes(raw[26:28], "little") & 0x3FFF, int.from_bytes(raw[28:30], "little") & 0x3FFF, False
    at = 2 if raw[:2] == b"\xff\xd8" else len(raw)
    while at + 9 < len(raw) and raw[at] == 0xFF:
        if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
            return "jpeg", w, h, False
        at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None, None, None, False


def _headers(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_header(c) for c in content], columns=["format", "width", "height", "animated"])


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, format, width, height, animated) of every file, from any store that Spark reads."""
    read = F.pandas_udf(_headers, "format string, width int, height int, animated boolean")
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.col("length").alias("bytes"), read("content").alias("d")).select("path", "bytes", "d.*")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """``snapshots(host, saved_at, path)`` → the last one of each host."""
    return snapshots.groupBy("host").agg(F.max("saved_at").alias("saved_at"), F.max_by("path", "saved_at").alias("path"))
