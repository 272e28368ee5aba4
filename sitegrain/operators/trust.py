"""Page-level judgements: trust pillars, readiness to be cited, content quality, and the network of language alternates.

Inputs are the facts of ``functions.html.extract_page`` beside url and html.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of first-hand experience, names of trust pages, semantic elements, language codes, start and steps of the scores.
EXPERIENCE = ("i tried", "i tested", "i used", "my experience", "in my opinion", "i found", "i review", "my review", "hands-on", "first-hand")
TRUST_PAGES = ("privacy", "contact", "about", "terms", "disclaimer")
SEMANTIC = ("article", "section", "header", "footer", "nav", "aside", "main", "figure", "figcaption")
LANGUAGE = r"^[a-z]{2}(-[A-Z]{2})?$|^x-default$"
BASE, PILLAR_TARGET = 50, 60
AUTHOR = r"(?is)<meta[^>]+name=[\"']author[\"']|class=[\"'][^\"']*author|rel=[\"']author[\"']"


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(phrases))


def _points(*parts: tuple[Column, int]) -> Column:
    total = F.lit(BASE)
    for cond, n in parts:
        total = total + F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    return F.least(F.lit(100), total)


def pillars(pages: DataFrame, backlinks: bool = False) -> DataFrame:
    """``pages(url, html, text, links, json_ld)`` → experience, expertise, authority, trust and overall, 0 to 100 each."""
    html = F.coalesce("html", F.lit(""))
    anchors = F.transform(F.coalesce("links", F.array()), lambda x: F.lower(x["text"]))
    named = lambda word: F.exists(anchors, lambda t: t.contains(word))
    schemas = F.array_join(F.coalesce("json_ld", F.array()), " ")
    inner = F.size(F.filter("links", lambda x: x["is_internal"]))
    outer = F.size(F.filter("links", lambda x: ~x["is_internal"]))
    trust_pages = sum((F.when(named(w), 1).otherwise(0) for w in TRUST_PAGES), start=F.lit(0))
    wiki = F.exists("links", lambda x: x["url"].rlike(r"wikipedia\.org|wikidata\.org"))
    scores = {
        "experience": _points((_says(F.coalesce("text", F.lit("")), EXPERIENCE), 30), (schemas.rlike("Review|Product"), 20)),
        "expertise": _points((html.rlike(AUTHOR), 25), (named("about") | named("bio") | named("credentials"), 15), (schemas.rlike(r'"@type"\s*:\s*(?:\[[^\]]*)?"(?:Person|Organization)"'), 10)),
        "authority": _points((inner > 3, 20), (outer > 0, 20), (F.lit(backlinks), 10)),
        "trust": _points((F.col("url").startswith("https://"), 20), (trust_pages >= 2, 20), (wiki, 10)),
    }
    df = pages.select("url", *(c.alias(k) for k, c in scores.items()))
    return df.withColumn("overall", F.floor((F.col("experience") + F.col("expertise") + F.col("authority") + F.col("trust")) / 4 + 0.5).cast("int"))


def pillar_findings(scores: DataFrame) -> DataFrame:
    """Findings of the trust rule: every pillar below its target."""
    each = F.array(*(F.struct(F.lit(p).alias("sub_check"), F.col(p).alias("score")) for p in ("experience", "expertise", "authority", "trust")))
    rows = scores.select("url", F.explode(each).alias("p")).where(F.col("p.score") < PILLAR_TARGET)
    return rows.select("url", F.lit("eeat-score").alias("rule_id"), "p.sub_check", F.lit("warning").alias("severity"), F.lit("seo").alias("category"), F.concat(F.lit("score "), "p.score").alias("evidence"))


def citation_readiness(pages: DataFrame, llms_hosts: DataFrame | None = None) -> DataFrame:
    """``pages(url, html, json_ld)`` → (url, score, has_schema, semantic, has_llms, has_author); llms_hosts(host) have an llms.txt."""
    html = F.coalesce("html", F.lit(""))
    n = F.size(F.regexp_extract_all(html, F.lit(rf"(?i)<({'|'.join(SEMANTIC)})[\s>]"), 1))
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    hosts = (llms_hosts if llms_hosts is not None else pages.sparkSession.createDataFrame([], "host string")).distinct().select("host", F.lit(True).alias("has_llms"))
    df = pages.withColumn("host", host).join(hosts, "host", "left").select(
        "url", (F.size(F.coalesce("json_ld", F.array())) > 0).alias("has_schema"), (n >= 3).alias("semantic"),
        F.coalesce("has_llms", F.lit(False)).alias("has_llms"), html.rlike(AUTHOR + r"|<address[\s>]").alias("has_author"),
    )
    return df.withColumn("score", _points((F.col("has_schema"), 30), (F.col("semantic"), 20), (F.col("has_llms"), 20), (F.col("has_author"), 15)))


def content_quality(length_score: Column, reading_ease: Column, hierarchy: Column, density: Column) -> Column:
    """Half the sum of the length's score and steps for readability, heading order and links a hundred words."""
    read = F.when(reading_ease >= 60, 25).when(reading_ease >= 40, 15).otherwise(5)
    return F.floor((length_score + read + F.when(hierarchy, 20).otherwise(10) + F.when(density > 1, 20).otherwise(10)) / 2 + 0.5)


def heading_order(h1: Column, h2: Column, h3: Column) -> Column:
    """One main heading, and no third level without a second."""
    return (F.size(h1) == 1) & ((F.size(h3) == 0) | (F.size(h2) > 0))


def alternates(pages: DataFrame) -> DataFrame:
    """``pages(url, hreflang)`` → ``(url, lang, target)``."""
    return pages.select("url", F.explode("hreflang").alias("h")).select("url", "h.lang", F.col("h.url").alias("target"))


def alternate_issues(pages: DataFrame) -> DataFrame:
    """Issues of the network of alternates: links that are not returned in the same language, several defaults, odd codes.

    The link back must carry the language of the link itself, as the audited
    rule compares them. A target that was not captured is not judged.
    """
    links = alternates(pages)
    captured = pages.select(F.col("url").alias("target")).distinct()
    back = links.select(F.col("target").alias("url"), "lang", F.col("url").alias("target")).distinct()
    one_way = links.join(captured, "target", "left_semi").join(back, ["url", "lang", "target"], "left_anti")
    defaults = links.where("lang = 'x-default'").select("target").distinct()
    many = defaults.agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n > 1").select(F.lit(None).cast("string").alias("url"), F.lit("x-default").alias("lang"), "target", F.lit("several-defaults").alias("issue"))
    odd = links.where(~F.col("lang").rlike(LANGUAGE)).select("url", "lang", "target", F.lit("invalid-lang").alias("issue"))
    return one_way.select("url", "lang", "target", F.lit("not-returned").alias("issue")).unionByName(many).unionByName(odd)
