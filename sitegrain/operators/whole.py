"""Queries of the DataFrame operators over the given tables, and independent SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.html import extract_page
from sitegrain.operators import graph, keywords, linkplan, opportunities, surfaces, technology, trust
from sitegrain.operators.rules import set_rules
from sitegrain.plans.dialect import Plan
from sitegrain.plans.stored import materialise


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")


def _read(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Plan(lambda d: f"with {set_rules(d)} {text}", ("pages",)).run(spark, sf_dir)


def dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one HTML pass, written once: page_id, url, html and all facts."""
    pages = _pages(spark, sf_dir)
    return materialise(pages.select("page_id", "url", "html", extract_page("html", "url").alias("p")).select("page_id", "url", "html", "p.*"), "dom")


def nrm05_dom_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dom(spark, sf_dir)
    inner = F.size(F.filter("links", lambda x: x["is_internal"]))
    return d.select("page_id", "title", F.element_at("h1", 1).alias("first_h1"), F.size("links").cast("bigint").alias("n_links"), inner.cast("bigint").alias("n_internal"), F.size("images").cast("bigint").alias("n_images"), F.size("json_ld").cast("bigint").alias("n_json_ld"))


def an03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.pillars(dom(spark, sf_dir))


def an04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.citation_readiness(dom(spark, sf_dir)).select("url", "has_schema", "semantic", "has_author", F.col("score").cast("bigint").alias("score"))


def _link_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the link plan: the DOM's, with degrees and authority from the graph of captured pages."""
    d = dom(spark, sf_dir)
    degrees = _read(spark, sf_dir, "select url, in_degree, out_degree from degrees")
    edges = _read(spark, sf_dir, "select source, target from page_edges")
    strong = graph.authority(graph.pagerank(d.select("url"), materialise(edges, "edges")))
    rows = d.join(degrees.dropDuplicates(["url"]).hint("merge"), "url").join(strong.hint("merge"), "url")
    return rows.select("url", "title", "h1", "h2", F.lit(None).cast("int").alias("depth"), "in_degree", "out_degree", "authority", (F.col("in_degree") == 0).alias("is_orphan"), F.size("json_ld").alias("n_schemas"), "links")


def lp08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkplan.suggestions(_link_facts(spark, sf_dir)).select("source_url", "target_url", "score", "confidence", "relevance", "reason", "anchor_text")


def _opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No search data is given, so pages are scored by depth and findings alone."""
    facts = _link_facts(spark, sf_dir).select("url", "title", "depth", "in_degree", "is_orphan", "n_schemas", F.lit(True).alias("has_vitals"))
    findings = _read(spark, sf_dir, "select url, rule_id, severity, category, sub_check as message, '' as recommendation from findings")
    return opportunities.opportunities(facts, materialise(findings, "findings"))


def op08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.ranked(_opportunities(spark, sf_dir)).select("kind", "url", "score", "priority", F.size("actions").alias("n_actions"))


def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opportunities.summary(materialise(_opportunities(spark, sf_dir), "opportunities"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as suggestions, in order of their keys."""
    parts = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet")
    return parts.select(F.col("p_name").alias("keyword"), F.lit("direct").alias("source"), F.lit(0).alias("idx"), F.col("p_partkey").alias("seq"))


def kw05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keywords.scored(keywords.with_noise(keywords.deduplicated(_names(spark, sf_dir)), "steel"), "steel")
    return rows.select("keyword", "intent", "noise", "score")


def kw07(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = keywords.research(_names(spark, sf_dir), "steel")
    return keywords.clusters(materialise(kept, "keywords"), "steel")


#: What a script does to a sixth of the pages each, as no table holds rendered pages: pattern and replacement; the last sixth stays.
RENDERED = (("<title>", "<title>New "), ("<a ", "<span "), ("</head>", '<link rel="canonical" href="https://rendered.example/"></head>'), ("<h1", "<h2"), ("</head>", '<meta name="robots" content="noindex"></head>'))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a rendered form that Spark derives from them."""
    html = F.col("html")
    for i, (old, new) in enumerate(RENDERED):
        html = F.when(F.col("page_id") % 6 == i, F.replace(F.col("html"), F.lit(old), F.lit(new))).otherwise(html)
    return _pages(spark, sf_dir).select("page_id", "url", F.col("html").alias("raw_html"), html.alias("rendered_html"))


def an09(spark: SparkSession, sf_dir: str) -> DataFrame:
    diffs = surfaces.listed(surfaces.compared(_rendered(spark, sf_dir)), "page_id")
    return diffs.select("page_id", "place", "aspect", "severity", "title", F.size("evidence").alias("n_evidence"))


def agg27(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [*surfaces.SHARES, "overall", *(f"n_{s}" for s in surfaces.SEVERITIES)]
    return surfaces.scored(surfaces.compared(_rendered(spark, sf_dir))).select("page_id", *parts, "strategy", F.array_join("advice", ",").alias("advice"))


#: Markup that an eighth of the pages each carry besides their own, as few given pages hold known markers.
MARKED = (
    '<script src="https://www.googletagmanager.com/gtm.js?id=1"></script>', '<script id="__NEXT_DATA__">{}</script><div data-reactroot></div>', '<meta name="generator" content="WordPress 6"><img src="/wp-content/a.png">',
    '<style data-emotion="mui x"></style><p class="MuiButton-root">x</p>', '<link rel="stylesheet" href="https://fonts.googleapis.com/css"><script>gtag("js")</script>', '<div data-v-app></div>', '<link href="/bootstrap.min.css"><p class="navbar">x</p>',
)


def an07(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*map(F.lit, (*MARKED, "")))
    pages = _pages(spark, sf_dir).select("page_id", "url", "html", F.get(marks, (F.col("page_id") % 8).cast("int")).alias("added"))
    return technology.listed(pages, "page_id").select("page_id", "category", "name", "confidence", "level", F.size("evidence").alias("n_evidence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "nrm05_dom_links": nrm05_dom_links, "an03_trust_pillars": an03, "an04_citation_readiness": an04, 
    "lp08_link_plan": lp08, "opp08_opportunities": op08, "agg19_opportunity_summary": agg19,
    "kw05_scored": kw05, "kw07_clusters": kw07, "an09_js_diff": an09, "agg27_js_impact": agg27, "an07_technology": an07,
}

_TEXT = "replace(replace(replace(trim(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g')), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"
_LINKS = "list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"', 1), lambda h: not regexp_matches(trim(lower(h)), '^(#|javascript:|mailto:|tel:)'))"

_HREFS = "list_transform(list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"([^\"]*)\"', 1), lambda h: not regexp_matches(trim(lower(h)), '^(#|javascript:|mailto:|tel:)')), lambda h: case when h like '%://%' or h like '//%' then h else url || h end)"
#: What each replacement must show, by what the pages hold. A link is internal if its host is the page's.
_JS_DIFFS = f"""s as (select page_id, page_id % 6 as k, html, url, {_HREFS} as hrefs, lower(regexp_extract(url, '://([^/?#]+)', 1)) as host,
      list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda x: trim(x)) as h1s, list_transform(regexp_extract_all(html, '(?is)<h[2-6][^>]*>(.*?)</h[2-6]>', 1), lambda x: trim(x)) as hs,
      regexp_matches(html, '(?is)<link[^>]+rel=.canonical') as canon, regexp_extract(html, '(?is)<meta[^>]+name=.robots.[^>]*>') as robots from pages),
    t as (select *, len(list_filter(hrefs, lambda h: lower(regexp_extract(h, '://([^/?#]+)', 1)) = host)) as n_in, list_filter(h1s, lambda x: x <> '') as ones from s),
    d as (select page_id, 'metadata.title' as aspect, 'high' as severity, 'Title changed by JavaScript' as title, 2 as n_evidence from t where k = 0 and contains(html, '<title>')
      union all select page_id, 'links.internal', 'medium', 'Link count changed between raw and rendered', 2 from t where k = 1 and len(hrefs) > 0
      union all select page_id, 'links.internal', 'low', 'Internal links removed in rendered DOM', least(5, n_in) from t where k = 1 and n_in > 0
      union all select page_id, 'links.external', 'low', 'External links differ between raw and rendered', least(3, len(list_distinct(list_filter(hrefs, lambda h: lower(regexp_extract(h, '://([^/?#]+)', 1)) <> host)))) from t where k = 1 and len(hrefs) > n_in
      union all select page_id, 'indexability.canonical', 'critical', 'Canonical injected by JavaScript', 2 from t where k = 2 and not canon and contains(html, '</head>')
      union all select page_id, 'headings.h1', 'medium', 'H1 heading differs between raw and rendered', 1 from t where k = 3 and len(ones) > 0
      union all select page_id, 'headings.set', 'medium', 'Heading structure differs between raw and rendered', 1 from t where k = 3 and len(list_filter(ones, lambda x: not list_contains(hs, x))) > 0
      union all select page_id, 'indexability.metaRobots', 'critical', 'noindex injected by JavaScript', 2 from t where k = 4 and robots = '' and contains(html, '</head>'))"""

ORACLE_SQL = {
    "an09_js_diff": f"""with {_JS_DIFFS}, o as (select *, list_position(['critical', 'high', 'medium', 'low'], severity) as s, list_position([{', '.join(f"'{a}'" for a in surfaces.ASPECTS)}], aspect) as p from d)
      select page_id, cast(row_number() over (partition by page_id order by s, p, title) - 1 as int) as place, aspect, severity, title, cast(n_evidence as int) as n_evidence from o""",
    "an07_technology": """with p as (select page_id, page_id % 8 as k, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)^.*</head>', ''), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) >= 200 as full_text from pages),
      t as (select page_id, unnest(case k when 0 then ['analytics/Google Tag Manager/75/1'] when 1 then ['frontendFramework/Next.js/60/1', case when full_text then 'renderingStrategy/Hybrid / SSR / SSG/90/0' else 'renderingStrategy/Hybrid / SSR / SSG/80/0' end]
          when 2 then ['cms/WordPress/95/2', case when full_text then 'renderingStrategy/Server-rendered HTML/85/0' else 'renderingStrategy/Server-rendered HTML/70/0' end] when 3 then ['uiLibraries/Material UI/85/2'] when 4 then ['fonts/Google Fonts/75/1']
          when 5 then ['frontendFramework/Vue/60/1', case when full_text then 'renderingStrategy/Client framework with pre-rendered HTML/65/0' else 'renderingStrategy/Likely client-rendered shell/70/0' end] when 6 then ['uiLibraries/Bootstrap/95/2'] else [] end) as r from p)
      select page_id, split_part(r, '/', 1) as category, regexp_extract(r, '^[^/]*/(.*)/[0-9]+/[0-9]+$', 1) as name, cast(regexp_extract(r, '/([0-9]+)/[0-9]+$', 1) as int) as confidence,
        case when cast(regexp_extract(r, '/([0-9]+)/[0-9]+$', 1) as int) >= 80 then 'high' else 'medium' end as level, cast(regexp_extract(r, '/([0-9]+)$', 1) as int) as n_evidence from t""",
    "agg27_js_impact": f"""with {_JS_DIFFS}, c as (select t.page_id, count(*) filter (severity = 'critical') as n_critical, count(*) filter (severity = 'high') as n_high, count(*) filter (severity = 'medium') as n_medium, count(*) filter (severity = 'low') as n_low,
        case when count(*) filter (aspect like 'index%') > 0 then 0 else 100 end as indexability, case when count(*) filter (aspect like 'metadata%') > 0 then 75 else 100 end as metadata,
        case when count(*) filter (aspect like '%canonical') > 0 then 'canonical-ssr' when count(*) filter (aspect like '%Robots') > 0 then 'noindex-raw' when count(*) filter (aspect like 'metadata%') > 0 then 'metadata-ssr'
          when count(*) filter (aspect like 'headings%') > 0 then 'headings-ssr' when count(*) filter (aspect like '%internal') > 0 then 'links-internal-raw' else '' end as advice from t left join d on t.page_id = d.page_id group by t.page_id)
      select page_id, cast(indexability as int) as indexability, cast(100 as int) as content, cast(metadata as int) as metadata, cast(100 as int) as structured_data, cast(100 as int) as crawlability,
        cast(floor(indexability * 0.35 + 25 + metadata * 0.15 + 25 + 0.5) as int) as overall, cast(n_critical as int) as n_critical, cast(n_high as int) as n_high, cast(n_medium as int) as n_medium, cast(n_low as int) as n_low, 'ssr' as strategy, advice from c""",
    "nrm05_dom_links": f"""select page_id, {_TEXT.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title,
      {_TEXT.format("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")} as first_h1, cast(len({_LINKS}) as bigint) as n_links, cast(len({_LINKS}) as bigint) as n_internal,
      cast(len(regexp_extract_all(html, '(?i)<img[^>]*src=')) as bigint) as n_images, cast(len(regexp_extract_all(html, '(?i)application/ld.json')) as bigint) as n_json_ld from pages""",
    "an04_citation_readiness": """with f as (select url, contains(lower(html), 'application/ld+json') as has_schema,
      len(regexp_extract_all(lower(html), '<(article|section|header|footer|nav|aside|main|figure|figcaption)[ \t\n>]')) >= 3 as semantic,
      regexp_matches(lower(html), '<meta[^>]+name=.author.|class=.[^"]*author|rel=.author.|<address[ >]') as has_author from pages)
      select *, cast(least(100, 50 + case when has_schema then 30 else 0 end + case when semantic then 20 else 0 end + case when has_author then 15 else 0 end) as bigint) as score from f""",
}
