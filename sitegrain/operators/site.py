"""One site made of the given pages: every page under one host, with links, canonical targets, alternates, structured data and answers.

The given pages lie on many hosts and lead to no page of the table, so the
rules over several pages find nothing there. Spark derives this site from the
whole table by the page's number; the SQL derives what must be found from the
same numbers, not from html.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.functions.html import extract_page
from sitegrain.operators import directories, linkplan, structured, trust
from sitegrain.operators.rules import captured, set_rules
from sitegrain.plans.dialect import SPARK, over
from sitegrain.plans.stored import once
from sitegrain.sources import captures

HOST = "https://site.example"


def _say(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def pages_of_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, html, status_code, robots_txt_found)`` of the site."""
    n = F.col("page_id")
    when = lambda condition, *parts: F.when(condition, _say(*parts)).otherwise("")
    head = F.concat(
        _say("<html><head><title>Page ", n % 40, "</title>"), when(n % 12 == 4, '<meta name="robots" content="noindex">'),
        when(n % 11 == 3, f'<link rel="canonical" href="{HOST}/p/', n + 1, '">'), when(n % 11 == 4, f'<link rel="canonical" href="{HOST}/p/', n, '/">'),
        when(n % 9 == 0, f'<link rel="alternate" hreflang="de" href="{HOST}/p/', n + 1, '">'), when(n % 9 == 1, '<link rel="alternate" hreflang="d" href="/p/', n - 1, '">'), when(n % 18 == 1, '<link rel="alternate" hreflang="de" href="/p/', n - 1, '">'),
        F.lit("</head><body>"),
    )
    body = F.concat(
        _say('<a href="/p/', (n * 7 + 1) % 97, '">a</a><a href="/p/', F.floor(n / 4) * 4 + 2, f'">b</a><a href="{HOST}/p/', F.floor(n / 2), '">c</a>'),
        when(n % 5 == 0, '<script type="application/ld+json">{"@type":"Product","@id":"#p', n, '","brand":{"@id":"#b', n % 3, '"}}</script>'),
        when(n % 5 == 1, '<script type="application/ld+json">{"@type":"Organization","@id":"#b', n % 7, '","name":"B', n % 2, '"}</script>'),
    )
    status = F.when(n % 23 == 5, 404).when(n % 41 == 7, 0).otherwise(200)
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return pages.select("page_id", _say(f"{HOST}/p/", n).alias("url"), F.concat(head, body, F.coalesce("html", F.lit(""))).alias("html"), status.cast("bigint").alias("status_code"))


def _table(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(once(spark, name, [f"{sf_dir.rstrip('/')}/pages.parquet"], make))


#: What links, titles and canonical targets are found from; findings of single pages and near pages are read by no text below, and not made.
_ROWS = f"with {captured(SPARK)} select page_id, url, scheme, host, path, title, norm_title, robots, canonical, hrefs, status_code, cast(array() as array<string>) as codes from captured"


def read(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the relations of ``set_rules`` for the site, but for findings of single pages and near pages; rows are written once."""
    rows = _table(spark, sf_dir, "site_rows", lambda: over(spark, {"pages": pages_of_site(spark, sf_dir)}, _ROWS))
    near = spark.range(0).selectExpr("id as page_id", "0e0 as likeness", "id as n_others")
    return over(spark, {"stored_rows": rows, "stored_near": near}, f"with {set_rules(SPARK, 'stored_rows', 'stored_near')} {text}")


def dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "site_dom", lambda: pages_of_site(spark, sf_dir).select("page_id", "url", extract_page("html", "url").alias("p")).select("page_id", "url", "p.*"))


def src01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with what the table records and what it doesn't."""
    rows = captures.capture_scan(pages_of_site(spark, sf_dir).withColumn("load_time_ms", F.col("page_id") * 37 % 5000))
    return rows.select("page_id", "url", F.col("status_code").cast("bigint").alias("status_code"), "load_time_ms", "content_type", "crawl_seq")


def site_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "select source, target from page_edges")


def site_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "select page_id, in_degree, out_degree from degrees")


def site_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "select page_id, target, status_code, count(*) as n_links from broken_links group by page_id, target, status_code")


def site_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over several pages, but for near copies, which depend on the given texts."""
    return read(spark, sf_dir, "select page_id, rule_id, sub_check, severity from set_findings where rule_id <> 'duplicate-content-similarity'")


def evidence(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """What a finding rests on, ``most`` pages of it: others of the title, broken targets.

    Ranks are cut to ``most + 1`` before rows are exchanged, so that no group
    is gathered, however many pages share a title.
    """
    text = f"""select g.page_id, 'content-quality' as rule_id, cast(g.others as bigint) as n_pages, g.evidence from (
        select p.page_id, max(t.n) - 1 as others, array_join(slice(filter(array_sort(collect_list(named_struct('i', f.page_id, 'u', f.url))), x -> x.i <> p.page_id), 1, {most}).u, ', ') as evidence
        from page_facts p join same_titles t on lower(p.title) = t.title_key
        join (select * from (select page_id, url, lower(title) as title_key, row_number() over (partition by lower(title) order by page_id) as rn from page_facts where title is not null) where rn <= {most + 1}) f on lower(p.title) = f.title_key
        group by p.page_id) g
      union all select page_id, 'broken-links', cast(max(n) as bigint), array_join(transform(array_sort(collect_list(named_struct('u', target, 's', status_code))), x -> concat(x.u, ' (Status: ', x.s, ')')), ', ') from (
        select page_id, target, status_code, row_number() over (partition by page_id order by target) as rn, count(*) over (partition by page_id) as n from (select distinct page_id, target, status_code from broken_links)) where rn <= {most} group by page_id"""
    return read(spark, sf_dir, text)


def an05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.alternate_issues(dom(spark, sf_dir).select("url", "hreflang"))


def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "site_structured", lambda: structured.extracted(pages_of_site(spark, sf_dir)))
    return structured.coverage(found).select("entities", "refs", "resolved", F.col("coverage").cast("bigint").alias("coverage"), F.size("missing").cast("bigint").alias("n_missing"))


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "site_structured", lambda: structured.extracted(pages_of_site(spark, sf_dir)))


def schema_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between entities of all pages, and whether what they lead to is described anywhere."""
    return structured.edges(_structured(spark, sf_dir)).select("url", "from_kind", "from_id", "property", "to_kind", "to_id", "resolved")


def schema_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.isolated(_structured(spark, sf_dir)).select("url", "kind", "id")


def schema_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = structured.conflicts(_structured(spark, sf_dir))
    return out.select("kind", "id", "property", F.col("n_values").cast("bigint").alias("n_values"), F.col("n_nodes").cast("bigint").alias("n_nodes"))


def link_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the link plan over the site, without authority."""
    degrees = read(spark, sf_dir, "select url, in_degree, out_degree from degrees")
    rows = dom(spark, sf_dir).join(degrees, "url")
    return rows.select("url", "title", "h1", "h2", F.lit(None).cast("int").alias("depth"), "in_degree", "out_degree", F.lit(0.0).alias("authority"), (F.col("in_degree") == 0).alias("is_orphan"), F.size("json_ld").alias("n_schemas"), "links")


def lp02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkplan.orphans(link_facts(spark, sf_dir)).select("url", F.col("target_score").cast("bigint").alias("target_score"))


def lp01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkplan.priorities(link_facts(spark, sf_dir)).select("url", F.col("target_score").cast("bigint").alias("target_score"))


def listed_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best listing of every client in two directories, whose listings Spark derives from clients: names with additions, numbers and sites that some lack."""
    c = spark.read.parquet(f"{sf_dir.rstrip('/')}/clients.parquet").where("client_id is not null")
    n, none = F.col("client_id"), F.lit(None).cast("string")
    phone, site = _say("+1 2", F.lpad((n % 1000000000).cast("string"), 9, "0")), _say("https://www.c", n, ".example/")
    sources = c.select(n.alias("source_id"), "name", phone.alias("phone"), F.col("city").alias("address"), site.alias("website"))
    listings = c.select(
        F.when(n % 2 == 0, "A").otherwise("B").alias("directory"), _say("https://listing.example/", n).alias("url"), F.when(n % 5 == 0, F.lit("Somebody Else")).otherwise(F.concat(F.lit("The "), F.col("name"), F.lit(" Inc"))).alias("name"),
        F.when(n % 3 == 0, none).when(n % 7 == 0, F.lit("+1 999 999 9999")).otherwise(phone).alias("phone"), F.col("city").alias("address"), F.when(n % 4 == 0, site).otherwise(none).alias("website"),
        F.lit(None).cast("array<string>").alias("links"), none.alias("title"), none.alias("snippet"), (n % 11 == 0).alias("own_link"),
    )
    return directories.best(directories.evidence(sources, listings)).select("source_id", "directory", "listing_url", "website_match", "phone_match", F.round("name_score", 6).alias("name_score"), F.round("address_score", 6).alias("address_score"), "confidence", "status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src01_captures": src01, "jon07_site_edges": site_edges, "gra01_site_degrees": site_degrees, "jon04_site_broken_links": site_broken, "rules_site_findings": site_findings, "lim02_evidence": evidence,
    "an05_alternates": an05, "agg21_schema_coverage": agg21, "gra07_schema_edges": schema_edges, "gra08_schema_isolated": schema_isolated, "agg23_schema_conflicts": schema_conflicts, "lp02_targets": lp02, "lp03_priorities": lp01,
    "an15_directory_listings": listed_clients,
}

_LINKS = "l as (select page_id as a, unnest([(page_id * 7 + 1) % 97, page_id // 4 * 4 + 2, page_id // 2]) as b from pages), e as (select distinct a, b from l semi join pages p on l.b = p.page_id)"
_URL = f"'{HOST}/p/' || "
_STATUS = "case when page_id % 23 = 5 then 404 when page_id % 41 = 7 then 0 else 200 end"
_DEGREES = f"{_LINKS}, g as (select page_id, cast(coalesce(i.n, 0) as bigint) as in_degree, cast(coalesce(o.n, 0) as bigint) as out_degree from pages left join (select b, count(*) as n from e group by b) i on i.b = page_id left join (select a, count(*) as n from e group by a) o on o.a = page_id)"
_OWN = "len(regexp_extract_all(html, '(?i)application/ld.json'))"  # the given pages' own blocks
ORACLE_SQL = {
    "src01_captures": f"select page_id, {_URL} page_id as url, cast({_STATUS} as bigint) as status_code, page_id * 37 % 5000 as load_time_ms, 'text/html' as content_type, page_id as crawl_seq from pages",
    "jon07_site_edges": f"with {_LINKS} select {_URL} a as source, {_URL} b as target from e",
    "gra01_site_degrees": f"with {_DEGREES} select page_id, in_degree, out_degree from g",
    "jon04_site_broken_links": f"with {_LINKS}, s as (select page_id, cast({_STATUS} as bigint) as status_code from pages) select a as page_id, {_URL} b as target, status_code, count(*) as n_links from l join s on s.page_id = b where status_code <> 200 group by all",
    "rules_site_findings": f"""with {_DEGREES}, s as (select page_id, {_STATUS} as status from pages), t as (select page_id % 40 as k, count(*) as n from pages group by 1)
      select page_id, 'duplicate-title' as rule_id, 'duplicate' as sub_check, 'error' as severity from pages join t on page_id % 40 = k where n > 1
      union all select page_id, 'content-quality', 'duplicate-title', 'warning' from pages join t on page_id % 40 = k where n > 1
      union all select distinct a, 'broken-links', 'broken-links', 'error' from e join s on s.page_id = b where status <> 200
      union all select page_id, 'canonical-issues', case when (page_id + 1) % 12 = 4 and page_id + 1 in (select page_id from pages) then 'canonical-to-noindex' else 'mismatch' end, case when (page_id + 1) % 12 = 4 and page_id + 1 in (select page_id from pages) then 'critical' else 'warning' end from pages where page_id % 11 = 3
      union all select page_id, 'orphan-page', 'orphan', 'error' from g where in_degree = 0 and page_id > (select min(page_id) from pages)
      union all select min(page_id), 'internal-link-distribution', 'authority-sinks', 'warning' from pages having (select count(*) from g where in_degree >= 5 and out_degree <= 1) > 0""",
    "lim02_evidence": f"""with {_LINKS}, s as (select page_id, {_STATUS} as status from pages), o as (select p.page_id, q.page_id as other, row_number() over (partition by p.page_id order by q.page_id) as rn, count(*) over (partition by p.page_id) as n from pages p join pages q on p.page_id % 40 = q.page_id % 40 and p.page_id <> q.page_id),
      k as (select a, {_URL} b as u, status, row_number() over (partition by a order by {_URL} b) as rn, count(*) over (partition by a) as n from e join s on s.page_id = b where status <> 200)
      select page_id, 'content-quality' as rule_id, max(n) as n_pages, string_agg({_URL} other, ', ' order by other) as evidence from o where rn <= 3 group by page_id
      union all select a, 'broken-links', max(n), string_agg(u || ' (Status: ' || status || ')', ', ' order by u) from k where rn <= 3 group by a""",
    "an05_alternates": f"""select {_URL} page_id as url, 'de' as lang, {_URL} (page_id + 1) as target, 'not-returned' as issue from pages where page_id % 9 = 0 and page_id % 18 <> 0 and page_id + 1 in (select page_id from pages)
      union all select {_URL} page_id, 'd', {_URL} (page_id - 1), 'not-returned' from pages where page_id % 9 = 1 and page_id - 1 in (select page_id from pages) union all select {_URL} page_id, 'd', {_URL} (page_id - 1), 'invalid-lang' from pages where page_id % 9 = 1""",
    "lp02_targets": f"with {_DEGREES} select {_URL} page_id as url, cast(25 + 20 + 15 + case when page_id % 5 < 2 or {_OWN} > 0 then 8 else 0 end as bigint) as target_score from g join pages using (page_id) where in_degree = 0",
    "lp03_priorities": f"with {_DEGREES} select {_URL} page_id as url, cast(8 + 20 + 3 * greatest(0, 5 - in_degree) as bigint) as target_score from g join pages using (page_id) where in_degree > 0 and (page_id % 5 < 2 or {_OWN} > 0)",
    "gra07_schema_edges": f"""with b as (select distinct page_id % 7 as k from pages where page_id % 5 = 1)
      select {_URL} page_id as url, 'Product' as from_kind, '#p' || page_id as from_id, 'brand' as property, case when k is not null then 'Organization' end as to_kind, '#b' || page_id % 3 as to_id, k is not null as resolved from pages left join b on page_id % 3 = k where page_id % 5 = 0""",
    "gra08_schema_isolated": f"select {_URL} page_id as url, 'Organization' as kind, '#b' || page_id % 7 as id from pages where page_id % 5 = 1 and page_id % 7 not in (select page_id % 3 from pages where page_id % 5 = 0)",
    "agg23_schema_conflicts": "select 'Organization' as kind, '#b' || page_id % 7 as id, 'name' as property, count(distinct page_id % 2) as n_values, count(*) as n_nodes from pages where page_id % 5 = 1 group by page_id % 7 having count(distinct page_id % 2) > 1",
    "an15_directory_listings": """with c as (select client_id as n, name, city, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[^a-z0-9]+'), lambda w: length(w) > 1)) as w, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(city, '')), '[^a-z0-9]+'), lambda w: length(w) > 1)) as k from clients where client_id is not null),
      v as (select *, list_filter(w, lambda x: not list_contains(['the', 'and', 'for', 'of', 'inc', 'llc', 'co', 'company', 'corp', 'corporation', 'clinic', 'center', 'services', 'service', 'group', 'healthcare'], x)) as t from c),
      l as (select *, case when n % 5 = 0 then ['somebody', 'else'] else t end as lt, n % 3 <> 0 as has_phone, n % 3 <> 0 and n % 7 <> 0 as own_phone from v),
      p as (select s.n as source_id, case when l.n % 2 = 0 then 'A' else 'B' end as directory, 'https://listing.example/' || l.n as listing_url, s.n = l.n and l.n % 4 = 0 as website_match, s.n = l.n and l.own_phone as phone_match,
          case when len(s.t) > 0 and len(l.lt) > 0 then len(list_intersect(s.t, l.lt)) / cast(len(s.t) as double) else 0 end as ns, case when len(s.k) > 0 and len(l.k) > 0 then len(list_intersect(s.k, l.k)) / cast(len(s.k) as double) else 0 end as sa, l.n % 11 = 0 as own, l.has_phone, l.n as ln,
          l.n % 5 = 0 or l.name is not null as named from v s, l),
      e as (select *, round(least(1.0, case when website_match then 0.55 else 0 end + case when phone_match then 0.25 else 0 end + ns * 0.15 + sa * 0.1 + case when own then 0.1 else 0 end), 6) as confidence, named and ns < 0.6 as bad_name, has_phone and not phone_match as bad_phone
        from p where website_match or (phone_match and (ns >= 0.6 or sa >= 0.5)) or (ns >= 0.75 and sa >= 0.65)),
      b as (select *, row_number() over (partition by source_id, directory order by confidence desc, listing_url) as rn from e)
      select source_id, directory, listing_url, website_match, phone_match, round(ns, 6) as name_score, round(sa, 6) as address_score, confidence,
        case when bad_name and bad_phone then 'Wrong Business Name, Wrong Phone Number' when bad_name then 'Wrong Business Name' when bad_phone then 'Wrong Phone Number' when not has_phone then 'No Phone Number' else 'Issues not found' end as status from b where rn = 1""",
    "agg21_schema_coverage": """with x as (select count(*) filter (page_id % 5 < 2) as entities, count(*) filter (page_id % 5 = 0) as refs from pages), r as (select count(*) as resolved from pages where page_id % 5 = 0 and page_id % 3 in (select page_id % 7 from pages where page_id % 5 = 1))
      select entities, refs, resolved, cast(case when refs > 0 then floor(resolved * 100.0 / refs + 0.5) else 100 end as bigint) as coverage, cast(11 as bigint) as n_missing from x, r""",
}
