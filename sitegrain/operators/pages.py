"""Page facts: one row a page, extracted once by JVM-side expressions and shared by all rules."""

from __future__ import annotations

from sitegrain.plans.dialect import CAPTURE_COLUMNS, Dialect, plan

#: Bytes assumed for an asset whose size is unknown.
ASSET_BYTES = {"js": 35000, "css": 15000, "img": 60000}
WIDTH, HEIGHT = (rf'(?is)\s{side}=["\x27]?[^"\x27\s>]' for side in ("width", "height"))


def strip_html(d: Dialect, html: str) -> str:
    """Script and style blocks and tags become spaces, white space is collapsed; entities stay."""
    x = d.repl(html, r"(?is)<script[^>]*>.*?</script>", " ")
    x = d.repl(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = d.repl(x, r"<[^>]+>", " ")
    return f"trim({d.repl(x, r'[ \t\n\r\f]+', ' ')})"


def word_count(d: Dialect, text: str) -> str:
    return f"case when {text} = '' then 0 else {d.big(d.size(d.split(text, ' ')))} end"


def norm_title(d: Dialect, title: str) -> str:
    return f"lower(trim({d.repl(title, r'[ \t\n\r\f]+', ' ')}))"


def _meta(d: Dialect, name: str) -> str:
    return f"""nullif(trim({d.rx('html', rf'(?is)<meta[^>]+name=["\x27]{name}["\x27][^>]*content=["\x27]([^"\x27]*)["\x27]')}), '')"""


def facts(d: Dialect) -> str:
    """WITH entries ``base`` and ``facts`` over ``pages``; load time, depth and headers are the capture's, or their defaults."""
    own = ", ".join(c if d.name == "spark" else f"{default} as {c}" for c, default in CAPTURE_COLUMNS.items())
    return f"""
    base as (
      select page_id, url, coalesce(html, '') as html, {own} from pages
    ),
    facts as (
      select page_id, url, html,
        lower({d.rx('url', r'^([A-Za-z][A-Za-z0-9+.-]*):')}) as scheme,
        lower({d.rx('url', r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)')}) as host,
        coalesce(nullif({d.rx('url', r'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)')}, ''), '/') as path,
        nullif(trim({d.rx('html', r'(?is)<title[^>]*>(.*?)</title>')}), '') as title,
        {d.map(d.all('html', r'(?is)<h1[^>]*>(.*?)</h1>'), 'x', f"trim({d.repl('x', r'<[^>]+>', '')})")} as h1,
        {d.count('html', r'(?is)<h2[^>]*>')} as n_h2,
        {d.count('html', r'(?is)<h3[^>]*>')} as n_h3,
        {_meta(d, 'description')} as description,
        {_meta(d, 'robots')} as robots,
        {_meta(d, 'viewport')} as viewport,
        nullif({d.rx('html', r'(?is)<link[^>]+rel="canonical"[^>]*href="([^"]*)"')}, '') as canonical,
        {d.filter(d.all('html', r'(?is)<a\s[^>]*href="([^"]*)"'), 'h', f"not {d.has('h', r'^(?:#|javascript:|mailto:|tel:)')}")} as hrefs,
        {d.count('html', r'(?is)<img\s[^>]*src=')} as n_images,
        {d.big(d.size(d.filter(d.all('html', r'(?is)<img\s[^>]*>', 0), 'i', f"not ({d.has('i', WIDTH)} and {d.has('i', HEIGHT)})")))} as n_undimensioned,
        {d.filter(d.all('html', r'(?is)<(?:script[^>]+src|link[^>]+stylesheet)[^>]*>', 0), 'x', d.has('x', r'(?i)(?:src|href)=.(?:https?:)?//'))} as outside,
        {d.all('html', r'(?is)<h([1-6])[\s>]')} as levels,
        {d.all('html', r'(?is)<link[^>]+hreflang=[^>]*>', 0)} as alternates,
        {d.join(d.all('html', r'(?is)<script[^>]+type="application/ld.json"[^>]*>(.*?)</script>'), ' ')} as json_ld,
        {d.big(d.size(d.filter(d.all('html', r'(?is)<img\s[^>]*>', 0), 'i', f"not {d.has('i', r'(?i)alt="[^"]*[^" ][^"]*"')}")))} as n_missing_alt,
        {d.count('html', r'(?is)<meta[^>]+property="og:')} as n_og,
        {d.count('html', r'(?is)<meta[^>]+name="twitter:')} as n_twitter,
        {d.count('html', r'(?is)<meta[^>]+name="twitter:card"')} as n_twitter_card,
        {d.count('html', r'(?is)<script[^>]+type="application/ld.json"')} as n_jsonld,
        {d.count('html', r'(?is)<script[^>]+src=')} as n_js,
        {d.count('html', r'(?is)<link[^>]+rel="[^"]*stylesheet')} as n_css,
        {d.count('html', r'(?is)<link[^>]+hreflang=')} as n_hreflang,
        {d.count('html', r'(?is)<(?:nav|menu)[\s>]')} as n_nav,
        {d.count('html', r'(?is)<(?:article|main|section)[\s>]')} as n_semantic,
        {d.count('html', r'(?is)<(?:ul|ol|table)[\s>]')} as n_lists,
        {d.count('html', r'(?is)<(?:button|a)[\s>]')} as n_taps,
        {d.count('html', r'(?is)<form[^>]+action="http:')} as n_http_forms,
        {d.count('html', r'(?is)<(?:img|script|iframe)[^>]+src="http:')} as n_http_assets,
        {d.bytes('html')} as html_bytes,
        {strip_html(d, 'html')} as body_text,
        {', '.join(CAPTURE_COLUMNS)}
      from base
    )"""


def enriched(d: Dialect) -> str:
    """Adds ``page_facts``: counts, resource estimates and estimated web vitals."""
    return f"""{facts(d)},
    counted as (
      select *, {norm_title(d, "coalesce(title, '')")} as norm_title, {word_count(d, 'body_text')} as words,
        {d.big(d.size('h1'))} as n_h1,
        {d.big(d.size('hrefs'))} as n_links,
        {d.big(d.size(d.filter('hrefs', 'h', f"{d.has('h', r'^(?:https?:)?//')} and lower({d.rx('h', r'^(?:https?:)?//([^/?#]+)')}) <> host")))} as n_external,
        n_js * {ASSET_BYTES['js']} as js_bytes, n_css * {ASSET_BYTES['css']} as css_bytes, n_images * {ASSET_BYTES['img']} as img_bytes,
        1 + n_js + n_css + n_images as n_requests
      from facts
    ),
    vitals as (
      select *, n_links - n_external as n_internal,
        floor(load_ms * (1.1e0 + 0.1e0 * n_js + 0.02e0 * n_images) + 0.5e0) as lcp,
        floor(least(0.5e0, 0.03e0 * n_undimensioned) * 100e0 + 0.5e0) / 100e0 as cls,
        floor(80e0 + 15e0 * n_js + least(300e0, js_bytes / 5000e0) + 0.5e0) as inp
      from counted
    ),
    page_facts as (
      select *,
        floor(greatest(0e0, least(100e0,
          0.4e0 * greatest(0e0, case when lcp > 4000 then 50e0 - (lcp - 4000) / 50e0 when lcp > 2500 then 100e0 - (lcp - 2500) / 15e0 else 100e0 end)
          + 0.3e0 * greatest(0e0, case when cls > 0.1e0 then 100e0 - (cls - 0.1e0) * 333e0 else 100e0 end)
          + 0.3e0 * greatest(0e0, case when inp > 200 then 100e0 - (inp - 200) / 3e0 else 100e0 end))) + 0.5e0) as performance
      from vitals
    )"""


@plan("nrm01_title", "pages")
def nrm01(d: Dialect) -> str:
    return f"with {enriched(d)} select page_id, title, norm_title from page_facts"


@plan("nrm04_headings", "pages")
def nrm04(d: Dialect) -> str:
    return f"with {enriched(d)} select page_id, n_h1, n_h2, n_h3, {d.at('h1', '0')} as first_h1 from page_facts"


@plan("nrm05_links", "pages")
def nrm05(d: Dialect) -> str:
    return f"""with {facts(d)}, links as (select page_id, host, {d.explode('hrefs')} as href from facts)
    select page_id, href, {d.has('href', r'^(?:https?:)?//')} as is_absolute,
      case when {d.has('href', r'^(?:https?:)?//')} then lower({d.rx('href', r'^(?:https?:)?//([^/?#]+)')}) = host else true end as is_internal
    from links"""


@plan("nrm02_meta", "pages")
def nrm02(d: Dialect) -> str:
    return f"with {enriched(d)} select page_id, description, robots, viewport, canonical, n_images, n_missing_alt, n_hreflang, n_og, n_twitter, n_jsonld from page_facts"


@plan("nrm14_resources", "pages")
def nrm14(d: Dialect) -> str:
    return f"with {enriched(d)} select page_id, js_bytes, css_bytes, img_bytes, n_requests, html_bytes, js_bytes + css_bytes + img_bytes + html_bytes as total_bytes from page_facts"


@plan("nrm15_cwv_estimate", "pages")
def nrm15(d: Dialect) -> str:
    return f"with {enriched(d)} select page_id, cast(lcp as double) as lcp, cast(cls as double) as cls, cast(inp as double) as inp from page_facts"


@plan("nrm16_cwv_score", "pages")
def nrm16(d: Dialect) -> str:
    return f"with {enriched(d)} select page_id, cast(performance as bigint) as performance from page_facts"


@plan("src04_asset_urls", "pages")
def src04(d: Dialect) -> str:
    parts = {
        "js": r'(?is)<script[^>]+src="([^"]+)"',
        "css": r'(?is)<link[^>]+rel="[^"]*stylesheet[^"]*"[^>]*href="([^"]+)"',
        "img": r'(?is)<img[^>]+src="([^"]+)"',
        "anchor": r'(?is)<a\s[^>]*href="([^"]+)"',
    }
    union = " union all ".join(
        f"select page_id, '{k}' as kind, {d.explode(d.distinct(d.all('html', p)))} as asset from base" for k, p in parts.items()
    )
    return f"with base as (select page_id, coalesce(html, '') as html from pages) {union}"


@plan("src05_resource_weights", "pages")
def src05(d: Dialect) -> str:
    """Sizes known for some assets, at most 40 a page and kind, else the estimate."""
    return f"""with base as (select page_id, {d.explode(d.distinct(d.all("coalesce(html, '')", r'(?is)<a\s[^>]*href="([^"]+)"')))} as asset from pages),
    ranked as (select page_id, asset, row_number() over (partition by page_id order by asset) as rn from base),
    sizes as (select distinct asset, {d.big('length(asset) * 1000')} as known from base where length(asset) % 2 = 0)
    select page_id, {d.big('sum(case when rn <= 40 then coalesce(known, 35000) else 35000 end)')} as js_bytes, count(*) as n_assets
    from ranked left join sizes using (asset) group by page_id"""


@plan("src11_sitemap_locs", "pages")
def src11(d: Dialect) -> str:
    return f"""with xml as (
      select page_id, concat('<urlset><url><loc> ', url, ' </loc></url><url><LOC>', url, '/a</LOC></url></urlset>') as x from pages
    ) select page_id, {d.explode(d.all('x', r'(?i)<loc>\s*(https?://[^\s<]+)\s*</loc>'))} as loc from xml"""


@plan("src18_access_log", "events")
def src18(d: Dialect) -> str:
    """Combined log format: kept are status 200 to 399 with a foreign referrer."""
    line = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) [^"]*" (\d{3}) (\S+) "([^"]*)" "([^"]*)"'
    own = "example.com"
    return f"""with log as (
      select event_id, concat('10.0.0.', cast(user_id % 250 as varchar(9)), ' - - [01/Jan/2024:00:00:00 +0000] "GET /p', cast(user_id as varchar(20)), ' HTTP/1.1" ',
        cast(case when event_type = 'error' then 500 when event_type = 'view' then 304 else 200 end as varchar(9)), ' 123 "',
        case when user_id % 4 = 0 then '-' when user_id % 4 = 1 then 'https://www.{own}/x' else concat('https://blog', cast(user_id % 7 as varchar(9)), '.example.org/r') end,
        '" "agent"') as line from events
    ), parsed as (
      select event_id, {d.rx('line', line, 4)} as target, {d.big(f"nullif({d.rx('line', line, 5)}, '')")} as status,
        {d.rx('line', line, 7)} as referrer from log
    ), hosted as (
      select *, {d.repl(f"lower({d.rx('referrer', r'^https?://([^/?#]+)')})", r'^www\.', '')} as ref_host from parsed
    ) select event_id, target, referrer, ref_host, status from hosted
    where status between 200 and 399 and referrer <> '-' and ref_host <> '{own}'"""


@plan("flt01_glob_filter", "pages")
def flt01(d: Dialect) -> str:
    """Include */en/*, exclude *ref=x*; anchored, case-insensitive, on the path with query and on the whole URL."""
    inc, exc = r"(?i)^.*/en/.*$", r"(?i)^.*ref=x.*$"
    rel = d.rx("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)")
    return f"""with rel as (select page_id, url, {rel} as rel from pages)
    select page_id, url from rel where ({d.has('rel', inc)} or {d.has('url', inc)}) and not ({d.has('rel', exc)} or {d.has('url', exc)})"""


@plan("flt06_url_class", "pages")
def flt06(d: Dialect) -> str:
    commercial = r"/(?:products?|services?|pricing|buy|shop|checkout|cart)"
    utility = r"/(?:login|logout|register|signup|admin|account|privacy|terms|search|contact|about|faq|help|sitemap)(?:/|$)"
    return f"""select page_id, {d.has('lower(url)', commercial)} as is_commercial, {d.has('lower(url)', utility)} as is_utility,
      {d.has('lower(url)', r'\?')} as has_query, {d.has('url', r'#')} as has_fragment from pages"""


@plan("src10_robots_allowed", "pages")
def src10(d: Dialect) -> str:
    """Disallow rules as patterns (* any, $ end) against each path; a page is allowed if none matches."""
    rules = ["/fr/", "/*.html$", "/en/4"]
    rows = " union all ".join(f"select '{r}' as rule_path" for r in rules)
    literal = d.repl("rule_path", r"([.+?()\[\]{}|^\\])", r"\\\\$1" if d.name == "spark" else r"\\\1")
    pattern = f"concat('^', replace({literal}, '*', '.*'))"
    match = f"path rlike pattern" if d.name == "spark" else "regexp_matches(path, pattern)"
    return f"""with rules as ({rows}), compiled as (select rule_path, {pattern} as pattern from rules),
    paths as (select page_id, {d.rx('url', r'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)')} as path from pages)
    select page_id, path, count(rule_path) = 0 as allowed, count(rule_path) as n_rules
    from paths left join compiled on {match} group by page_id, path"""


@plan("fn04_strip_html", "pages")
def fn04(d: Dialect) -> str:
    return f"with t as (select page_id, {strip_html(d, 'html')} as body_text from pages) select page_id, body_text, {word_count(d, 'body_text')} as words from t"


@plan("fn09_url_parts", "pages")
def fn09(d: Dialect) -> str:
    host = f"lower({d.rx('url', r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)')})"
    bare = d.repl(host, r"^www\.", "")
    return f"""select page_id, {host} as host, {bare} as bare_host, {d.rx(host, r'([^.]+\.[^.]+)$')} as registered_domain,
      {d.repl(d.repl('url', r'#.*$', ''), r'/+$', '')} as normal_url, lower({d.repl('url', r'/$', '')}) as canonical_key from pages"""
