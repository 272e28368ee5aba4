"""Audit rules as data: each is a list of conditions over page facts, all evaluated in one projection.

A rule that looks at several pages (duplicates, broken links, canonical
targets, near copies, sinks) is a join or an aggregation instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from sitegrain.operators import signatures
from sitegrain.operators.pages import enriched, strip_html
from sitegrain.plans.dialect import DUCK, STORED, Dialect, Made, Plan, plan
from sitegrain.plans.stored import materialise

Check = tuple[str, str, str]  # sub-check, severity, condition


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    weight: int
    module: str
    checks: tuple[Check, ...] = ()
    stateless: bool = True


def captured(d: Dialect) -> str:
    """Adds ``captured``: page facts with response headers."""
    return f"{enriched(d)}, captured as (select * from page_facts)"


def _directive(d: Dialect, name: str) -> str:
    return d.rx("lower(coalesce(h_csp, ''))", rf"(?:^|;)\s*{name}\s+([^;]*)")


def rules(d: Dialect) -> list[Rule]:
    """The per-page rules; conditions are written in the dialect."""
    has, rx = d.has, d.rx
    csp = "coalesce(h_csp, '') <> ''"
    script = f"coalesce(nullif({_directive(d, 'script-src')}, ''), {_directive(d, 'default-src')})"
    obj = f"coalesce(nullif({_directive(d, 'object-src')}, ''), {_directive(d, 'default-src')})"
    ancestors = has("lower(coalesce(h_csp, ''))", "frame-ancestors")
    age = f"cast(nullif({rx('lower(h_hsts)', r'max-age=(\d+)')}, '') as bigint)"
    https = "scheme = 'https'"
    cookie = "h_cookie is not null"
    question = has("html", r"(?is)<h[23][^>]*>[^<]*\?\s*</h[23]>")
    stats = has("body_text", r"(?i)\d+(?:\.\d+)?\s*(?:%|percent)|\$\d")
    author = has("html", r"(?i)rel=.author|class=.[^>]*author|\bby [A-Z][a-z]+ [A-Z]|written by|author:")
    trust = has("body_text", r"(?i)privacy policy|terms of service|about us|contact us|editorial")
    answer = has("html", r"(?is)<p[^>]*>\s*<(?:strong|b)[\s>]")
    typed = lambda names: has("json_ld", rf'(?i)"@type"\s*:\s*"(?:{names})"')
    entity, faq = typed("organization|person|corporation|localbusiness"), typed("faqpage")
    same_as = has("json_ld", r'"sameAs"\s*:\s*(?:"[^"]*\S[^"]*"|\[\s*[^\]\s])')
    level = lambda i: f"cast({d.at('levels', i)} as int)"
    steps = d.seq("0", f"{d.size('levels')} - 2")
    foreign = r"(?i)(?:src|href)=.(?:https?:)?//([^/?#\x27\"\s>]+)"
    jumps = f"{level('cast(i as int) + 1')} - {level('cast(i as int)')} > 1"
    jump = f"case when {d.size('levels')} < 2 then false else {d.size(d.filter(steps, 'i', jumps))} > 0 end"
    own_alternate = """instr(t, concat('href="', url, '"')) > 0"""
    valid_lang = has("t", r'hreflang="(?:[a-z]{2}(?:-[A-Z]{2})?|x-default)"')
    long_p = d.size(d.filter(d.all("html", r"(?is)<p(?:\s[^>]*)?>([^<]*)"), "p", "length(p) > 1200"))
    r = Rule
    return [
        r("missing-title", "metadata", "critical", 10, "core", (
            ("missing", "critical", "title is null"), ("too-long", "warning", "length(title) > 60"))),
        r("missing-meta-description", "metadata", "error", 7, "core", (
            ("missing", "error", "description is null"), ("too-long", "warning", "length(description) > 160"))),
        r("missing-h1", "seo", "error", 8, "core", (("missing", "error", "n_h1 = 0"),)),
        r("multiple-h1", "seo", "warning", 4, "core", (("multiple", "warning", "n_h1 > 1"),)),
        r("missing-alt-text", "accessibility", "warning", 5, "core", (("missing", "warning", "n_missing_alt > 0"),)),
        r("canonical-issues", "indexing", "error", 7, "core", (
            ("missing", "error", "canonical is null"),)),
        r("noindex-detection", "indexing", "info", 2, "core", (("noindex", "info", "lower(robots) like '%noindex%'"),)),
        r("missing-structured-data", "seo", "warning", 3, "core", (("missing", "warning", "n_jsonld = 0"),)),
        r("social-meta", "metadata", "warning", 6, "core", (
            ("missing-og", "warning", "n_og = 0"), ("missing-twitter", "info", "n_twitter = 0"),
            ("missing-twitter-card", "info", "n_twitter > 0 and n_twitter_card = 0"),
            *((f"missing-og-{k}", "warning", f"n_og > 0 and not {has('html', f'(?i)property=.og:{k}.')}") for k in ("title", "description", "image", "url")))),
        r("content-quality", "seo", "warning", 7, "core", (("thin-content", "warning", "words < 300"),)),
        r("internal-linking", "links", "warning", 5, "core", (
            ("no-outbound-links", "warning", "n_internal = 0"), ("excessive-links", "info", "n_links > 100"), ("deep-link", "info", "depth > 3"))),
        r("missing-robots-txt", "indexing", "error", 6, "core", (("missing", "error", "path = '/' and robots_txt_found = false"),)),
        r("missing-sitemap-xml", "indexing", "error", 6, "core", (("missing", "error", "path = '/' and sitemap_xml_found = false"),)),
        r("hreflang", "indexing", "warning", 7, "hreflang", (
            ("missing-self-reference", "warning", f"{d.size('alternates')} > 0 and {d.size(d.filter('alternates', 't', own_alternate))} = 0"),
            ("missing-x-default", "info", f"{d.size('alternates')} > 1 and {d.size(d.filter('alternates', 't', has('t', '(?i)hreflang=.x-default')))} = 0"),
            ("invalid-lang", "warning", f"{d.size(d.filter('alternates', 't', f'not {valid_lang}'))} > 0")), False),
        r("pagination-health", "seo", "warning", 6, "core", (
            ("missing-rel-next-prev", "warning", f"{has('html', '(?i)class=.[^>]*pagination')} and not {has('html', '(?i)rel=.(?:next|prev)')}"),
            ("infinite-scroll", "info", has("html", "(?i)infinite[-_]scroll|load[-_]more|autoload")))),
        r("low-performance-score", "performance", "warning", 5, "performance", (
            ("critical", "error", "performance < 50"), ("warning", "warning", "performance >= 50 and performance < 80")), False),
        r("lcp-metric", "performance", "warning", 6, "performance", (
            ("poor", "error", "lcp > 4000"), ("needs-improvement", "warning", "lcp > 2500 and lcp <= 4000")), False),
        r("cls-metric", "performance", "warning", 6, "performance", (
            ("poor", "error", "cls > 0.25"), ("needs-improvement", "warning", "cls > 0.1 and cls <= 0.25")), False),
        r("heavy-resources", "performance", "warning", 4, "performance", (
            ("html-size", "warning", "html_bytes > 150000"), ("js-size", "warning", "js_bytes > 500000"), ("request-count", "info", "n_requests > 50")), False),
        r("caching-headers", "performance", "info", 5, "performance", (
            ("missing-cache-control", "info", "h_cache is null"), ("missing-etag", "info", "h_etag is null")), False),
        r("image-optimization", "performance", "warning", 7, "performance", (
            ("missing-dimensions", "warning", f"n_images > 0 and not {has('html', '(?i)<img[^>]+width=')}"),
            ("no-lazy-loading", "info", f"n_images > 0 and not {has('html', '(?i)loading=.lazy')}"),
            ("no-modern-format", "info", f"n_images > 0 and not {has('html', r'(?i)\.(?:webp|avif)')}"),
            ("missing-srcset", "info", f"n_images > 0 and not {has('html', '(?i)srcset=')}")), False),
        r("mobile-usability", "mobile_seo", "error", 8, "mobile", (
            ("missing-viewport", "critical", "viewport is null"),
            ("invalid-viewport", "warning", "viewport is not null and viewport not like '%width=device-width%' and viewport not like '%initial-scale=%'"),
            ("no-inline-styles", "warning", f"not {has('html', r'(?i)<[a-z][^>]*\sstyle=')}"),
            ("no-nav-element", "warning", "n_nav = 0"),
            ("poor-navigation", "warning", f"n_nav > 0 and n_links > 10 and not {has('html', '(?i)hamburger|menu-toggle|navbar-toggle')}"),
            ("no-tap-targets", "warning", "n_taps = 0")), False),
        r("mobile-performance", "mobile_seo", "warning", 8, "mobile", (
            ("poor-lcp", "error", "lcp * 1.5 > 4000"), ("needs-improvement-lcp", "warning", "lcp * 1.5 > 2500 and lcp * 1.5 <= 4000"),
            ("no-images-found", "warning", "n_images = 0"), ("excessive-js", "error", "js_bytes > 1000000"),
            ("heavy-js", "warning", "js_bytes > 500000 and js_bytes <= 1000000"),
            ("heavy-images", "warning", "img_bytes > 1500000 and n_images > 5"), ("render-blocking", "warning", "n_js + n_css > 15")), False),
        r("mobile-responsive", "mobile_seo", "warning", 5, "mobile", (
            ("missing-media-queries", "error", f"not {has('html', '@media')} and not {has('html', '(?i)<link[^>]+media=')}"),
            ("missing-breakpoints", "warning", f"{has('html', '@media')} and not {has('html', '768|480|320|600')}")), False),
        r("mobile-indexing", "mobile_seo", "warning", 3, "mobile", (
            ("missing-schema", "warning", "n_jsonld = 0"), ("missing-canonical", "warning", "canonical is null"),
            ("canonical-mismatch", "warning", "canonical is not null and canonical <> url")), False),
        r("ai-extractability", "ai_visibility", "warning", 8, "aiVisibility", (
            ("no-semantic-containers", "warning", "n_semantic = 0"),
            ("no-answer-first", "info", f"length(body_text) > 500 and not {answer}")), False),
        r("ai-entity-clarity", "ai_visibility", "error", 8, "aiVisibility", (
            ("weak-entity", "error", f"not {entity}"), ("missing-disambiguation", "warning", f"{entity} and not {same_as}")), False),
        r("ai-citation-readiness", "ai_visibility", "warning", 7, "aiVisibility", (
            ("no-external-citations", "warning", "n_external = 0"),
            ("missing-faq-schema", "warning", f"{question} and not {faq}"),
            ("no-statistics", "info", f"length(body_text) > 500 and not {stats}")), False),
        r("ai-structural-organization", "ai_visibility", "warning", 6, "aiVisibility", (
            ("broken-hierarchy", "warning", jump),
            ("no-lists-or-tables", "info", "n_lists = 0 and words > 200")), False),
        r("ai-retrieval-friendliness", "ai_visibility", "warning", 8, "aiVisibility", (
            ("paragraphs-too-long", "warning", f"{long_p} > 0"), ("thin-content", "warning", "words > 0 and words < 300")), False),
        r("ai-authority-signals", "ai_visibility", "warning", 7, "aiVisibility", (
            ("missing-authorship", "warning", f"not {author}"), ("missing-trust-signals", "warning", f"not {trust}")), False),
        r("security", "security", "error", 8, "security", (
            ("not-https", "critical", "scheme = 'http'"), ("mixed-content", "error", f"{https} and n_http_assets > 0"),
            ("insecure-form", "error", "n_http_forms > 0"),
            ("missing-sri", "warning", f"{d.size(d.filter('outside', 'a', f"not {has('a', '(?i)integrity=')} and lower({rx('a', foreign)}) <> host"))} > 0")), False),
        r("security-headers", "security", "warning", 6, "security", (
            ("missing-csp", "warning", f"not ({csp}) and coalesce(h_csp_report, '') = ''"), ("csp-report-only", "info", f"not ({csp}) and coalesce(h_csp_report, '') <> ''"),
            ("csp-unsafe-inline-script", "error", f"{csp} and {script} like '%unsafe-inline%'"),
            ("csp-unsafe-eval-script", "error", f"{csp} and {script} like '%unsafe-eval%'"),
            ("csp-script-src-wildcard", "error", f"{csp} and {has(script, r'(?:^|\s)\*(?:\s|$)')}"),
            ("csp-object-src-wildcard", "error", f"{csp} and {has(obj, r'(?:^|\s)\*(?:\s|$)')}"),
            ("csp-missing-object-src", "warning", f"{csp} and {obj} = ''"),
            ("csp-missing-default-src", "warning", f"{csp} and {_directive(d, 'default-src')} = ''"),
            ("csp-missing-frame-ancestors", "info", f"{csp} and not {ancestors}"),
            ("missing-x-frame-options", "warning", f"h_xfo is null and not {ancestors}"),
            ("missing-referrer-policy", "info", "h_referrer is null"),
            ("missing-hsts", "error", f"{https} and h_hsts is null"),
            ("hsts-invalid", "warning", f"{https} and h_hsts is not null and {age} is null"),
            ("hsts-short-max-age", "warning", f"{https} and {age} < 31536000"),
            ("hsts-missing-subdomains", "warning", f"{https} and h_hsts is not null and not {has('lower(h_hsts)', 'includesubdomains')}"),
            ("hsts-missing-preload", "info", f"{https} and h_hsts is not null and not {has('lower(h_hsts)', 'preload')}"),
            ("missing-x-content-type-options", "warning", "h_xcto is null"), ("invalid-x-content-type-options", "warning", "h_xcto <> 'nosniff'"),
            ("missing-permissions-policy", "info", "h_permissions is null"), ("missing-coop", "info", "h_coop is null"),
            ("missing-coep", "info", "h_coep is null"), ("missing-corp", "info", "h_corp is null"),
            ("server-version-disclosure", "info", has("coalesce(h_server, '')", r"\d")), ("x-powered-by-disclosure", "info", "h_powered is not null"),
            ("cookie-missing-secure", "warning", f"{cookie} and {https} and not {has('lower(h_cookie)', ';\\s*secure')}"),
            ("cookie-missing-httponly", "warning", f"{cookie} and not {has('lower(h_cookie)', ';\\s*httponly')}"),
            ("cookie-missing-samesite", "info", f"{cookie} and not {has('lower(h_cookie)', ';\\s*samesite=')}")), False),
    ]


#: Rules over several pages; their conditions are joins below or await side data.
SET_RULES = (
    Rule("duplicate-title", "metadata", "error", 8, "core", stateless=False),
    Rule("broken-links", "links", "error", 9, "core"),
    Rule("orphan-page", "indexing", "error", 8, "core", stateless=False),
    Rule("internal-link-distribution", "links", "warning", 7, "core", stateless=False),
    Rule("duplicate-content-similarity", "seo", "warning", 7, "core", stateless=False),
    Rule("eeat-score", "seo", "warning", 5, "core"),
    Rule("missing-backlink-data", "backlink_intelligence", "info", 2, "backlinks", stateless=False),
    Rule("anchor-text-over-optimization", "backlink_intelligence", "warning", 5, "backlinks", stateless=False),
    Rule("low-authority-backlinks", "backlink_intelligence", "warning", 4, "backlinks", stateless=False),
    Rule("missing-high-authority-backlinks", "backlink_intelligence", "warning", 4, "backlinks", stateless=False),
)


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def per_page(d: Dialect, only: tuple[str, ...] | None = None) -> str:
    """WITH entries up to ``page_findings``: one projection evaluates every check; what doesn't hold is null and filtered."""
    chosen = [r for r in rules(d) if only is None or r.id in only]
    codes = [
        f"case when {cond} then {text('|'.join((r.id, sub, sev, r.category)))} end" for r in chosen for sub, sev, cond in r.checks
    ]
    return f"""{captured(d)},
    fired as (select page_id, url, {d.explode(d.filter(d.array(*codes), 'c', 'c is not null'))} as code from captured),
    page_findings as (
      select page_id, url, {_field(d, 1)} as rule_id, {_field(d, 2)} as sub_check, {_field(d, 3)} as severity, {_field(d, 4)} as category from fired
    )"""


def _field(d: Dialect, n: int) -> str:
    return f"split_part(code, '|', {n})"


def page_rows(d: Dialect) -> str:
    """One pass over the captures: facts and headers of every page without its html, and the codes of the checks that hold."""
    codes = [f"case when {cond} then {text('|'.join((r.id, sub, sev, r.category)))} end" for r in rules(d) for sub, sev, cond in r.checks]
    kept = "* except (html, body_text, json_ld)" if d.name == "spark" else "* exclude (html, body_text, json_ld)"
    return f"""with {captured(d)}, coded as (select *, {d.filter(d.array(*codes), 'c', 'c is not null')} as codes, {d.hash('lower(body_text)')} as body_hash from captured)
    select {kept} from coded"""


STORED["page_rows"] = Plan(page_rows, ("pages",))


def fired_findings(d: Dialect) -> str:
    """The findings of single pages, from ``page_facts``."""
    fields = ", ".join(f"{_field(d, i)} as {c}" for i, c in enumerate(("rule_id", "sub_check", "severity", "category"), 1))
    return f"with fired as (select page_id, url, {d.explode('codes')} as code from page_facts) select page_id, url, {fields} from fired"


#: Finding rows of the rules that look at several pages: rule, sub-check, severity, category, and the relation with their page_id and url.
SET_FINDINGS = (
    ("duplicate-title", "duplicate", "'error'", "metadata", "page_facts p join titles t on p.norm_title = t.norm_title"),
    ("content-quality", "duplicate-title", "'warning'", "seo", "page_facts p join same_titles t on lower(p.title) = t.title_key"),
    ("duplicate-content-similarity", "near-duplicates", "case when t.likeness > 0.9e0 then 'error' else 'warning' end", "seo", "page_facts p join near_pages t on p.page_id = t.page_id"),
    ("broken-links", "broken-links", "'error'", "links", "(select distinct page_id, source as url from broken_links) p"),
    ("canonical-issues", "mismatch", "'warning'", "indexing", "canonical_targets p where not coalesce(target_noindex, false)"),
    ("canonical-issues", "canonical-to-noindex", "'critical'", "indexing", "canonical_targets p where target_noindex"),
    ("orphan-page", "orphan", "'error'", "indexing", "degrees p join first_pages t on p.host = t.host where in_degree = 0 and p.page_id <> t.first_id"),
    ("internal-link-distribution", "authority-sinks", "'warning'", "links", "degrees p join first_pages t on p.page_id = t.first_id join sinks k on k.host = p.host"),
)


def set_rules(d: Dialect, rows: str | None = None, near: str | None = None, only: str | None = None) -> str:
    """WITH entries ``page_facts``, ``page_links``, ``set_findings``, ``findings``: per-page findings and those that look at several pages.

    ``rows``, ``near``: names of relations of page rows and of near pages instead of the stored ones. Hosts are audited by themselves: the first page of a host is its home.
    ``only``: the one category that is asked for; where rules over several pages have none of it, Spark's ``findings`` are those of single pages.
    """
    stored = d.name == "spark" and rows is None
    source = rows or ("{{page_rows}}" if d.name == "spark" else f"({page_rows(d)})")
    alike = near or ("{{near_pages}}" if d.name == "spark" else f"({near_pages_sql()})")
    clean = lambda c: f"lower({d.repl(c, '/$', '')})"
    joined = lambda rel: d.merged(*re.findall(r"join \w+ (\w)(?= on )", rel))
    union = "\n      union all ".join(f"select {joined(rel)}p.page_id, p.url, '{r}' as rule_id, '{c}' as sub_check, {sev} as severity, '{cat}' as category from {rel}" for r, c, sev, cat, rel in SET_FINDINGS)
    found = f"""set_findings as ({union}),
    findings as (select * from page_findings union all select * from set_findings)"""
    single = f"findings as (select * from page_findings where category = '{only}')"
    return f"""page_facts as (select * from {source}),
    near_pages as (select * from {alike}),
    page_findings as ({fired_findings(d)}),
    {page_links(d)},
    titles as (select norm_title, count(*) as n from page_facts where norm_title <> '' group by norm_title having count(*) > 1),
    same_titles as (select lower(title) as title_key, count(*) as n from page_facts where title is not null group by lower(title) having count(*) > 1),
    canonical_targets as (select {d.merged('t')}p.page_id, p.url, p.canonical, t.noindex as target_noindex from page_facts p
      left join (select url, max(case when robots like '%noindex%' then 1 else 0 end) = 1 as noindex from page_facts group by url) t on t.url = p.canonical
      where p.canonical is not null and {clean('p.canonical')} <> {clean('p.url')}),
    first_pages as (select host, min(page_id) as first_id from page_facts group by host),
    degrees as (select {d.merged('i', 'o')}p.page_id, p.url, p.host, {d.big('coalesce(i.n, 0)')} as in_degree, {d.big('coalesce(o.n, 0)')} as out_degree from page_facts p
      left join (select target, count(*) as n from page_edges group by target) i on i.target = p.url
      left join (select source, count(*) as n from page_edges group by source) o on o.source = p.url),
    sinks as (select host, count(*) as n from degrees where in_degree >= 5 and out_degree <= 1 group by host),
    {found if not stored else single if only and all(cat != only for *_, cat, _ in SET_FINDINGS) else "findings as (select * from {{findings}})"}"""


def near_pages_sql() -> str:
    """DuckDB's near pages: signatures of all pages, every pair of them compared."""
    body = strip_html(DUCK, "coalesce(html, '')")
    hashed = lambda base: f"list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(s, ''), lambda c: cast(unicode(c) as bigint))), lambda h, c: (h * {base} + c) % 4294967296)"
    return f"""with texts as (select page_id, list_filter(regexp_split_to_array(lower({body}), '\\s+'), lambda w: length(w) > 2) as w from pages),
      grams as (select page_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) as s from texts where len(w) >= 5),
      mixed as (select page_id, {hashed(31)} as a, {hashed(37)} as b from grams),
      slots as (select page_id, i, min(((a + i * b) % 4294967296) % 2147483647) as m from mixed, range(64) r(i) group by page_id, i),
      signed as (select page_id, list(m order by i) as sig from slots group by page_id),
      pairs as (select a.page_id as a, b.page_id as b, list_sum(list_transform(list_zip(a.sig, b.sig), lambda z: case when z[1] = z[2] then 1 else 0 end)) / 64e0 as likeness from signed a join signed b on a.page_id <> b.page_id)
      select a as page_id, max(likeness) as likeness, count(*) as n_others from pairs where likeness >= 0.8e0 group by a"""


def _findings(d: Dialect) -> str:
    return f"with {set_rules(d, '{{page_rows}}', '{{near_pages}}')} select * from findings"


STORED["near_pages"] = Made(lambda spark, sf_dir: signatures.near_kinds(materialise(signatures.signed_pages(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")), "signatures")), ("pages",))
STORED["findings"] = Plan(_findings, ("pages",))


def page_links(d: Dialect) -> str:
    """WITH entries over ``page_facts``: ``page_links``, every link resolved, and ``page_edges``, distinct links between captured pages of one host."""
    root = "concat(scheme, '://', host)"
    folder = d.repl("path", r"[^/]*$", "")
    return f"""raw_links as (select page_id, url as source, scheme, host, path, {d.explode('hrefs')} as href from page_facts),
    page_links as (
      select page_id, source, href, host,
        case when {d.has('href', r'^[A-Za-z][A-Za-z0-9+.-]*:')} then href when {d.has('href', '^//')} then concat(scheme, ':', href)
          when {d.has('href', '^/')} then concat({root}, href) when {d.has('href', r'^[?]')} then concat({root}, path, href)
          else concat({root}, {folder}, href) end as target from raw_links),
    captured_links as (select {d.merged('p')}l.page_id, l.source, l.target, p.status_code from page_links l join (select url, max(status_code) as status_code from page_facts group by url) p on l.target = p.url
      where lower({d.rx('l.target', r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)')}) = l.host),
    page_edges as (select distinct source, target from captured_links),
    broken_links as (select * from captured_links where status_code >= 400 or status_code = 0)"""


@plan("rules_all_findings", "pages")
def all_findings(d: Dialect) -> str:
    return f"with {set_rules(d)} select page_id, rule_id, sub_check, severity, category from findings"


def _one(rule_id: str):
    def build(d: Dialect) -> str:
        if any(r == rule_id for r, *_ in SET_FINDINGS):  # with what the rule says about several pages
            return f"with {set_rules(d)} select page_id, url, sub_check, severity from findings where rule_id = '{rule_id}'"
        return f"with {per_page(d, (rule_id,))} select page_id, url, sub_check, severity from page_findings"

    return build


for _rule in (
    "missing-title", "missing-meta-description", "missing-h1", "multiple-h1", "missing-alt-text", "canonical-issues", "noindex-detection",
    "missing-structured-data", "social-meta", "content-quality", "internal-linking", "pagination-health", "low-performance-score", "lcp-metric",
    "cls-metric", "heavy-resources", "caching-headers", "image-optimization", "mobile-usability", "mobile-performance", "mobile-responsive",
    "mobile-indexing", "ai-extractability", "ai-entity-clarity", "ai-citation-readiness", "ai-structural-organization",
    "ai-retrieval-friendliness", "ai-authority-signals", "security", "security-headers",
):
    plan("rule_" + _rule.replace("-", "_"), "pages")(_one(_rule))


@plan("jon01_duplicate_titles", "pages")
def jon01(d: Dialect) -> str:
    """Every page of a duplicated title beside the title's count and first page; a group of any size stays in rows."""
    return f"""with {enriched(d)}, groups_ as (select norm_title, count(*) as n_pages, min(page_id) as first_page from page_facts where norm_title <> '' group by norm_title having count(*) > 1)
    select g.norm_title, g.n_pages, g.first_page, p.page_id from groups_ g join page_facts p on p.norm_title = g.norm_title"""


@plan("jon04_broken_links", "pages")
def jon04(d: Dialect) -> str:
    """Links to captured pages of the host that answered with a failure or not at all; what was not captured is not judged."""
    return f"with {set_rules(d)} select page_id, source, target, status_code, count(*) as n_links from broken_links group by page_id, source, target, status_code"


@plan("jon07_page_edges", "pages")
def jon07(d: Dialect) -> str:
    """Distinct links between captured pages of one host."""
    return f"with {set_rules(d)} select source, target from page_edges"


@plan("gra01_page_degrees", "pages")
def page_degrees(d: Dialect) -> str:
    return f"with {set_rules(d)} select {d.merged('first_pages')}page_id, url, in_degree, out_degree, in_degree = 0 and page_id <> first_id as is_orphan from degrees join first_pages on degrees.host = first_pages.host"


@plan("jon06_canonical_noindex", "pages")
def jon06(d: Dialect) -> str:
    return """with canon as (select page_id, url, (page_id * 3 + 1) % (select count(*) from pages) as target_id from pages where page_id % 4 = 0),
    targets as (select page_id, url, case when page_id % 5 = 0 then 'noindex,follow' else 'index' end as robots from pages)
    select c.page_id, c.url, t.url as canonical, case when t.robots like '%noindex%' then 'canonical-to-noindex' else 'mismatch' end as sub_check,
      case when t.robots like '%noindex%' then 'critical' else 'warning' end as severity
    from canon c left join targets t on c.target_id = t.page_id where c.page_id <> c.target_id"""


@plan("jon08_sitemap_orphans", "pages")
def jon08(d: Dialect) -> str:
    return """with sitemap as (select url from pages where page_id % 2 = 0 union all select concat(url, '/only-in-sitemap') from pages where page_id % 10 = 0),
    crawled as (select distinct url from pages)
    select s.url, cast(0 as int) as status, true as is_orphan from (select distinct url from sitemap) s left join crawled c on s.url = c.url where c.url is null"""


@plan("jon19_directory_match", "pages")
def jon19(d: Dialect) -> str:
    """A page's host matches a directory's domain or one of its sub-domains, by an equi-join on the host's suffixes."""
    host = f"lower({d.rx('url', r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)')})"
    parts = d.split("host", r"\.")
    suffix = d.join(f"slice({parts}, i, {d.size(parts)})" if d.name == "spark" else f"list_slice({parts}, i, {d.size(parts)})", ".")
    return f"""with hosts as (select page_id, {host} as host from pages),
    suffixes as (select page_id, host, {d.explode(d.map(d.seq('1', d.big(d.size(parts)) if d.name == 'duckdb' else d.size(parts)), 'i', suffix.replace('i,', 'cast(i as int),')))} as suffix from hosts),
    directories as (select 'example.com' as domain union all select 'example.net' union all select 'spam-farm.example.org')
    select page_id, host, domain from suffixes join directories on suffix = domain"""


@plan("jon20_rule_weight", "pages")
def jon20(d: Dialect) -> str:
    weights = " union all ".join(f"select {text(r.id)} as rule_id, {r.weight} as weight" for r in [*rules(d), *SET_RULES])
    return f"""with {set_rules(d)}, weights as ({weights})
    select f.rule_id, coalesce(w.weight, 5) as weight, count(*) as n from findings f left join weights w on f.rule_id = w.rule_id group by f.rule_id, coalesce(w.weight, 5)"""
