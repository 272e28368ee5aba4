"""Aggregation of findings into category, specialised and overall scores."""

from __future__ import annotations

from sitegrain.operators.rules import SET_RULES, rules, set_rules, text
from sitegrain.plans.dialect import Dialect, plan

#: Category weights and floors, severity ordinals, multipliers and security factors.
CATEGORY_WEIGHTS = {
    "indexing": 0.15, "metadata": 0.15, "links": 0.10, "seo": 0.10, "ai_visibility": 0.15, "accessibility": 0.10,
    "performance": 0.10, "mobile_seo": 0.15, "backlink_intelligence": 0.10, "security": 0.10,
}
CATEGORY_FLOORS = {c: 0 if c == "security" else 20 for c in CATEGORY_WEIGHTS}
SEVERITY_ORDER = {"info": 0, "warning": 1, "error": 2, "critical": 3}
MULTIPLIERS = {"critical": 1.5, "error": 1.0, "warning": 0.4, "info": 0.05}
SECURITY_FACTORS = {"critical": 1.15, "error": 1.0, "warning": 0.8, "info": 0.6}
#: Deductions of the assistant-visibility sub-scores.
AI_DEDUCTIONS = {
    ("ai-extractability", "no-semantic-containers"): 25, ("ai-extractability", "high-boilerplate-ratio"): 25, ("ai-extractability", "no-answer-first"): 10,
    ("ai-entity-clarity", "weak-entity"): 55, ("ai-entity-clarity", "missing-disambiguation"): 30,
    ("ai-citation-readiness", "no-external-citations"): 40, ("ai-citation-readiness", "missing-faq-schema"): 30, ("ai-citation-readiness", "no-statistics"): 20,
    ("ai-structural-organization", "broken-hierarchy"): 45, ("ai-structural-organization", "no-lists-or-tables"): 20,
    ("ai-retrieval-friendliness", "paragraphs-too-long"): 40, ("ai-retrieval-friendliness", "thin-content"): 50,
    ("ai-authority-signals", "missing-authorship"): 45, ("ai-authority-signals", "missing-trust-signals"): 40,
}
KEY_GAP, STRONG_GAP = 20, 15
GRADES = ((95, "A+"), (90, "A"), (80, "B"), (70, "C"), (60, "D"))


def values(d: Dialect, names: tuple[str, ...], rows) -> str:
    """A small dimension as SELECTs."""
    cell = lambda v: text(v) if isinstance(v, str) else f"cast({v} as double)" if isinstance(v, float) else str(v)
    return " union all ".join("select " + ", ".join(f"{cell(v)} as {n}" for n, v in zip(names, row)) for row in rows)


def scores(d: Dialect) -> str:
    """WITH entries up to ``category_scores``."""
    known = [*rules(d), *SET_RULES]
    return f"""{set_rules(d)},
    weights as ({values(d, ('rule_id', 'weight'), [(r.id, r.weight) for r in known])}),
    multipliers as ({values(d, ('severity', 'mult'), MULTIPLIERS.items())}),
    categories as ({values(d, ('category', 'cat_weight', 'floor_score'), [(c, w, CATEGORY_FLOORS[c]) for c, w in CATEGORY_WEIGHTS.items()])}),
    audited as ({values(d, ('category',), [(c,) for c in dict.fromkeys(r.category for r in known if r.module != 'backlinks')])}),
    n_pages as (select cast(count(*) as double) as pages_n from page_facts),
    deductions as (
      select f.category, sum(coalesce(w.weight, 5) * m.mult) as raw from findings f
      left join weights w on f.rule_id = w.rule_id join multipliers m on f.severity = m.severity group by f.category
    ),
    scaled as (
      select c.category, c.cat_weight, c.floor_score, a.category is not null as audited,
        coalesce(raw, 0e0) / case when pages_n > 1 then log10(pages_n + 9) else 1e0 end as deduction
      from categories c left join deductions x on c.category = x.category left join audited a on c.category = a.category cross join n_pages
    ),
    category_scores as (
      select category, cat_weight, audited, floor(deduction * 10 + 0.5e0) / 10 as total_deductions,
        greatest(cast(floor_score as double), least(100e0, floor(100 - deduction + 0.5e0))) as score
      from scaled
    )"""


@plan("agg01_counts_pivot", "pages")
def agg01(d: Dialect) -> str:
    cols = ", ".join(f"{d.big(f'''sum(case when severity = '{s}' then 1 else 0 end)''')} as n_{s}" for s in SEVERITY_ORDER)
    return f"""with {set_rules(d)}, categories as ({values(d, ('category',), [(c,) for c in CATEGORY_WEIGHTS])})
    select c.category, {cols} from categories c left join findings f on c.category = f.category group by c.category"""


@plan("agg02_deductions", "pages")
def agg02(d: Dialect) -> str:
    return f"with {scores(d)} select category, audited, cast(total_deductions as double) as total_deductions, cast(score as bigint) as score from category_scores"


@plan("agg04_overall", "pages")
def agg04(d: Dialect) -> str:
    """Category scores with the specialised ones in their place, performance capped while vitals are estimated, and their weighted mean."""
    return f"""with {scores(d)}, {mobile(d)}, {assistant(d)}, {security(d)},
    replaced as (
      select c.category, c.cat_weight, c.audited, case c.category when 'mobile_seo' then (select mobile_score from mobile_total) when 'ai_visibility' then (select ai_score from ai_total)
        when 'security' then (select total from security_capped) when 'performance' then least(c.score, 50e0) else c.score end as score from category_scores c)
    select cast(floor(sum(case when audited then score * cat_weight end) / sum(case when audited then cat_weight end) + 0.5e0) as bigint) as overall,
      {d.big('sum(case when audited then 1 else 0 end)')} as n_audited from replaced"""


@plan("agg05_issue_groups", "pages")
def agg05(d: Dialect) -> str:
    return f"""with {set_rules(d)} select rule_id, sub_check, severity, count(*) as n, count(distinct url) as n_pages, min(page_id) as first_page
    from findings group by rule_id, sub_check, severity"""


@plan("agg06_severity_totals", "pages")
def agg06(d: Dialect) -> str:
    return f"""with {set_rules(d)}, first_five as (select * from findings where severity in ('critical', 'error') order by page_id, rule_id, sub_check limit 5)
    select 'quick-win' as kind, rule_id as name, sub_check, page_id as n from first_five
    union all select 'total', severity, '', count(*) from findings group by severity"""


def mobile(d: Dialect) -> str:
    """WITH entries ``mobile_parts`` and ``mobile_total``: flags of the site's sub-checks make four part scores."""
    flag = lambda *subs: f"max(case when category = 'mobile_seo' and sub_check in ({', '.join(map(text, subs))}) then 1 else 0 end) = 1"
    part = lambda full, none, less=(): f"(case when {flag(*none)} then 0e0 {' '.join(f'when {flag(s)} then {p}e0 / max(scale)' for s, p in less)} else {full}e0 end)"
    unseen = "unverifiable-usability"
    usability = [
        part(40, ("missing-viewport", unseen), [("invalid-viewport", 20)]), part(20, ("no-inline-styles", "fixed-width", unseen)),
        part(15, ("no-nav-element", unseen), [("poor-navigation", 5)]), part(25, ("no-tap-targets", unseen), [("tap-target", 10)]),
    ]
    speed = [
        part(35, ("unverifiable-lcp",), [("poor-lcp", 5), ("needs-improvement-lcp", 15)]), part(25, ("unverifiable-cls",), [("poor-cls", 5), ("needs-improvement-cls", 10)]),
        part(15, ("unverifiable-js-execution", "excessive-js"), [("heavy-js", 5)]), part(15, ("no-images-found", "unverifiable-image-load"), [("heavy-images", 5)]),
        f"(case when {flag('render-blocking')} then 5e0 / max(scale) else 10e0 end)",
    ]
    responsive = [part(50, ("missing-media-queries",)), part(25, ("no-inline-styles", "fixed-layout")), part(25, ("missing-breakpoints", "unverifiable-breakpoints"))]
    indexing = [part(40, ("hidden-content",)), part(40, ("missing-schema",)), part(20, ("missing-canonical",), [("canonical-mismatch", 10)])]
    whole = lambda parts: f"floor({' + '.join(parts)} + 0.5e0)"
    every = "findings cross join mobile_scale" if d.name == "spark" else "mobile_scale left join findings on true"  # Spark would broadcast the findings; without any both give one row
    return f"""mobile_scale as (select case when count(*) > 1 then log10(cast(count(*) as double) + 9) else 1e0 end as scale from page_facts),
    mobile_parts as (select {whole(usability)} as usability, case when {flag('unverifiable-lcp')} then least(50e0, {whole(speed)}) else {whole(speed)} end as speed,
      {whole(responsive)} as responsive, {whole(indexing)} as indexing from {every}),
    mobile_total as (select *, floor(usability * 0.35e0 + speed * 0.35e0 + responsive * 0.2e0 + indexing * 0.1e0 + 0.5e0) as mobile_score from mobile_parts)"""


@plan("agg07_mobile", "pages")
def agg07(d: Dialect) -> str:
    return f"with {set_rules(d, only='mobile_seo')}, {mobile(d)} select {', '.join(f'{d.big(c)} as {c}' for c in ('usability', 'speed', 'responsive', 'indexing', 'mobile_score'))} from mobile_total"


def assistant(d: Dialect) -> str:
    """WITH entries ``ai_parts`` and ``ai_total``: six part scores and their mean."""
    return f"""ai_dims as ({values(d, ('rule_id', 'sub_check', 'points'), [(*k, v) for k, v in AI_DEDUCTIONS.items()])}),
    ai_areas as (select distinct rule_id from ai_dims), ai_pages as (select count(*) as pages_n from page_facts),
    ai_lost as (select f.rule_id, sum(x.points) as points from findings f join ai_dims x on f.rule_id = x.rule_id and f.sub_check = x.sub_check where f.category = 'ai_visibility' group by f.rule_id),
    ai_parts as (select a.rule_id as area, floor(greatest(0e0, 100 - coalesce(points, 0) / cast(greatest(1, pages_n) as double)) + 0.5e0) as score
      from ai_areas a left join ai_lost l on a.rule_id = l.rule_id cross join ai_pages),
    ai_total as (select floor(avg(score) + 0.5e0) as ai_score from ai_parts)"""


@plan("agg08_ai", "pages")
def agg08(d: Dialect) -> str:
    return f"""with {set_rules(d, only='ai_visibility')}, {assistant(d)}
    select area, cast(score as bigint) as score from ai_parts union all select 'overall', cast(ai_score as bigint) from ai_total"""


#: Weights of the security buckets, and what each sub-check takes off a page.
SECURITY_WEIGHTS = {
    "transport": 0.20, "hsts": 0.15, "csp": 0.20, "browser-hardening": 0.15, "cross-origin-isolation": 0.10, "cookie-security": 0.12, "supply-chain-disclosure": 0.08,
}
SECURITY_DEDUCTIONS = {
    "transport": {"not-https": 100, "mixed-content": 40, "insecure-form": 35, "no-https-redirect": 30},
    "hsts": {"missing-hsts": 100, "hsts-invalid": 60, "hsts-short-max-age": 35, "hsts-missing-subdomains": 20, "hsts-missing-preload": 10},
    "csp": {
        "missing-csp": 70, "csp-report-only": 20, "csp-unsafe-inline-script": 35, "csp-unsafe-eval-script": 30, "csp-script-src-wildcard": 25,
        "csp-object-src-wildcard": 20, "csp-missing-object-src": 15, "csp-missing-default-src": 15, "csp-missing-frame-ancestors": 10,
    },
    "browser-hardening": {
        "missing-x-frame-options": 30, "missing-x-content-type-options": 30, "invalid-x-content-type-options": 15,
        "missing-referrer-policy": 15, "missing-permissions-policy": 10,
    },
    "cross-origin-isolation": {"missing-coop": 34, "missing-coep": 33, "missing-corp": 33},
    "cookie-security": {"cookie-missing-secure": 40, "cookie-missing-httponly": 35, "cookie-missing-samesite": 25},
    "supply-chain-disclosure": {"missing-sri": 45, "server-version-disclosure": 15, "x-powered-by-disclosure": 15, "missing-security-txt": 10},
}
SECURITY_CAPS = ((40, ("not-https", "mixed-content")), (79, ("missing-csp", "missing-hsts")))
SECURITY_ERROR_CAP = 89
PREVALENCE = 0.4  # of a bucket's deduction that stands however few pages are affected


def security(d: Dialect) -> str:
    """WITH entries ``security_buckets`` and ``security_capped``: capped sums by bucket and page, means over affected pages scaled by coverage, then gates."""
    dims = [(b, s, float(p), SECURITY_WEIGHTS[b]) for b, subs in SECURITY_DEDUCTIONS.items() for s, p in subs.items()]
    gates = " ".join(f"when max(case when sub_check in ({', '.join(map(text, subs))}) then 1 else 0 end) = 1 then {cap}e0" for cap, subs in SECURITY_CAPS)
    return f"""security_dims as ({values(d, ('bucket', 'sub_check', 'points', 'bucket_weight'), dims)}),
    security_factors as ({values(d, ('severity', 'factor'), SECURITY_FACTORS.items())}), security_pages as (select cast(greatest(1, count(*)) as double) as pages_n from page_facts),
    security_by_page as (
      select x.bucket, f.url, least(100e0, sum(x.points * k.factor)) as lost
      from findings f join security_dims x on f.sub_check = x.sub_check join security_factors k on f.severity = k.severity where f.category = 'security' group by x.bucket, f.url),
    security_by_bucket as (
      select bucket, avg(lost) * ({PREVALENCE}e0 + {1 - PREVALENCE}e0 * least(1e0, count(*) / max(pages_n))) as lost, count(*) as affected from security_by_page cross join security_pages group by bucket),
    security_buckets as (
      select w.bucket, w.bucket_weight, greatest(0e0, 100 - coalesce(b.lost, 0e0)) as raw, {d.big('coalesce(b.affected, 0)')} as affected
      from (select distinct bucket, bucket_weight from security_dims) w left join security_by_bucket b on w.bucket = b.bucket),
    security_one as (select floor(sum(raw * bucket_weight) + 0.5e0) as calculated from security_buckets),
    security_gate as (select case {gates} when max(case when severity in ('critical', 'error') then 1 else 0 end) = 1 then {SECURITY_ERROR_CAP}e0 else 100e0 end as cap from findings where category = 'security'),
    security_capped as (select calculated, cap, least(calculated, cap) as total from security_one cross join security_gate)"""


@plan("agg09_security", "pages")
def agg09(d: Dialect) -> str:
    grade = "case " + " ".join(f"when total >= {n} then '{g}'" for n, g in GRADES) + " else 'F' end"
    return f"""with {set_rules(d, only='security')}, {security(d)} select cast(calculated as bigint) as calculated, cast(total as bigint) as score, {grade} as grade from security_capped"""


@plan("agg09_security_buckets", "pages")
def security_bucket_scores(d: Dialect) -> str:
    return f"with {set_rules(d, only='security')}, {security(d)} select bucket, cast(floor(raw + 0.5e0) as bigint) as score, affected as n_pages from security_buckets"


@plan("agg10_vitals", "pages")
def agg10(d: Dialect) -> str:
    return f"with {set_rules(d)} select round(avg(lcp), 4) as lcp, round(avg(cls), 6) as cls, round(avg(inp), 4) as inp, count(*) as n_pages from page_facts"


@plan("flt04_severity_gate", "pages")
def flt04(d: Dialect) -> str:
    order = values(d, ("severity", "severity_rank"), SEVERITY_ORDER.items())
    return f"""with {set_rules(d)}, severities as ({order})
    select f.severity, count(*) as n, max(case when f.severity in ('critical', 'error') then 1 else 0 end) = 1 as fails from findings f
    join severities s on f.severity = s.severity where s.severity_rank >= 1 group by f.severity"""


@plan("snk10_ci_gate", "pages")
def snk10(d: Dialect) -> str:
    """Exit code: 1 failing severities, 2 broken budgets, 3 both, 0 none."""
    return f"""with {set_rules(d)}, fails as (select count(*) as n from findings where severity = 'critical'),
    budgets as (select case when avg(lcp) > 2500 or avg(cls) > 0.1e0 or sum(js_bytes) > 10000000 then 2 else 0 end as code from page_facts)
    select {d.big('case when n > 0 and code = 2 then 3 when code = 2 then 2 when n > 0 then 1 else 0 end')} as exit_code from fails cross join budgets"""


def sides(d: Dialect) -> str:
    """WITH entries ``a`` and ``b``: category scores of two sites, the pages of the host names in .org and all others."""
    one = lambda side, cond: f"""side_{side} as (select {d.merged('p')}f.* from findings f join page_facts p on f.page_id = p.page_id where {cond}),
    pages_{side} as (select cast(count(*) as double) as pages_n from page_facts where {cond.replace('p.', '')}),
    lost_{side} as (select f.category, sum(coalesce(w.weight, 5) * m.mult) as raw from side_{side} f left join weights w on f.rule_id = w.rule_id join multipliers m on f.severity = m.severity group by f.category),
    {side} as (select c.category, greatest(cast(c.floor_score as double), least(100e0, floor(100 - coalesce(l.raw, 0e0) / case when n.pages_n > 1 then log10(n.pages_n + 9) else 1e0 end + 0.5e0))) as score
      from categories c left join lost_{side} l on c.category = l.category cross join pages_{side} n)"""  # noqa: E731
    return f"""{scores(d)}, {one('a', "p.host like '%.org'")}, {one('b', "p.host not like '%.org'")}"""


def snapshots(d: Dialect) -> str:
    """WITH entries ``baseline`` and ``latest``: findings of an audit held to errors and one held to all severities, the last of a key in order."""
    keyed = "concat(rule_id, ':', url, ':', sub_check) as k, severity, row_number() over (partition by rule_id, url, sub_check order by page_id desc, severity desc) as rn"
    return f"""{set_rules(d)}, keyed as (select {keyed} from findings),
    baseline as (select k, severity from keyed where rn = 1 and severity in ('critical', 'error', 'info')),
    latest as (select k, case when severity = 'info' then 'warning' else severity end as severity from keyed where rn = 1 and severity <> 'critical')"""


@plan("jon13_findings_diff", "pages")
def jon13(d: Dialect) -> str:
    """Two snapshots by rule, page and sub-check: new, fixed, changed severity."""
    return f"""with {snapshots(d)}
    select coalesce(a.k, b.k) as finding_key, case when a.k is null then 'new' when b.k is null then 'fixed' else 'changed' end as change, a.severity as before_severity, b.severity as after_severity
    from baseline a full outer join latest b on a.k = b.k where a.k is null or b.k is null or a.severity <> b.severity"""


@plan("st09_regressions", "pages")
def st09(d: Dialect) -> str:
    """The gate over two snapshots: new critical findings, severities that rose, and whether any did."""
    order = values(d, ("severity", "severity_rank"), SEVERITY_ORDER.items())
    return f"""with {snapshots(d)}, ranks as ({order}),
    c as (select {d.big("coalesce(sum(case when a.k is null and b.severity = 'critical' then 1 else 0 end), 0)")} as new_critical, {d.big("coalesce(sum(case when y.severity_rank > x.severity_rank then 1 else 0 end), 0)")} as raised
      from baseline a full outer join latest b on a.k = b.k left join ranks x on a.severity = x.severity left join ranks y on b.severity = y.severity)
    select new_critical, raised, new_critical > 0 or raised > 0 as regressed from c"""


@plan("jon14_category_diff", "pages")
def jon14(d: Dialect) -> str:
    return f"""with {sides(d)} select coalesce(a.category, b.category) as category, cast(coalesce(a.score, 100e0) as bigint) as before_score, cast(coalesce(b.score, 100e0) as bigint) as after_score,
      cast(coalesce(b.score, 100e0) - coalesce(a.score, 100e0) as bigint) as delta from a full outer join b on a.category = b.category"""


@plan("jon15_site_compare", "pages")
def jon15(d: Dialect) -> str:
    return f"""with {sides(d)} select coalesce(a.category, b.category) as category, cast(coalesce(a.score, 0e0) as bigint) as score_a, cast(coalesce(b.score, 0e0) as bigint) as score_b,
      cast(coalesce(a.score, 0e0) - coalesce(b.score, 0e0) as bigint) as gap from a full outer join b on a.category = b.category where coalesce(a.category, b.category) <> 'security'"""


@plan("jon16_domain_gap", "pages")
def jon16(d: Dialect) -> str:
    """Hosts linked to by one site only."""
    return f"""with {set_rules(d)}, linked as (select distinct case when host like '%.org' then 'a' else 'b' end as side, lower({d.rx('target', r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)')}) as domain from page_links)
    select domain, min(side) as only_in from linked where domain <> '' group by domain having count(*) = 1"""


@plan("lim01_key_gaps", "pages")
def lim01(d: Dialect) -> str:
    """Of categories in which the second site is behind by a gap, its first five critical findings and errors."""
    return f"""with {sides(d)}, gaps as (select a.category from a join b on a.category = b.category where a.score - b.score >= {KEY_GAP}), ranked as (
      select f.category, f.rule_id, f.page_id, row_number() over (partition by f.category order by f.page_id, f.rule_id, f.sub_check) as rn
      from side_b f join gaps g on f.category = g.category where f.severity in ('critical', 'error'))
    select category, rule_id, page_id, {d.big('rn')} as rn from ranked where rn <= 5"""


@plan("snk03_sarif_levels", "pages")
def snk03(d: Dialect) -> str:
    return f"""with {set_rules(d)} select rule_id, sub_check, case when severity in ('critical', 'error') then 'error' when severity = 'warning' then 'warning' else 'note' end as level,
      count(*) as n from findings group by rule_id, sub_check, severity"""


@plan("flagship_category_scores", "pages")
def flagship(d: Dialect) -> str:
    return agg02(d)
