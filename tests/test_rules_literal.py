"""Rules and scores on literal pages, with the findings worked out by hand."""

import pytest

from sitegrain import catalog

GOOD = """<html><head><title>A fine title</title><meta name="description" content="What it is about"><meta name="viewport" content="width=device-width, initial-scale=1">
<link rel="canonical" href="https://ex.org/good"><link rel="alternate" hreflang="en" href="https://ex.org/good"><link rel="alternate" hreflang="x-default" href="https://ex.org/good">
<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="i"><meta property="og:url" content="u"><meta name="twitter:card" content="summary">
<script type="application/ld+json">{"@type": "Organization", "sameAs": ["https://www.wikidata.org/wiki/Q1"]}</script></head>
<body><nav><a href="/bad">Bad</a><a href="https://other.org/">Other</a></nav><article><h1>One</h1><h2>Two</h2><h3>Three</h3><ul><li>x</li></ul>
<img src="a.webp" alt="an a" width="10" height="10" loading="lazy" srcset="b 2x"></article></body></html>"""
BAD = """<html><head><title> </title><meta name="robots" content="NoIndex"><link rel="alternate" hreflang="english" href="/x"><link rel="alternate" hreflang="fr" href="/y">
<script type="application/ld+json">{"@type": "Person"}</script></head><body><h1>One</h1><h1>Two</h1><h3>Skipped</h3><div class="pagination x">1</div>
<img src="http://ex.org/a.png"><img src="b.png" alt=""><a href="good">Good</a><form action="http://ex.org/f"></form></body></html>"""
LONG = "<html><head><title>" + "x" * 61 + "</title></head><body>" + "<img src='a.png'>" * 9 + "<script src='a.js'></script>" * 51 + "</body></html>"


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("site"))
    rows = [(1, "https://ex.org/good", GOOD), (2, "https://ex.org/bad", BAD), (3, "http://ex.org/long", LONG), (4, "https://ex.org/none", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def found(spark, site):
    out = {}
    for r in catalog.QUERIES["rules_all_findings"](spark, site).collect():
        out.setdefault(r.page_id, set()).add((r.rule_id, r.sub_check, r.severity))
    return out


@pytest.mark.parametrize(
    ("page", "rule", "sub_checks"),
    [
        (1, "missing-title", set()), (2, "missing-title", {"missing"}), (3, "missing-title", {"too-long"}), (4, "missing-title", {"missing"}),
        (1, "missing-h1", set()), (3, "missing-h1", {"missing"}), (2, "multiple-h1", {"multiple"}), (1, "multiple-h1", set()),
        (1, "missing-alt-text", set()), (2, "missing-alt-text", {"missing"}), (2, "noindex-detection", {"noindex"}), (1, "noindex-detection", set()),
        (2, "pagination-health", {"missing-rel-next-prev"}), (1, "pagination-health", set()), (1, "cls-metric", set()), (3, "cls-metric", {"poor"}),
        (3, "heavy-resources", {"js-size", "request-count"}), (1, "heavy-resources", set()), (1, "image-optimization", set()),
        (2, "image-optimization", {"missing-dimensions", "no-lazy-loading", "no-modern-format", "missing-srcset"}),
        (1, "ai-extractability", set()), (2, "ai-extractability", {"no-semantic-containers"}), (2, "ai-structural-organization", {"broken-hierarchy"}), (1, "ai-structural-organization", set()),
        (1, "ai-entity-clarity", set()), (2, "ai-entity-clarity", {"missing-disambiguation"}), (4, "ai-entity-clarity", {"weak-entity"}),
        (1, "hreflang", set()), (2, "hreflang", {"missing-self-reference", "missing-x-default", "invalid-lang"}), (1, "social-meta", set()),
        (2, "security", {"mixed-content", "insecure-form"}), (3, "security", {"not-https"}), (1, "canonical-issues", set()), (2, "canonical-issues", {"missing"}),
        (1, "orphan-page", set()), (2, "orphan-page", set()), (3, "orphan-page", {"orphan"}), (4, "orphan-page", {"orphan"}), (1, "missing-robots-txt", set()),
    ],
)
def test_findings(found, page, rule, sub_checks):
    assert {s for r, s, _ in found.get(page, ()) if r == rule} == sub_checks


def test_graph_of_pages(spark, site):
    assert {tuple(r) for r in catalog.QUERIES["jon07_page_edges"](spark, site).collect()} == {("https://ex.org/good", "https://ex.org/bad"), ("https://ex.org/bad", "https://ex.org/good")}
    degrees = {r.page_id: (r.in_degree, r.out_degree, r.is_orphan) for r in catalog.QUERIES["gra01_page_degrees"](spark, site).collect()}
    assert degrees == {1: (1, 1, False), 2: (1, 1, False), 3: (0, 0, True), 4: (0, 0, True)}


def test_security_score(spark, site, found):
    """Buckets by hand: capped sums a page, mean over affected pages times 0.4 + 0.6 of their share."""
    from sitegrain.operators.scoring import SECURITY_DEDUCTIONS, SECURITY_FACTORS, SECURITY_WEIGHTS

    total = 0
    for bucket, subs in SECURITY_DEDUCTIONS.items():
        lost = {}
        for page, findings in found.items():
            for rule, sub, severity in findings:
                if rule in ("security", "security-headers") and sub in subs:
                    lost[page] = min(100, lost.get(page, 0) + subs[sub] * SECURITY_FACTORS[severity])
        total += SECURITY_WEIGHTS[bucket] * (100 - (sum(lost.values()) / len(lost) * (0.4 + 0.6 * len(lost) / 4) if lost else 0))
    row = catalog.QUERIES["agg09_security"](spark, site).first()
    assert (row.calculated, row.score) == (int(total + 0.5), min(40, int(total + 0.5)))


def test_heading_jump_and_entities_differ_from_counts(found):
    assert ("ai-structural-organization", "broken-hierarchy", "warning") in found[2]
    assert ("ai-entity-clarity", "missing-disambiguation", "warning") in found[2]


def test_headers_of_captures(spark, tmp_path):
    """Captures that bring headers, load time and depth: each value by itself."""
    columns = "page_id bigint, url string, html string, load_ms bigint, depth bigint, h_csp string, h_csp_report string, h_hsts string, h_xcto string, h_cookie string, h_server string, h_cache string, h_etag string, robots_txt_found boolean"
    rows = [
        (1, "https://e.org/", "<title>a</title>", 1000, 1, "default-src 'self'; object-src 'none'; frame-ancestors 'self'", None, "max-age=63072000; includeSubDomains; preload", "nosniff", "s=1; Secure; HttpOnly; SameSite=Lax", "nginx", "max-age=9", "x", False),
        (2, "https://e.org/b", '<script src="https://cdn.net/a.js"></script><script src="https://cdn.net/b.js" integrity="sha"></script>', 5000, 5, "script-src * 'unsafe-inline' 'unsafe-eval'", None, "max-age=100", "sniff", "s=1", "nginx/1.2", None, None, None),
        (3, "https://e.org/c", "", 3000, None, None, "default-src 'self'", "includeSubDomains", None, None, None, None, None, None),
    ]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/pages.parquet")
    found = {}
    for r in catalog.QUERIES["rules_all_findings"](spark, str(tmp_path)).collect():
        found.setdefault((r.page_id, r.rule_id), set()).add(r.sub_check)
    headers = {"missing-x-frame-options", "missing-referrer-policy", "missing-permissions-policy", "missing-coop", "missing-coep", "missing-corp"}
    assert found[1, "security-headers"] == headers - {"missing-x-frame-options"}
    assert found[2, "security-headers"] == headers | {
        "csp-unsafe-inline-script", "csp-unsafe-eval-script", "csp-script-src-wildcard", "csp-missing-object-src", "csp-missing-default-src", "csp-missing-frame-ancestors",
        "hsts-short-max-age", "hsts-missing-subdomains", "hsts-missing-preload", "invalid-x-content-type-options", "server-version-disclosure",
        "cookie-missing-secure", "cookie-missing-httponly", "cookie-missing-samesite"}
    assert found[3, "security-headers"] == headers | {"csp-report-only", "hsts-invalid", "hsts-missing-preload", "missing-x-content-type-options"}
    assert found[2, "security"] == {"missing-sri"} and (1, "security") not in found
    assert found[2, "lcp-metric"] == {"poor"} and found[3, "lcp-metric"] == {"needs-improvement"} and (1, "lcp-metric") not in found
    assert found[2, "internal-linking"] >= {"deep-link"} and found[1, "missing-robots-txt"] == {"missing"} and (2, "missing-robots-txt") not in found
    assert (1, "caching-headers") not in found and found[2, "caching-headers"] == {"missing-cache-control", "missing-etag"}
