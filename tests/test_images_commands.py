"""Image discovery and rules, crawl admission, comparisons and breakdowns on literal inputs."""

from pyspark.sql import functions as F

from sitegrain.operators import commands, images

HTML = """<link rel="preload" as="image" href="/hero.webp"><div style="background: url('bg.png')"></div><img src="a.jpg" alt="A" width="10" height="20" loading="lazy" srcset="a-2.jpg 2x">
<picture><source srcset="p.avif 1x, p2.avif 2x"><img src="p.jpg"></picture><img src="data:image/png;base64,x">"""


def test_discovery(spark):
    pages = spark.createDataFrame([("https://e.org/", HTML, 1), ("https://e.org/b/", '<img src="/a.jpg" alt="other" decoding="async">', 2), ("https://e.org/c", None, 3)], "url string, html string, crawl_seq bigint")
    rows = {r.src.removeprefix("https://e.org/"): r for r in images.discovered(pages).collect()}
    assert set(rows) == {"hero.webp", "bg.png", "a.jpg", "a-2.jpg", "p.avif", "p2.avif", "p.jpg"} and rows["hero.webp"].is_preload
    a = rows["a.jpg"]
    assert (a.alt, a.loading, a.decoding, a.width, a.pages) == ("A", "lazy", "async", 10, ["https://e.org/", "https://e.org/b/"])


def test_rules_and_scores(spark):
    big, base = 600 * 1024, "src string, alt string, width int, height int, loading string, decoding string, pages array<string>, seq bigint, status_code int, bytes bigint, cache_control string, format string"
    rows = [
        ("https://e.org/big.jpg", "x", 10, 10, None, None, ["https://e.org/"], 1, 200, big, "max-age=90000", "jpeg"), ("http://e.org/n.webp", " ", None, None, "lazy", None, ["https://e.org/"], 2, 200, 10, "max-age=90000", "webp"),
        ("https://e.org/gone.png", "x", 1, 1, None, None, [], 3, 404, None, None, None), ("https://e.org/low-1.webp", "x", 700, 9, None, "async", [], 4, 200, 10, "no-store", "webp"), ("https://e.org/low-2.webp", "x", 700, 9, "lazy", "async", [], 5, 200, 10, None, "webp"),
        ("https://e.org/huge.png", "x", 1, 1, "lazy", "async", ["https://e.org/"], 6, 200, 2 * 1024 * 1024, "max-age=90000", "png"),
    ]
    df = spark.createDataFrame(rows, base)
    found = images.findings(df)
    by = {}
    for r in found.collect():
        by.setdefault(r.subject.rsplit("/", 1)[1] or "page", set()).add((r.rule_id, r.severity))
    assert by["big.jpg"] == {("image-weight", "critical"), ("image-format", "warning")}
    assert by["n.webp"] == {("image-alt", "warning"), ("image-cls", "error"), ("image-loading", "error"), ("image-mixed-content", "error")}
    assert by["gone.png"] == {("image-broken", "critical")} and by["page"] == {("page-total-image-weight", "error")}
    assert by["low-1.webp"] == {("image-loading", "warning")} and by["low-2.webp"] == {("image-caching", "warning")}
    scored = {r.src.rsplit("/", 1)[1]: (r.score, r.worst_rule) for r in images.scores(df, found).collect()}
    assert scored["big.jpg"] == (55, "image-weight") and scored["low-2.webp"] == (90, "image-caching") and scored["n.webp"][0] == 30
    assert images.site_score(images.scores(df, found)).first().images == 6
    runtime = spark.createDataFrame([("x", "https://e.org/big.jpg", 100, 1000, True, True)], "src string, current_src string, rendered_width int, natural_width int, in_viewport boolean, is_lcp boolean")
    live = {(r.rule_id, r.severity) for r in images.findings(images.with_runtime(df, runtime), rendered=True).where("subject like '%big.jpg'").collect()}
    assert {("image-delivery", "error"), ("image-lcp", "warning")} <= live


def test_commands(spark):
    links = spark.createDataFrame([("https://e.org/en/a", 2), ("https://e.org/en/a", 1), ("https://e.org/de/b", 1), ("https://e.org/en/c?x=1", 1), ("https://e.org/en/private/d", 1)], "url string, depth int")
    seen = spark.createDataFrame([("https://e.org/en/z",)], "url string")
    rules = spark.createDataFrame([("e.org", "^/en/private/")], "host string, pattern string")
    got = commands.admitted(links, seen, ("*/en/*",), ("*x=?",), rules, 9).collect()
    assert [(r.url, r.depth) for r in got] == [("https://e.org/en/a", 1)] and commands.admitted(links, seen, max_pages=2).count() == 1
    pages = spark.createDataFrame([("https://e.org/", 200, 5, 1), ("https://e.org/x", 500, 7, 2)], "url string, status_code int, load_time_ms int, crawl_seq int")
    locations = spark.createDataFrame([("e.org", u) for u in ("https://e.org/", "https://e.org/x", "https://e.org/y")], "host string, loc string")
    assert tuple(commands.sitemap_check(locations, pages).first()) == ("e.org", 3, 1, 1, 1) and commands.crawled(pages).first().load_time_ms == 5
    status = spark.createDataFrame([("t1", 404), ("t2", 200), ("t3", 0)], "target string, status_code int")
    out = spark.createDataFrame([("u", "t1"), ("u", "t1"), ("u", "t2"), ("u", "t3"), ("u", "t4")], "url string, target string")
    assert {r.target for r in commands.external_links(out, status).collect()} == {"t1", "t3"}
    probes = spark.createDataFrame([("https://e.org", False, True), ("https://f.org", True, False)], "origin string, redirects_to_https boolean, has_security_txt boolean")
    assert {(r.url, r.sub_check) for r in commands.site_probes(probes).collect()} == {("https://e.org", "no-https-redirect"), ("https://f.org", "missing-security-txt")}
    scores = spark.createDataFrame([("seo", 90, 60), ("security", 50, 55)], "category string, score_a int, score_b int")
    assert [r.category for r in commands.focused(scores, "content").collect()] == ["seo"] and commands.strong_categories(scores).count() == 1 and commands.focused(scores, None).count() == 2
    parts = spark.createDataFrame([(a, 100 if i else 80) for i, a in enumerate(commands.AI_WEIGHTS)], "area string, score int")
    assert tuple(commands.assistant_breakdown(parts).first()) == (97, "A")
    findings = spark.createDataFrame([("missing-backlink-data", "info")], "rule_id string, severity string")
    assert commands.backlink_breakdown(findings, 2).first().score == 90
    a, b = (spark.createDataFrame(x, "key string, value string") for x in ([("k", "1"), ("same", "2")], [("k", "3"), ("same", "2"), ("new", "4")]))
    assert {tuple(r) for r in commands.diff_settings(a, b).collect()} == {("k", "1", "3"), ("new", None, "4")}
    result = commands.audit_result(findings, pages, spark.createDataFrame([("seo", 90)], "category string, score int")).first()
    assert (result.pages, result.findings, result.scores) == (2, {"info": 1}, {"seo": 90})
    variants = images.discovered(pages.limit(0).select("url", F.lit("").alias("html"), "crawl_seq")).select("src")
    assert commands.image_variants(variants).count() == 0
