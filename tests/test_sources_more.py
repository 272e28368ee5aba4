"""Captures, side data, backlinks and keywords on literal inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from sitegrain.operators import backlinks, keywords
from sitegrain.sources import captures


def test_capture_scan_and_redirects(spark):
    pages = spark.createDataFrame([(1, "https://e.org/", "<p>")], "page_id bigint, url string, html string")
    row = captures.capture_scan(pages).first()
    assert (row.status_code, row.load_time_ms, row.content_type, row.headers, row.error, row.crawl_seq) == (200, 0, "text/html", {}, None, 1)
    hops = spark.createDataFrame([("a", "b", 301), ("b", "c", 302), ("l1", "l2", 301), ("l2", "l1", 301), *((f"n{i}", f"n{i + 1}", 301) for i in range(8))], "url string, target string, status int")
    start = spark.createDataFrame([("a",), ("l1",), ("n0",), ("z",)], "url string")
    found = {r.url: (r.final, len(r.chain), r.looped, r.broken_off) for r in captures.redirect_chains(start, hops).collect()}
    assert found["a"] == ("c", 2, False, False) and found["z"] == ("z", 0, False, False) and found["n0"] == ("n5", 5, False, True) and found["l1"][2]


def test_weights(spark):
    responses = spark.createDataFrame([("p", "script", "", 10), ("p", "xhr", "text/css", 5), ("p", "image", "image/png", 7), ("p", "font", "font/woff", 1)], "page string, resource_type string, content_type string, bytes bigint")
    assert {(r.kind, r.bytes, r.requests) for r in captures.response_weights(responses).collect()} == {("js", 10, 1), ("css", 5, 1), ("image", 7, 1), ("other", 1, 1)}
    assets = spark.createDataFrame([("p", "js", "app.js"), ("p", "js", "far.js"), ("p", "css", "a.css"), *(("p", "image", f"i{i:03}.png") for i in range(41))], "page string, kind string, url string")
    sizes = spark.createDataFrame([("app.js", 12345), ("a.css", 6789), ("i040.png", 1)], "url string, bytes bigint")
    assert {(r.kind, r.bytes, r.requests) for r in captures.asset_weights(assets, sizes).collect()} == {("js", 47345, 2), ("css", 6789, 1), ("image", 41 * 60000, 41)}


def test_overlays(spark):
    pages = spark.createDataFrame([("https://E.org/a/", 3000.0, 0.2, 300.0, 50), ("https://e.org/b", 1000.0, 0.0, 100.0, 100)], "url string, lcp double, cls double, inp double, performance int")
    lab = spark.createDataFrame([("https://e.org/b", 0.905, 2000.0, 0.0, 90.0)], "url string, score double, lcp double, cls double, inp double")
    field = spark.createDataFrame([("https://e.org/a", 4500.0, None, 200.0)], "url string, lcp double, cls double, inp double")
    rows = {r.url: r for r in captures.overlaid(pages, lab, field).collect()}
    a, b = rows["https://E.org/a/"], rows["https://e.org/b"]
    assert (b.lcp, b.performance, b.vitals_source) == (2000.0, 91, "lab")
    assert (a.lcp, a.cls, a.inp, a.vitals_source, a.performance) == (4500.0, 0.2, 200.0, "field", int(0.4 * 40 + 0.3 * (100 - 33.3) + 30 + 0.5))


def test_exports(spark, tmp_path):
    path = tmp_path / "gsc.json"
    path.write_text('[{"page": "https://e.org/", "impressions": 10, "clicks": 1, "ctr": 0.1, "position": 3.5}, {"url": "x", "impressions": "many"}, {"pageUrl": "y", "impressions": 1, "clicks": 0, "ctr": 0, "position": 9}]')
    rows, bad = captures.search_metrics(spark, str(path))
    assert [(r.url, r.position) for r in rows.orderBy("seq").collect()] == [("https://e.org/", 3.5), ("y", 9.0)] and bad.first().malformed == 1
    path.write_text('{"data": [{"url": "a", "lcp": 2500}, {"url": "b", "cls": "high"}, {"lcp": 1}]}')
    rows, bad = captures.field_metrics(spark, str(path))
    assert [(r.url, r.lcp, r.cls) for r in rows.collect()] == [("a", 2500.0, None)] and bad.first().malformed == 2


def test_search_tables(spark):
    queries = captures.suggestion_queries(spark.createDataFrame([("lamp",)], "seed string"))
    assert {r.source: r.n for r in queries.groupBy("source").agg(F.count("*").alias("n")).collect()} == {
        "direct": 1, "semantic": len(captures.GENERIC_MODIFIERS), "question": len(captures.QUESTIONS), "alphabetical": 26}
    assert queries.where("query in ('lamp a', 'how lamp', 'lamp near me')").count() == 3
    results = spark.createDataFrame([("k", 3, "https://shop.e.org/x"), ("k", 5, "https://e.org/"), ("q", 1, "https://note.org/"), ("q", 12, "https://e.org/")], "keyword string, position int, url string")
    assert {r.keyword: r.position for r in captures.search_rank(results, "e.org").collect()} == {"k": 3, "q": None}
    hits = spark.createDataFrame([("q", "brave", 1, "u1"), ("q", "brave", 2, "u1"), ("q", "mojeek", 1, "u2"), ("w", "bing", 1, "u3")], "query string, engine string, position int, url string")
    assert {(r.query, r.engine, r.url) for r in captures.first_engine(hits).collect()} == {("q", "brave", "u1"), ("w", "bing", "u3")}
    snaps = spark.createDataFrame([("h", "2024-01-01", "a"), ("h", "2024-02-01", "b")], "host string, saved_at string, path string")
    assert captures.latest_snapshots(snaps).first().path == "b"
    headers = spark.createDataFrame([({"CF-Ray": "1"},), ({"Server": "CloudFront"},), ({"server": "nginx"},)], "h map<string,string>")
    assert [r.x for r in headers.select(captures.is_cdn(F.col("h")).alias("x")).collect()] == [True, True, False]


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x06\x00\x00\x00"
    gif = b"GIF89a" + struct.pack("<HH", 5, 6) + b"\x00" * 20
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\x03" + b"\x00" * 12
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X" + struct.pack("<I", 10) + b"\x02\x00\x00\x00" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    for name, raw in (("a.png", png), ("b.gif", gif), ("c.jpg", jpeg), ("d.webp", webp), ("e.txt", b"no image")):
        (tmp_path / name).write_bytes(raw)
    found = {r.path[-5:]: (r.format, r.width, r.height, r.animated) for r in captures.decoded_images(spark, str(tmp_path)).collect()}
    assert found == {"a.png": ("png", 640, 480, False), "b.gif": ("gif", 5, 6, False), "c.jpg": ("jpeg", 40, 30, False), ".webp": ("webp", 100, 50, True), "e.txt": (None, None, None, False)}


def test_backlinks(spark):
    export = spark.createDataFrame([("https://a.org/1", "https://www.me.com/", "Great site"), ("https://a.org/1", "https://else.com/", "x")], "source_url string, target_url string, anchor_text string")
    log = spark.createDataFrame([(f'1.1.1.1 - - [10/Oct/2023:13:55:36 +0000] "GET / HTTP/1.1" {s} 1 "{r}" "agent"',) for s, r in ((200, "https://blog.b.org/x"), (200, "https://www.me.com/y"), (404, "https://c.org/"), (200, "-"))], "line string")
    links = backlinks.merged(backlinks.export_links(export, "https://me.com"), backlinks.log_links(log, "https://me.com"))
    assert {(r.source_url, r.anchor_text, tuple(r.sources)) for r in links.collect()} == {("https://a.org/1", "Great site", ("gsc",)), ("https://blog.b.org/x", None, ("logs",))}
    p = backlinks.profile(links, 1).first()
    assert (p.total, p.referring_domains, p.has_metrics) == (2, 2, False)
    two = backlinks.completed(spark.createDataFrame([("s", "t", "longest anchor", 70.0), ("s", "t", "short", 10.0)], "source_url string, target_url string, anchor_text string, domain_authority double"), "bing")
    r = backlinks.merged(two).first()
    assert (r.anchor_text, r.domain_authority) == ("longest anchor", 70.0)
    risky = backlinks.completed(spark.createDataFrame([(f"s{i}", "t", "same", 10.0) for i in range(4)], "source_url string, target_url string, anchor_text string, domain_authority double"), "bing")
    rules = lambda df, status: {(x.rule_id, x.sub_check) for x in backlinks.findings(df, status, "https://me.com/").collect()}
    assert rules(risky, {"bing": "ok"}) == {("low-authority-backlinks", "risky-profile"), ("missing-high-authority-backlinks", "too-few"), ("anchor-text-over-optimization", "repeated-anchor")}
    assert rules(risky.limit(0), {"bing": "error"}) == {("low-authority-backlinks", "none"), ("missing-backlink-data", "source-error")}


def _suggestions(spark, words, source="direct"):
    return spark.createDataFrame([(w, source, i, i) for i, w in enumerate(words)], "keyword string, source string, idx int, seq int")


@pytest.mark.parametrize(
    ("keyword", "intent"),
    [("nurse jobs", "jobs-career"), ("clinic near me", "local"), ("rehab in austin", "local"), ("buy lamp", "transactional"), ("best lamp", "commercial"), ("why lamp", "informational"), ("lamp", "informational")],
)
def test_intents(spark, keyword, intent):
    assert spark.range(1).select(keywords.intent(F.lit(keyword)).alias("x")).first().x == intent


def test_keyword_research(spark):
    words = ["behavioral health services", "behavioral health treatment", "behavioral health clinics", "behavioral health near me", "behavioral health jobs", "behavioral health treatment plan", "Behavioral  Health services!"]
    kept, dropped = keywords.research(_suggestions(spark, words), "behavioral health")
    assert kept.count() == 6 and dropped.count() == 0
    names = {r.name: (r.kind, r.n) for r in keywords.ordered(keywords.clusters(kept, "behavioral health")).collect()}
    assert {"Services", "Treatment", "Clinics", "Local care", "Careers"} <= set(names) and names["Local care"][0] == "intent" and names["Treatment"][1] == 2
    assert sum(r.n for r in keywords.intent_distribution(kept).collect()) == 6
    noisy = ["healthgrades therapy reviews", "acme therapy phone", "therapy inc address", "therapy for couples"]
    kept, dropped = keywords.research(_suggestions(spark, noisy), "therapy")
    assert [r.keyword for r in kept.collect()] == ["therapy for couples"] and dropped.count() == 3
    kept, dropped = keywords.research(_suggestions(spark, ["nike shoes reviews"]), "nike shoes")
    assert kept.first().allowlisted and dropped.count() == 0
    mixed = spark.createDataFrame([("a b", "semantic", 0, 0), ("A  B", "direct", 5, 1), ("a b", "direct", 2, 2)], "keyword string, source string, idx int, seq int")
    assert [(r.source, r.idx) for r in keywords.deduplicated(mixed).collect()] == [("direct", 2)]
    assert spark.range(1).select(keywords.niche(F.lit("cheap running shoes")).alias("x")).first().x == "E-commerce, Retail & Products"
