"""Scalar functions, structured data, trust judgements and opportunities on literal inputs."""

import pytest
from pyspark.sql import functions as F

from sitegrain.functions import scalars, structured
from sitegrain.functions.html import extract_page
from sitegrain.operators import opportunities, signatures, trust
from sitegrain.operators import structured as over


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert [_one(spark, scalars.js_round(lit(x))) for x in (2.5, -2.5)] == [3, -2]
    assert _one(spark, scalars.finding_id(lit("r"), lit("https://example.com/"), lit("")))[:18] == "r:aHR0cHM6Ly9leGFt"
    h = 0
    for c in "missing":
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    h, digits = abs(h - 2**32 if h >= 2**31 else h), ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    assert _one(spark, scalars.finding_id(lit("r"), lit("https://example.com/"), lit("missing"))).endswith(f":{digits}")
    import hashlib

    data = '{"aspect":"title","url":"https://e.org/\\"q\\"","payload":{"a":1}}'
    assert _one(spark, scalars.diff_id(lit("title"), lit('https://e.org/"q"'), lit('{"a":1}'))) == hashlib.sha256(data.encode()).hexdigest()[:16]
    assert [str(_one(spark, scalars.parse_date(lit(x)))) for x in ("2024-01-02 03:04:05", "/Date(0)/", "10/Oct/2023:13:55:36 +0000", "no")] == [
        "2024-01-02 03:04:05", "1970-01-01 00:00:00", "2023-10-10 13:55:36", "None"]
    assert tuple(_one(spark, scalars.cache_facts(lit("public, max-age = 90000, immutable"), lit("/a.0123abcd.png")))) == (90000, False, True, True)
    assert _one(spark, scalars.srcset_urls(lit("a.png 1x, , b.png 2x"))) == ["a.png", "b.png"]
    assert _one(spark, scalars.style_urls(lit("background:url('x.png'), URL(data:abc)"))) == ["x.png"]
    assert _one(spark, scalars.anchor_theme(lit("https://e.org/a"), lit("One, two three four five"))) == "One two three four"
    assert [_one(spark, scalars.anchor_text(lit("https://e.org/blue-shoes.html"), t)) for t in (lit(" Title "), lit(None).cast("string"))] == ["Title", "Blue shoes"]
    assert _one(spark, scalars.phone_digits(lit("+1 (555) 010-2233"))) == "5550102233"
    assert _one(spark, scalars.topic_label(scalars.topic_key(lit("therapies glass clinics")))) == "Therapy Glass Clinic"
    assert _one(spark, scalars.normal_keyword(lit("  Büro-Stühle, 24!  "))) == "büro stühle 24"
    assert _one(spark, scalars.lower_headers(F.create_map(lit("X-A"), lit("v")))) == {"x-a": "v"}
    assert _one(spark, scalars.same_json(lit('{"a":1,"b":2}'), lit('{"b":2, "a":1}')))
    assert _one(spark, scalars.escape_html(lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert [_one(spark, scalars.framework_hint(lit(x))) for x in ("<script>__NEXT_DATA__</script>", '<div id="app">', "plain")] == ["nextjs", "vue", None]
    assert _one(spark, scalars.internal_link_density(lit(3), lit(200))) == 1.5


def test_min_hash(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta iota", "too short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", scalars.shingles(F.col("t")))
    rows = df.withColumn("h", scalars.hashed(F.col("s"))).withColumn("m", scalars.min_hash(F.col("h"))).collect()

    def brute(shingles):
        out = [2**40] * 64
        for s in shingles:
            a = b = 0
            for c in s:
                a, b = (a * 31 + ord(c)) % 2**32, (b * 37 + ord(c)) % 2**32
            out = [min(x, (a + i * b) % 2**32 % 2147483647) for i, x in enumerate(out)]
        return out

    assert [r.m for r in rows] == [brute(rows[0].s), brute(rows[1].s), None]
    like = _one(spark, scalars.estimated_likeness(F.array(*map(F.lit, rows[0].m)), F.array(*map(F.lit, rows[1].m))))
    assert like == sum(x == y for x, y in zip(rows[0].m, rows[1].m)) / 64


MICRO = """<div itemscope itemtype="https://schema.org/Product" itemid="#p"><h1 itemprop="name"> Lamp </h1><img itemprop="image" src="l.png"><meta itemprop="sku" content="7">
<div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><span itemprop="price">9</span><time itemprop="validFrom" datetime="2024">now</time></div><b itemprop="color">red</b><b itemprop="color">blue</b></div>"""
RDFA = '<div vocab="https://schema.org/" typeof="schema:Person" resource="#me"><span property="schema:name">Ann</span><a property="url" href="/ann">x</a></div>'


def test_microdata_and_rdfa():
    assert structured.microdata(MICRO) == [
        {"@type": "Product", "@id": "#p", "name": "Lamp", "image": "l.png", "sku": "7", "offers": {"@type": "Offer", "price": "9", "validFrom": "2024"}, "color": ["red", "blue"]}
    ]
    assert structured.rdfa(RDFA) == [{"@type": "Person", "@id": "#me", "name": "Ann", "url": "/ann"}]
    assert structured.microdata(None) == structured.rdfa("<p>") == []


def test_merging():
    assert structured.deep_merge({"@type": "A", "x": [1], "y": {"z": 1}}, {"@type": "B", "x": [1, 2], "y": {"w": 2}, "n": 3}) == {"@type": "A", "x": [1, 2], "y": {"z": 1, "w": 2}, "n": 3}
    merged = structured.merge_items([{"@type": "https://schema.org/A", "@id": "1", "x": 1}, {"__error": True}, {"@type": ["A", "B"], "@id": "1", "y": 2}, {"@type": "C", "n": "k", "a": 1}, {"@type": "C", "n": "k", "b": 2}])
    assert merged == [{"@type": "A", "@id": "1", "x": 1, "y": 2}, {"@type": "C", "n": "k", "a": 1, "b": 2}, {"__error": True}]


@pytest.mark.parametrize(
    ("item", "page", "expected"),
    [
        ({"__error": True}, None, {("error", "")}),
        ({}, None, {("error", "@type")}),
        ({"@type": "Article", "headline": "H"}, None, {("error", "author"), ("warning", "datePublished"), ("warning", "image"), ("warning", "description")}),
        ({"@type": "BreadcrumbList", "itemListElement": [{"position": 1}]}, None, {("error", "itemListElement")}),
        ({"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q"}]}, None, {("error", "mainEntity")}),
        ({"@type": "Person", "name": "P", "url": "u", "image": "i", "sameAs": "https://en.wikipedia.org/x"}, None, {("info", "sameAs")}),
        (
            {"@type": "Product", "name": "Lamp", "image": "i", "description": "d", "brand": "b", "offers": {"price": 9, "priceCurrency": "eur"}},
            {"title": "Chairs", "url": "https://e.org/", "open_graph": {"price:amount": "10", "price:currency": "EUR"}},
            {("warning", "name"), ("warning", "offers.price")},
        ),
    ],
)
def test_validation(item, page, expected):
    assert {(level, prop) for level, prop, _ in structured.issues(item, page)} == expected


GRAPH = """<script type="application/ld+json">{"@graph": [{"@type": "Article", "@id": "#a", "headline": "T", "author": {"@type": "Person", "@id": "#p", "name": "Ann"}},
{"@type": "Organization", "@id": "#o", "employee": {"@id": "#p"}, "parent": {"@id": "#gone"}}, {"@type": "Person", "@id": "#p", "worksFor": {"@type": "Organization", "@id": "#o"}}, {"@type": "Event", "@id": "#e", "name": "x"}]}</script>"""


def test_entity_graph(spark):
    pages = spark.createDataFrame([("https://e.org/", GRAPH), ("https://e.org/2", MICRO), ("https://e.org/3", None)], "url string, html string")
    found = over.extracted(pages).persist()
    assert {(r.kind, r.id) for r in over.nodes(found).collect()} == {("Article", "#a"), ("Person", "#p"), ("Organization", "#o"), ("Event", "#e"), ("Product", "#p"), ("Offer", None)}
    assert {(r.from_id, r.property, r.to_id, r.resolved) for r in over.edges(found).where("url = 'https://e.org/'").collect()} == {
        ("#a", "author", "#p", True), ("#o", "employee", "#p", True), ("#o", "parent", "#gone", False), ("#p", "worksFor", "#o", True)}
    assert [r.to_id for r in over.unresolved(found).collect()] == ["#gone"]
    assert [r.id for r in over.isolated(found).collect()] == ["#e"]
    tree = found.where("url = 'https://e.org/'").select(F.explode("tree").alias("t")).select("t.*").collect()
    assert max(r.depth for r in tree) == 4 and any(r.circular for r in tree)
    c = over.coverage(found).first()
    assert (c.entities, c.refs) == (6, 5) and "WebSite" in c.missing and "Person" in c.types
    items = over.validated(found)
    assert items.where("kind = 'Article'").first().valid and over.totals(items).first()["items"] == items.count()
    assert over.validated(found, ("event",)).count() == 1 and over.issue_rows(found).where("kind = 'Event' and level = 'error'").count() == 2
    assert over.mermaid(over.edges(found)).first().graph.startswith("graph TD\n")
    twice = over.extracted(spark.createDataFrame([(u, f'<script type="application/ld+json">{{"@type": "Person", "@id": "#p", "name": "{n}"}}</script>') for u, n in (("a", "Ann"), ("b", "Bob"))], "url string, html string"))
    assert [(r.kind, r.id, r.property, r.n_values) for r in over.conflicts(twice).collect()] == [("Person", "#p", "name", 2)]


def test_trust(spark):
    html = '<meta name="author" content="A"><article><header><nav><a href="/about">About us</a><a href="/privacy">Privacy</a><a href="https://en.wikipedia.org/wiki/X">W</a></nav></header><p>I tested it.</p></article>'
    pages = spark.createDataFrame([("https://e.org/", html), ("http://e.org/b", None)], "url string, html string")
    facts = pages.select("url", "html", extract_page("html", "url").alias("p")).select("url", "html", "p.text", "p.links", "p.json_ld")
    rows = {r.url: r for r in trust.pillars(facts).collect()}
    a, b = rows["https://e.org/"], rows["http://e.org/b"]
    assert (a.experience, a.expertise, a.authority, a.trust) == (80, 90, 70, 100) and (b.experience, b.expertise, b.authority, b.trust, b.overall) == (50, 50, 50, 50, 50)
    assert {r.sub_check for r in trust.pillar_findings(trust.pillars(facts)).where("url = 'http://e.org/b'").collect()} == {"experience", "expertise", "authority", "trust"}
    ready = {r.url: r.score for r in trust.citation_readiness(facts, spark.createDataFrame([("e.org",)], "host string")).collect()}
    assert ready == {"https://e.org/": 100, "http://e.org/b": 70}
    nets = [("u1", [("en", "u2"), ("fr", "u3")]), ("u2", [("en", "u1"), ("x-default", "u1")]), ("u3", [("fr", "u1"), ("x-default", "u3"), ("english", "u9")])]
    df = spark.createDataFrame([(u, [{"lang": k, "url": t} for k, t in h]) for u, h in nets], "url string, hreflang array<struct<lang:string,url:string>>")
    found = {(r.url, r.lang, r.target, r.issue) for r in trust.alternate_issues(df).collect()}
    assert found == {("u2", "x-default", "u1", "not-returned"), (None, "x-default", "u1", "several-defaults"), ("u3", "english", "u9", "invalid-lang")}


def test_opportunities(spark):
    pages = spark.createDataFrame(
        [("https://e.org/product/1", "Lamp", 2, 3, False, 0, True), ("https://e.org/a", "A", 1, 0, True, 1, True), ("https://e.org/login", "L", 1, 0, True, 0, True), ("https://e.org/deep", "D", 5, 1, False, 0, True)],
        "url string, title string, depth int, in_degree int, is_orphan boolean, n_schemas int, has_vitals boolean",
    )
    findings = spark.createDataFrame(
        [("https://e.org/product/1", "missing-title", "critical", "metadata", "", ""), ("https://e.org/a", "lcp-metric", "error", "performance", "", ""), ("https://e.org/login", "canonical-issues", "error", "indexing", "", "")],
        "url string, rule_id string, severity string, category string, message string, recommendation string",
    )
    gsc = spark.createDataFrame([("https://e.org/product/1", 2000, 10, 0.005, 8.0)], opportunities.GSC)
    rows = {(r.kind, r.url[13:]): (r.score, r.priority) for r in opportunities.opportunities(pages, findings, gsc).collect()}
    # metadata: visibility min(10, log10(2001) * 1.5 + 4) = 8.95, severity 10, business 10 -> 95.8 + 10 -> 100 and the boost
    assert rows[("metadata", "/product/1")] == (100, "high")
    # performance without search data, depth 1: (6 * .4 + 7 * .3 + 8 * .3) * 10 - 5 = 64, times .8
    assert rows[("performance", "/a")] == (51, "medium")
    # an orphan at depth 1: (2.4 + 1.5 + 2.4) * 10 = 63, times .8
    assert rows[("internal-links", "/a")] == (50, "medium")
    # schema: (8.95 * .4 + 5 * .3 + 10 * .3) * 10 + 5 = 85.8 -> 86, plus two boosts
    assert rows[("schema", "/product/1")] == (100, "high")
    assert {k for k in rows if k[1] in ("/login", "/deep")} == set()
    every = opportunities.opportunities(pages, findings, gsc)
    assert [r.url[13:] for r in opportunities.ranked(every, 2).collect()] == ["/product/1", "/product/1"] and opportunities.ranked(every, least="high").count() == 2
    assert {r.kind: (r.high, r.medium, r.low) for r in opportunities.summary(every).collect()}["content"] == (0, 0, 0)
    assert opportunities.opportunities(pages.limit(0), findings).count() == 0 and opportunities.enriched_pages(pages, gsc, spark.createDataFrame([], opportunities.CRUX)) == 1


def test_near_pairs_come_once_a_way(spark):
    """Signatures that share several bands, one band or none; what meets in several bands is one pair a way."""
    base = list(range(64))
    other = [x if x >= 8 else -x - 1 for x in base]  # 56 of 64
    far = [x if x < 4 else 1000 + x for x in base]  # one band, 4 of 64
    signed = spark.createDataFrame([(s,) for s in (base, other, far, [5000 + x for x in base])], "sig array<bigint>")
    got = [(r.a, r.b, r.likeness) for r in signatures.near_pairs(signed).collect()]
    assert sorted(got) == sorted([(base, other, 56 / 64), (other, base, 56 / 64)])
    plan = signatures.near_pairs(signed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # pairs that merely meet are not shuffled


def test_near_kinds_are_exact_and_meet_few(spark, monkeypatch):
    """Against all pairs; a family around one signature is settled by its first, without pairs among its members."""
    import random

    from sitegrain.operators import signatures

    rng = random.Random(5)
    sigs = []
    for family in range(12):
        base = [rng.randrange(2**31) for _ in range(64)]
        for member in range(25):
            sigs.append([rng.randrange(2**31) if i < rng.choice((0, 3, 6, 7, 12, 13, 20)) else v for i, v in enumerate(base)])
    sigs += [sigs[0], [rng.randrange(2**31) for _ in range(64)]]
    rows = list(enumerate(sigs))
    agree = lambda a, b: sum(x == y for x, y in zip(a, b))
    best = {i: max(agree(a, b) for j, b in rows if j != i) for i, a in rows}
    signed = spark.createDataFrame(rows, "page_id int, sig array<bigint>")
    assert {tuple(r) for r in signatures.near_kinds(signed).collect()} == {(i, 1.0 if n >= 58 else 0.8) for i, n in best.items() if n >= 52}
    assert signatures.near_kinds(signed.limit(0)).collect() == []

    made, keep = {}, signatures.materialise
    monkeypatch.setattr(signatures, "materialise", lambda df, name="table": made.setdefault(name, keep(df, name)))
    base = [rng.randrange(2**31) for _ in range(64)]
    family = [(i, [*base[:-3], *(rng.randrange(2**31) for _ in range(3))]) for i in range(200)]
    assert signatures._with_another(spark.createDataFrame(family, "page_id int, sig array<bigint>").selectExpr("sig", "true as sought"), 58).count() == 200
    assert made["met"].count() <= 7 * 200 and made["met"].join(made["found"], "sig", "left_anti").count() == 0
