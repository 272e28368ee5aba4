from sitegrain.functions.html import extract_page, read_page, resolve, resolve_url, schema_items
from sitegrain.operators.graph import crawl_depth, pagerank
from sitegrain.sources import protocols
from sitegrain.streaming.captures import limits

PAGE = """<html><head><title> A  &amp; B </title><meta name="description" content=" d "><link rel="canonical" href="/c"><link rel="alternate" hreflang="de" href="/de">
<meta property="og:title" content="T"><script type="application/ld+json">{"@graph": [{"@type": "Person"}]}</script><script>var t="</p>";</script></head>
<body><h1>One</h1><h3>Three</h3><p><b>un<br><a href="/x y?a=b#f">Link</a><a href="mailto:a@b">m</a><a href="HTTPS://Other.org:443/é"></a><img src="i.png" alt=" ok "><img src="j.png"></body>"""


def test_read_page():
    p = read_page(PAGE, "https://example.com/dir/")
    assert (p["title"], p["description"], p["canonical"]) == ("A & B", "d", "https://example.com/c")
    assert p["h1"] == ["One"] and p["levels"] == [1, 3]
    assert [(x["url"], x["text"], x["is_internal"]) for x in p["links"]] == [
        ("https://example.com/x%20y?a=b#f", "Link", True), ("https://other.org/%C3%A9", "[Empty Link Text]", False)
    ]
    assert p["images"] == [{"src": "https://example.com/dir/i.png", "alt": "ok"}, {"src": "https://example.com/dir/j.png", "alt": None}]
    assert p["hreflang"] == [{"lang": "de", "url": "https://example.com/de"}] and p["open_graph"] == {"title": "T"}
    assert schema_items(p["json_ld"][0]) == [{"@type": "Person"}] and schema_items("{")[0]["__error"]
    assert read_page(None, None)["title"] is None


def test_resolve():
    assert resolve("../a", "http://h.com/b/c") == "http://h.com/a"
    assert resolve("", "HTTP://H.com:80") == "http://h.com/"


def test_udfs(spark):
    df = spark.createDataFrame([(PAGE, "https://example.com/", "/q"), (None, None, None)], "html string, url string, href string")
    rows = df.select(extract_page("html", "url").alias("p"), resolve_url("href", "url").alias("u")).select("p.title", "p.links", "u").collect()
    assert rows[0].title == "A & B" and len(rows[0].links) == 2 and rows[0].u == "https://example.com/q" and rows[1].title is None


def test_robots(spark):
    """Groups of several agents, comments, stars in the middle, an end mark, and rules of another host."""
    rules = "User-agent: crawler-x\nDisallow: /\n\nUser-agent: *\nDisallow: /cart # not for machines\nDisallow: /*/draft-\nDisallow: /print$\nAllow: /"
    hosts = [("shop.test", rules), ("open.test", "User-agent: *\nDisallow:\n"), ("shut.test", "User-agent: *\nDisallow: /")]
    table = protocols.robots_rules(spark.createDataFrame(hosts, "host string, content string"))
    asked = {
        "shop.test": {"/": True, "/cart": False, "/cart/7": False, "/news/draft-2": False, "/draft-2": True, "/print": False, "/print/a": True},
        "open.test": {"/cart": True}, "shut.test": {"/": False, "/x": False},
    }
    paths = spark.createDataFrame([(h, p) for h, x in asked.items() for p in x], "host string, path string")
    kept = {(r.host, r.path) for r in protocols.robots_allowed(paths, table).collect()}
    assert kept == {(h, p) for h, x in asked.items() for p, allowed in x.items() if allowed}


def test_llms_and_sitemap(spark):
    files = spark.createDataFrame([("h", "User-agent: GPT\nUser-agent: X\nAllow: /a\nnonsense\nUser-agent: *\nDisallow: /")], "host string, content string")
    sections = protocols.llms_sections(files)
    assert [(r.section, r.agents, r.allows, r.disallows) for r in sections.orderBy("section").collect()] == [(1, ["GPT", "X"], ["/a"], []), (2, ["*"], [], ["/"])]
    assert [protocols.bot_status(sections, b).first().status for b in ("gpt", "z")] == ["allowed", "disallowed"]
    assert [r.line for r in protocols.llms_errors(files).collect()] == [4]
    xml = spark.createDataFrame([("h", "<LOC> http://a.b/c </LOC><loc>ftp://x</loc>")], "host string, content string")
    assert [r.loc for r in protocols.sitemap_locations(xml).collect()] == ["http://a.b/c"]


def test_backlink_csv(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('Linking Page,Target URL,Anchor Text\nhttps://a.org,https://b.org,"x, ""y"""\n')
    assert tuple(protocols.backlink_csv(spark, str(path)).first()) == ("https://a.org", "https://b.org", 'x, "y"')


def test_pagerank(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    assert all(abs(r["rank"] - 1) < 1e-6 for r in pagerank(nodes, ring).collect())
    two = spark.createDataFrame([("a",), ("b",)], "url string")
    first = {r.url: round(r["rank"], 3) for r in pagerank(two, ring.where("source = 'a'"), iterations=1).collect()}
    assert first == {"a": 0.575, "b": 1.425}
    assert {r.url: r.depth for r in crawl_depth(ring, nodes.where("url = 'a'")).collect()} == {"a": 1, "b": 2, "c": 3}


def test_concurrency_limits():
    assert limits([True] * 25, 5)[-6:] == [6, 7, 8, 9, 10, 10]
    assert limits([False] * 20, 8)[-1] == 4
