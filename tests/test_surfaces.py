"""Two forms of a page, with differences and scores worked out by hand."""

import pytest

from sitegrain.functions.surface import n_words, read_surface
from sitegrain.operators import surfaces

URL = "https://shop.test/a/"
SIDE = "messages array<struct<level:string,text:string>>, failed array<struct<url:string,method:string,status:int,kind:string>>, blocked array<struct<url:string,reason:string,impact:string>>, x_robots string"


def _page(head="", body=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "same": (_page("<title>T</title>", "<h1>Hi</h1>"),) * 2,
    "empty": (None, None),
    "canonical-in": (_page(), _page('<link rel="canonical" href="/b">')),
    "canonical-out": (_page('<link rel="canonical" href="/b">'), _page()),
    "canonical-new": (_page('<link rel="canonical" href="/b">'), _page('<link rel="canonical" href="/c">')),
    "noindex-in": (_page(), _page('<meta name="robots" content="NoIndex, follow">')),
    "noindex-out": (_page('<meta name="robots" content="noindex">'), _page('<meta name="robots" content="index">')),
    "robots-new": (_page('<meta name="robots" content="follow">'), _page('<meta name="robots" content="nofollow">')),
    "robots-case": (_page('<meta name="robots" content="Follow">'), _page('<meta name="robots" content="follow">')),
    "title": (_page("<title> A  b </title>"), _page("<title>A c</title>")),
    "title-space": (_page("<title> A  b </title>"), _page("<title>A b</title>")),
    "description": (_page('<meta name="description" content="x">'), _page()),
    "og": (_page('<meta property="og:title" content="x"><meta property="og:type" content="t"><meta property="og:url" content="u"><meta property="og:none" content="u">'), _page('<meta property="og:title" content="y"><meta property="og:image" content="i"><meta property="og:url" content="u">')),
    "twitter": (_page('<meta name="twitter:card" content="x">'), _page()),
    "words-50": (_page(body="<main>" + "one " * 10 + "</main>"), _page(body="<main>" + "one " * 5 + "</main>")),
    "words-51": (_page(body="<main>" + "one " * 100 + "</main>"), _page(body="<main>" + "one " * 49 + "</main>")),
    "words-10": (_page(body="<main>" + "one " * 10 + "</main>"), _page(body="<main>" + "one " * 9 + "</main>")),
    "hydrated": (_page(body="<div></div>"), _page(body="<div><main>" + "word " * 101 + "</main></div>")),
    "headings": (_page(body="<h1>One</h1><h2>x</h2><h3>y</h3><h4>z</h4><h5>w</h5>"), _page(body="<h1>One</h1><h1>Two</h1>")),
    "links": (_page(body='<a href="/x">nav</a><a href="/x">nav</a><a href="https://o.test/1">o</a><a href="#in">o</a>'), _page(body='<a href="/y">nav</a><a href="/z">nav</a>')),
    "images": (_page(body='<img src="/1.png" alt="a"><img src="/2.png" alt="b">'), _page(body='<img src="/1.png" alt=" "><img data-src="/3.png">')),
    "types": (_page(body='<script type="application/ld+json">{"@type":"Product"}</script>'), _page(body='<script type="application/ld+json">[{"@type":["Product","Offer"]},{"@type":"Person"}]</script>')),
    "hreflang": (_page('<link rel="alternate" hreflang="de" href="/de">'), _page()),
}


@pytest.fixture(scope="module")
def compared(spark):
    rows = [(name, URL, *pair) for name, pair in CASES.items()]
    df = surfaces.scored(surfaces.compared(spark.createDataFrame(rows, "name string, url string, raw_html string, rendered_html string")))
    return {r.name: r for r in df.collect()}


def _brief(row):
    return [(d.aspect, d.severity) for d in row.diffs]


def test_aspects(compared):
    expected = {
        "same": [], "empty": [], "robots-case": [], "title-space": [],
        "canonical-in": [("indexability.canonical", "critical")], "canonical-out": [("indexability.canonical", "high")], "canonical-new": [("indexability.canonical", "high")],
        "noindex-in": [("indexability.metaRobots", "critical")], "noindex-out": [("indexability.metaRobots", "high")], "robots-new": [("indexability.metaRobots", "medium")],
        "title": [("metadata.title", "high")], "description": [("metadata.metaDescription", "high")], "og": [("metadata.openGraph", "medium")], "twitter": [("metadata.twitter", "low")],
        "words-50": [("content.wordCount", "high")], "words-51": [("content.wordCount", "critical")], "words-10": [("content.wordCount", "low")],
        "hydrated": [("content.wordCount", "critical"), ("content.mainTextMissing", "critical")],
        "headings": [("headings.h1", "high"), ("headings.set", "low")],
        "links": [("links.internal", "medium"), ("links.onlyInRendered", "medium"), ("links.internal", "low"), ("links.external", "low")],
        "images": [("images.src", "medium"), ("images.alt", "medium"), ("images.src", "low"), ("images.src", "low")],
        "types": [("structuredData.jsonLd", "high")], "hreflang": [("hreflang", "medium")],
    }
    got = {name: _brief(r) for name, r in compared.items()}
    assert got == expected


def test_evidence(compared):
    one = lambda name, i=0: compared[name].diffs[i]
    assert one("og").evidence == ["Raw og:type present, missing in rendered", "Rendered og:image present, missing in raw", 'og:title changed: "x" → "y"']
    assert (one("og").raw, one("og").rendered) == ("title, type, url", "title, image, url")
    assert one("headings", 1).evidence == ["Only in raw: x, y, z (+1 more)"] and one("headings").evidence == ["Only in rendered: Two"]
    links = {d.title: d for d in compared["links"].diffs}
    assert links["Internal links only present in rendered DOM"].evidence == ["Only in rendered: https://shop.test/y", "Only in rendered: https://shop.test/z"]
    assert links["Internal links removed in rendered DOM"].evidence == ["Only in raw: https://shop.test/x"] and links["External links differ between raw and rendered"].evidence == ["Only in raw: https://o.test/1"]
    assert [d.title for d in compared["images"].diffs] == ["Images only present in rendered DOM", "Missing alt text increased in rendered DOM", "Images removed in rendered DOM", "Lazy-loaded images detected"]
    assert one("types").evidence == ["Raw JSON-LD blocks: 1", "Rendered JSON-LD blocks: 2", "Types only in rendered: Offer, Person"]
    assert one("hydrated").title == "Visible word count increased by 100%"


def test_scores(compared):
    parts = lambda name: tuple(compared[name][c] for c in (*surfaces.SHARES, "overall"))
    assert parts("same") == parts("empty") == (100, 100, 100, 100, 100, 100)
    assert parts("noindex-in") == (0, 100, 100, 100, 100, 65) and parts("noindex-out") == (60, 100, 100, 100, 100, 86) and parts("robots-new")[0] == 85
    assert parts("title") == (100, 100, 75, 100, 100, 96) and parts("types") == (100, 100, 100, 50, 100, 95)
    assert parts("words-51") == (100, 49, 100, 100, 100, 87) and parts("hydrated")[1] == 0
    assert compared["images"].asDict()["n_medium"] == 2 and compared["images"].n_low == 2
    assert compared["hydrated"].strategy == "ssr" and compared["words-51"].strategy == "unknown" and compared["words-50"].advice == ["content-ssr"]


def test_what_happened_while_rendering(spark):
    row = ("u", URL, _page(), _page('<meta name="robots" content="noindex">'), [("error", "boom"), ("log", "fine"), ("severe", "bad")], [("/a.js", "GET", 404, "script"), ("/a.png", "GET", 404, "image")], [("/x.js", "csp", "low"), ("/y.js", "robots.txt", "high")], "index")
    calm = ("v", URL, _page("<script>window.__NEXT_DATA__={}</script>", "a b c d"), _page("", ""), [], [], [], None)
    df = spark.createDataFrame([row, calm], "name string, url string, raw_html string, rendered_html string, " + SIDE)
    got = {r.name: r for r in surfaces.scored(surfaces.compared(df)).collect()}
    assert _brief(got["u"]) == [("indexability.metaRobots", "critical"), ("indexability.xRobotsTag", "critical"), ("jsErrors", "high"), ("resourceBlocked", "high"), ("jsErrors", "medium")]
    assert (got["u"].indexability, got["u"].crawlability, got["u"].advice) == (0, 75, ["noindex-raw", "unblock-resources", "fix-js-errors"])
    assert got["u"].diffs[2].evidence == ["[error] boom", "[severe] bad"] and got["u"].diffs[4].rendered == "1"
    assert (got["v"].framework, got["v"].strategy, got["v"].content) == ("nextjs", "csr", 0)
    places = surfaces.listed(surfaces.compared(df), "name").where("name = 'u'").orderBy("place").select("aspect").collect()
    assert [r.aspect for r in places] == [d.aspect for d in got["u"].diffs]


def test_surface():
    s = read_surface('<header>no</header><body><nav>no</nav><article>yes <div class="x ad">no</div><p role="navigation">no</p>and 3.5 don\'t<br>x</article><p>out</p></body>', URL)
    assert s["words"] == 4  # texts of neighbouring elements are joined without a space
    assert read_surface('<main class="nav">in <aside>no</aside></main><article>no</article>', URL)["words"] == 1
    assert read_surface("<title>no</title><p>a b</p><noscript>no</noscript><footer>no</footer>", URL)["words"] == 2
    assert n_words("l'eau, 1,000.5 U.S. e-mail  日本 — …") == 7
    s = read_surface('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"B"},{"@type":"A"},3]}</script>', None)
    assert s["n_json_ld"] == 4 and s["types"] == ["A", "B"]
