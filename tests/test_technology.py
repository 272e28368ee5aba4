"""Technologies of literal pages, worked out by hand."""

from sitegrain.functions.markers import channels
from sitegrain.operators import technology

SCHEMA = "n string, url string, html string, headers map<string,string>"


def _row(name, html, headers=None):
    return (name, "https://shop.test/a", html, headers)


ROWS = [
    _row("nothing", None), _row("plain", "<html><body>text</body></html>", {}),
    _row("next", '<script id="__NEXT_DATA__">{}</script><img src="/_next/image?u=1"><div data-reactroot>x</div>', {"X-Powered-By": "Next.js 15"}),
    _row("react", '<div data-reactroot></div><script src="/react-dom.js"></script>'), _row("react-weak", '<script src="/react-dom.js"></script>'),
    _row("vue", "<script>createApp(x)</script><p>__vueApp</p>" + "text " * 60), _row("vue-only-call", "<script>createApp(x)</script>"),
    _row("emotion", '<style data-emotion="css abc"></style>'), _row("mui", '<style data-emotion="mui abc"></style><p class="MuiButton-root">x</p>'), _row("mui-weak", '<style data-emotion="mui abc"></style>'),
    _row("headers", "<p>x</p>", {"SERVER": "cloudflare", "CF-Ray": "1", "x-vercel-id": "", "X-AspNet-Version": "4"}),
    _row("php", "<p>short</p>", {"x-powered-by": "PHP/8"}), _row("akamai-weak", "", {"server-timing": "cdn-cache; desc=HIT"}),
    _row("hosts", '<img src="//a.imgix.net/x.png"><img src="https://imgix.net.evil.test/x.png"><script src="https://IK.imagekit.io/y.js"></script>'), _row("no-host", '<img src="/imagekit.io/x.png"><img src="https://notimgix.net/x">'),
    _row("two-fragments", '<script src="https://static.hotjar.com/c.js"></script><script>hjSettings={};hotjar(1)</script>'),
    _row("generator", '<meta name="generator" content="Drupal 10"><meta name="generator" content="WordPress"><script>Drupal = {}</script>'), _row("wf", '<div DATA-WF-PAGE="1" data-wf-site="2"></div>'),
    _row("case", '<LINK HREF="https://FONTS.googleapis.com/css" REL="Stylesheet"><script>window.gtag("x")</script>'),
]


def _got(spark):
    rows = technology.listed(spark.createDataFrame(ROWS, SCHEMA), "n").collect()
    out = {n: [] for n, *_ in ROWS}
    for r in rows:
        out[r.n].append((r.category, r.name, r.confidence, r.level))
    return out, rows


def test_technologies(spark):
    got, rows = _got(spark)
    shell, server = ("renderingStrategy", "Likely client-rendered shell", 70, "medium"), ("renderingStrategy", "Server-rendered HTML", 70, "medium")
    assert got == {
        "nothing": [], "plain": [], "react-weak": [], "vue-only-call": [], "no-host": [], "akamai-weak": [], "mui-weak": [("uiLibraries", "Emotion", 70, "medium")],
        "next": [("frontendFramework", "Next.js", 95, "high"), ("renderingStrategy", "Hybrid / SSR / SSG", 80, "high")],
        "react": [("frontendFramework", "React", 95, "high"), shell],
        "vue": [("frontendFramework", "Vue", 80, "high"), ("renderingStrategy", "Client framework with pre-rendered HTML", 65, "medium")],
        "emotion": [("uiLibraries", "Emotion", 70, "medium")], "mui": [("uiLibraries", "Material UI", 85, "high")],
        "headers": [("backend", "ASP.NET", 55, "medium"), ("cdn", "Cloudflare", 95, "high"), server], "php": [("backend", "PHP", 65, "medium"), server],
        "hosts": [("fonts", "ImageKit", 80, "high"), ("fonts", "Imgix", 80, "high")], "two-fragments": [("analytics", "Hotjar", 95, "high")],
        "generator": [("cms", "Drupal", 90, "high"), server], "wf": [("cms", "Webflow", 85, "high"), server], "case": [("fonts", "Google Fonts", 75, "medium")],
    }
    evidence = {(r.n, r.name): r.evidence for r in rows}
    assert evidence["two-fragments", "Hotjar"] == ["asset: hotjar.com | static.hotjar.com", "inline: hjSettings | hotjar("]
    assert technology.detected(spark.createDataFrame(ROWS, SCHEMA)).where("has_backend").count() == 2


def test_channels():
    texts, length = channels("<title>no</title><script>var a = 1</script> b <script src='/x.js'></script><style>c</style>", None, {"A-B": None})
    assert (texts["script"], texts["inline"], texts["header:a-b"], length) == ("/x.js", "var a = 1", "", len("var a = 1 b c"))


def test_text_of_the_head_is_not_the_bodys():
    """A title's end does not end the head: styles and scripts after it are not the body's text."""
    head = "<head><meta charset='utf-8'><title>no</title><style>p{margin:0}</style><script>track(1)</script>"
    assert channels(f"<html>{head}</head><body>a &copy; b<script>c</script></body></html>", None, None)[1] == len("a &copy; bc")
    assert channels(f"<html>{head}<body>text", None, None)[1] == channels(f"{head}<p>text", None, None)[1] == channels(f"{head} text", None, None)[1] == len("text")
    assert channels(head, None, None)[1] == 0


def test_comments_are_spaces_and_added_markup_is_no_text():
    """As the SQL of an07_technology measures a page: without the markup that the query puts behind it."""
    page = "<head><!-- no --><title>no</title></head><body><p>a</p><!-- c --><p>b</p></body>"
    assert channels(page, None, None)[1] == len("a b")
    texts, length = channels(page, None, None, '<script id="__NEXT_DATA__">{}</script><img src="/x.png">')
    assert (texts["inline"], texts["asset"], length) == ("{}", "/x.png", len("a b")) and "__next_data__" in texts["html"]
    assert channels("<p>a <a href='", None, None, "<script src='/y.js'></script>")[0]["asset"] == "/y.js"


def test_strategy_goes_by_the_pages_own_text(spark):
    def strategy(text: str, added: str | None) -> list:
        rows = spark.createDataFrame([(f"<body>{text}<!-- c --></body>", "https://a.example/", added)], "html string, url string, added string")
        return [r.confidence for r in technology.listed(rows).where("category = 'renderingStrategy'").collect()]

    mark = '<script id="__NEXT_DATA__">{}</script>'
    assert strategy("x" * 199, mark) == [80]
    assert strategy("x" * 200, mark) == [90]
    assert strategy("x" * 199 + "<!-- c -->y", mark) == [90]
    assert strategy("x" * 200, None) == []
