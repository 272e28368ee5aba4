"""The page as sent against the page as rendered: differences by aspect, their score, and what to do.

Both forms of a page stand in one row, so every difference is an array or map
expression of that row: nothing is exploded or shuffled, however many links a
page has. Differences are sets in the order of their first appearance; each
keeps five pieces of evidence and the whole count.

Defined results: a null form shows nothing; repeated rows give repeated
results; null messages, requests and blocked resources are none; pages without
a difference have score 100 in all parts (content: 100 for two empty forms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.scalars import framework_hint
from sitegrain.functions.surface import extract_surface

#: Aspects in order of report, severities in order of weight.
ASPECTS = (
    "indexability.canonical", "indexability.metaRobots", "indexability.xRobotsTag", "content.wordCount", "content.mainTextMissing", "metadata.title", "metadata.metaDescription",
    "metadata.openGraph", "metadata.twitter", "headings.h1", "headings.set", "links.internal", "links.external", "links.onlyInRendered", "images.src", "images.alt",
    "structuredData.jsonLd", "hreflang", "jsErrors", "resourceBlocked",
)
SEVERITIES = ("critical", "high", "medium", "low")
OG_KEYS, TWITTER_KEYS = ("title", "description", "image", "type", "url"), ("card", "title", "description", "image", "site", "creator")
#: Shares of the parts in the overall score, and what a difference takes off two of them.
SHARES = {"indexability": 0.35, "content": 0.25, "metadata": 0.15, "structured_data": 0.10, "crawlability": 0.15}
OFF_INDEX, OFF_CRAWL = {"high": 40, "medium": 15, "low": 5}, {"critical": 20, "high": 10, "medium": 5}
#: Advice by priority, with the aspects that call for it.
ADVICE = (
    ("canonical-ssr", 1, ("indexability.canonical",)), ("noindex-raw", 1, ("indexability.metaRobots", "indexability.xRobotsTag")), ("content-ssr", 1, ("content.mainTextMissing", "content.wordCount")),
    ("unblock-resources", 1, ("resourceBlocked",)), ("metadata-ssr", 2, ("metadata.title", "metadata.metaDescription")), ("og-twitter-raw", 2, ("metadata.openGraph", "metadata.twitter")),
    ("headings-ssr", 2, ("headings.h1", "headings.set")), ("links-internal-raw", 2, ("links.internal", "links.onlyInRendered")), ("structured-data-ssr", 2, ("structuredData.jsonLd",)),
    ("hreflang-raw", 2, ("hreflang",)), ("fix-js-errors", 2, ("jsErrors",)),
)
EVIDENCE = 5
_SIDE = "messages array<struct<level:string,text:string>>, failed array<struct<url:string,method:string,status:int,kind:string>>, blocked array<struct<url:string,reason:string,impact:string>>, x_robots string"


def with_surfaces(pairs: DataFrame) -> DataFrame:
    """``pairs(url, raw_html, rendered_html, ...)`` with ``a`` (as sent) and ``b`` (as rendered); missing side columns are null."""
    missing = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ", 1) for c in _SIDE.split(", ")) if name not in pairs.columns]
    return pairs.select("*", *missing, extract_surface("raw_html", "url").alias("a"), extract_surface("rendered_html", "url").alias("b"))


def _text(c: Column | str | int) -> Column:
    return c.cast("string") if isinstance(c, Column) else F.lit(str(c))


def _diff(when: Column, aspect: str, severity: Column | str, confidence: str, title: Column | str, raw: Column | int, rendered: Column | int, evidence: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(F.lit(aspect).alias("aspect"), lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), lit(title).alias("title"),
                                 _text(raw).alias("raw"), _text(rendered).alias("rendered"), F.slice(F.filter(evidence, lambda e: e.isNotNull()), 1, EVIDENCE).alias("evidence")))


def _only(prefix: str, values: Column, most: int = EVIDENCE) -> Column:
    return F.transform(F.slice(values, 1, most), lambda v: F.concat(F.lit(prefix), v))


def _listed(prefix: str, values: Column) -> Column:
    return F.array(F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(values, ", "))))


def _sample(prefix: str, values: Column) -> Column:
    """The first three in one line, and how many more."""
    more = F.when(F.size(values) > 3, F.concat(F.lit(" (+"), (F.size(values) - 3).cast("string"), F.lit(" more)"))).otherwise("")
    return F.array(F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(values, 1, 3), ", "), more)))


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _tags(aspect: str, title: str, prefix: str, a: Column, b: Column, keys: tuple[str, ...]) -> Column:
    """Keyed tags: gone, come and changed."""
    all_keys = F.array(*map(F.lit, keys))
    has = lambda m, k: F.coalesce(m[k], F.lit("")) != ""
    gone, come = F.filter(all_keys, lambda k: has(a, k) & ~has(b, k)), F.filter(all_keys, lambda k: ~has(a, k) & has(b, k))
    changed = F.filter(all_keys, lambda k: has(a, k) & has(b, k) & (a[k] != b[k]))
    say = lambda before, after: lambda k: F.concat(F.lit(before), k, F.lit(after))
    evidence = F.concat(
        F.transform(gone, say(f"Raw {prefix}:", " present, missing in rendered")), F.transform(come, say(f"Rendered {prefix}:", " present, missing in raw")),
        F.transform(changed, lambda k: F.concat(F.lit(f"{prefix}:"), k, F.lit(' changed: "'), a[k], F.lit('" → "'), b[k], F.lit('"'))),
    )
    shown = lambda m: F.array_join(F.filter(all_keys, lambda k: has(m, k)), ", ")
    return _diff(F.size(evidence) > 0, aspect, F.when(F.size(come) > 0, "medium").otherwise("low"), "certain", title, shown(a), shown(b), evidence)


def differences() -> Column:
    """Array of all differences of ``a`` and ``b``, in order of report."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    none = lambda c: F.coalesce(c, F.lit("(missing)"))
    pair = lambda x, y, left, right: F.array(F.concat(F.lit(left), x), F.concat(F.lit(right), y))
    out = []

    came, went = a("canonical").isNull() & b("canonical").isNotNull(), a("canonical").isNotNull() & b("canonical").isNull()
    out.append(_diff(~a("canonical").eqNullSafe(b("canonical")), "indexability.canonical", F.when(came, "critical").otherwise("high"), "certain",
                     F.when(came, "Canonical injected by JavaScript").when(went, "Canonical removed by JavaScript").otherwise("Canonical changed by JavaScript"),
                     none(a("canonical")), none(b("canonical")), pair(none(a("canonical")), none(b("canonical")), "Raw: ", "Rendered: ")))

    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    raw_no, shown_no, header_no = low(a("robots")).contains("noindex"), low(b("robots")).contains("noindex"), low(F.col("x_robots")).contains("noindex")
    robots = pair(none(a("robots")), none(b("robots")), "Raw meta robots: ", "Rendered meta robots: ")
    out.append(_diff(low(a("robots")) != low(b("robots")), "indexability.metaRobots", F.when(~raw_no & shown_no, "critical").when(raw_no & ~shown_no, "high").otherwise("medium"), "certain",
                     F.when(~raw_no & shown_no, "noindex injected by JavaScript").when(raw_no & ~shown_no, "noindex removed by JavaScript").otherwise("Meta robots changed by JavaScript"),
                     none(a("robots")), none(b("robots")), robots))
    out.append(_diff((low(F.col("x_robots")) != "") & (header_no != shown_no), "indexability.xRobotsTag", F.when(header_no, "high").otherwise("critical"), "certain",
                     F.when(header_no, "X-Robots-Tag noindex conflicts with rendered meta robots").otherwise("Rendered noindex not backed by X-Robots-Tag"),
                     F.col("x_robots"), none(b("robots")), pair(F.col("x_robots"), none(b("robots")), "X-Robots-Tag: ", "Rendered meta robots: ")))

    most, least = F.greatest(a("words"), b("words")), F.least(a("words"), b("words"))
    share = (most - least) * 100.0 / most
    percent = F.floor(share + 0.5).cast("string")
    out.append(_diff(a("words") != b("words"), "content.wordCount", F.when(share > 50, "critical").when(share > 30, "high").when(share > 10, "medium").otherwise("low"), "certain",
                     F.concat(F.lit("Visible word count "), F.when(b("words") > a("words"), "increased").otherwise("decreased"), F.lit(" by "), percent, F.lit("%")), a("words"), b("words"),
                     F.concat(pair(_text(a("words")), _text(b("words")), "Raw words: ", "Rendered words: "), F.array(F.concat(F.lit("Delta: "), percent, F.lit("%"))))))
    out.append(_diff((b("words") > 100) & (a("words") < 30), "content.mainTextMissing", "critical", "certain", "Main content hydrated client-side", a("words"), b("words"),
                     pair(_text(a("words")), _text(b("words")), "Raw visible text, words: ", "Rendered visible text, words: ")))

    for name, aspect, title in (("title", "metadata.title", "Title changed by JavaScript"), ("description", "metadata.metaDescription", "Meta description changed by JavaScript")):
        x, y = _plain(a(name)), _plain(b(name))
        said = lambda c: F.when(c == "", "(missing)").otherwise(c)
        out.append(_diff(x != y, aspect, "high", "certain", title, said(x), said(y), pair(said(x), said(y), "Raw: ", "Rendered: ")))
    out.append(_tags("metadata.openGraph", "Open Graph tags differ between raw and rendered", "og", a("og"), b("og"), OG_KEYS))
    out.append(_tags("metadata.twitter", "Twitter Card tags differ between raw and rendered", "twitter", a("twitter"), b("twitter"), TWITTER_KEYS))

    for name, aspect, title, worse, better in (("h1", "headings.h1", "H1 heading differs between raw and rendered", "high", "medium"), ("headings", "headings.set", "Heading structure differs between raw and rendered", "medium", "low")):
        gone, come = F.array_except(a(name), b(name)), F.array_except(b(name), a(name))
        say = _listed if name == "h1" else _sample
        out.append(_diff((F.size(gone) > 0) | (F.size(come) > 0), aspect, F.when(F.size(come) > 0, worse).otherwise(better), "certain", title,
                         F.array_join(a(name), ", "), F.array_join(b(name), ", "), F.concat(say("Only in raw: ", gone), say("Only in rendered: ", come))))

    total = lambda s: F.size(s("internal")) + F.size(s("external"))
    gone, come = F.array_except(a("internal"), b("internal")), F.array_except(b("internal"), a("internal"))
    out.append(_diff(total(a) != total(b), "links.internal", "medium", "certain", "Link count changed between raw and rendered", total(a), total(b), pair(_text(total(a)), _text(total(b)), "Raw total links: ", "Rendered total links: ")))
    out.append(_diff(F.size(come) > 0, "links.onlyInRendered", "medium", "likely", "Internal links only present in rendered DOM", total(a), total(b), _only("Only in rendered: ", come)))
    out.append(_diff(F.size(gone) > 0, "links.internal", "low", "cosmetic", "Internal links removed in rendered DOM", total(a), total(b), _only("Only in raw: ", gone)))
    gone, come = F.array_except(a("external"), b("external")), F.array_except(b("external"), a("external"))
    out.append(_diff((F.size(gone) > 0) | (F.size(come) > 0), "links.external", "low", "cosmetic", "External links differ between raw and rendered", F.size(a("external")), F.size(b("external")),
                     F.concat(_only("Only in rendered: ", come, 3), _only("Only in raw: ", gone, 3))))

    src = lambda images: F.transform(images, lambda i: i["src"])
    gone, come = F.array_except(src(a("images")), src(b("images"))), F.array_except(src(b("images")), src(a("images")))
    lazy = lambda s: F.filter(s("images"), lambda i: i["lazy"])
    mute = lambda s: F.filter(s("images"), lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) == "")
    n = lambda s: F.size(s("images"))
    out.append(_diff(F.size(come) > 0, "images.src", "medium", "likely", "Images only present in rendered DOM", n(a), n(b), _only("Only in rendered: ", come)))
    out.append(_diff(F.size(lazy(b)) > 0, "images.src", "low", "likely", "Lazy-loaded images detected", F.size(lazy(a)), F.size(lazy(b)), _only("Lazy: ", src(lazy(b)))))
    out.append(_diff(F.size(mute(b)) > F.size(mute(a)), "images.alt", "medium", "certain", "Missing alt text increased in rendered DOM", F.size(mute(a)), F.size(mute(b)), _only("Missing alt: ", src(mute(b)))))
    out.append(_diff(F.size(gone) > 0, "images.src", "low", "cosmetic", "Images removed in rendered DOM", n(a), n(b), _only("Only in raw: ", gone)))

    gone, come = F.array_except(a("types"), b("types")), F.array_except(b("types"), a("types"))
    out.append(_diff((F.size(gone) > 0) | (F.size(come) > 0) | (a("n_json_ld") != b("n_json_ld")), "structuredData.jsonLd", F.when(F.size(come) > 0, "high").otherwise("medium"), "certain",
                     "JSON-LD structured data differs between raw and rendered", F.array_join(a("types"), ", "), F.array_join(b("types"), ", "),
                     F.concat(pair(_text(a("n_json_ld")), _text(b("n_json_ld")), "Raw JSON-LD blocks: ", "Rendered JSON-LD blocks: "), _listed("Types only in rendered: ", come), _listed("Types only in raw: ", gone))))

    gone, come = F.array_except(a("hreflang"), b("hreflang")), F.array_except(b("hreflang"), a("hreflang"))
    counts = pair(_text(F.size(a("hreflang"))), _text(F.size(b("hreflang"))), "Raw hreflang count: ", "Rendered hreflang count: ")
    out.append(_diff((F.size(gone) > 0) | (F.size(come) > 0), "hreflang", F.when(F.size(come) > 0, "high").otherwise("medium"), "certain", "Hreflang annotations differ between raw and rendered",
                     F.array_join(a("hreflang"), ", "), F.array_join(b("hreflang"), ", "), F.concat(counts, _only("Only in rendered: ", come, 3), _only("Only in raw: ", gone, 3))))

    errors = F.filter(F.coalesce("messages", F.array().cast("array<struct<level:string,text:string>>")), lambda m: m["level"].isin("error", "severe"))
    out.append(_diff(F.size(errors) > 0, "jsErrors", "high", "certain", "JavaScript errors during rendering", 0, F.size(errors), F.transform(errors, lambda m: F.concat(F.lit("["), m["level"], F.lit("] "), m["text"]))))
    failed = F.filter(F.coalesce("failed", F.array().cast("array<struct<url:string,method:string,status:int,kind:string>>")), lambda r: r["kind"].isin("script", "xhr", "fetch"))
    out.append(_diff(F.size(failed) > 0, "jsErrors", "medium", "likely", "Critical resources failed to load", 0, F.size(failed), F.transform(failed, lambda r: F.concat(r["method"], F.lit(" "), r["url"], F.lit(" — HTTP "), F.coalesce(r["status"].cast("string"), F.lit("?"))))))
    blocked = F.coalesce("blocked", F.array().cast("array<struct<url:string,reason:string,impact:string>>"))
    worst = F.when(F.exists(blocked, lambda r: r["impact"] == "critical"), "critical").when(F.exists(blocked, lambda r: r["impact"] == "high"), "high").otherwise("medium")
    out.append(_diff(F.size(blocked) > 0, "resourceBlocked", worst, "certain", "Resources blocked during rendering", 0, F.size(blocked), F.transform(blocked, lambda r: F.concat(r["url"], F.lit(" ("), r["reason"], F.lit(")")))))

    found = F.filter(F.array(*out), lambda d: d.isNotNull())
    place = lambda values, c: F.array_position(F.array(*map(F.lit, values)), c)
    keyed = F.transform(found, lambda d: F.struct(place(SEVERITIES, d["severity"]).alias("s"), place(ASPECTS, d["aspect"]).alias("p"), F.lower(d["title"]).alias("t"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda k: k["d"])


def compared(pairs: DataFrame) -> DataFrame:
    """``pairs`` without html, with ``diffs``, both word and byte counts and the framework."""
    both = with_surfaces(pairs).withColumn("framework", framework_hint(F.concat_ws(" ", "raw_html", "rendered_html")))
    held = both.withColumn("diffs", F.when(F.monotonically_increasing_id() >= 0, differences()))
    kept = [c for c in pairs.columns if c not in ("raw_html", "rendered_html", *(s.split()[0] for s in _SIDE.split(", ")))]
    counts = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("a", "raw"), ("b", "rendered")) for c in ("words", "bytes")]
    return held.select(*kept, "framework", *counts, "diffs")


def scored(diffs: DataFrame) -> DataFrame:
    """Adds the five parts, ``overall``, counts by severity, how the page is rendered, and the advice, most pressing first."""
    count = lambda *conds: F.size(F.filter("diffs", lambda d: _all(c(d) for c in conds)))
    is_ = lambda field, *values: lambda d: d[field].isin(*values)
    index, crawl = is_("aspect", *ASPECTS[:3]), is_("aspect", "jsErrors", "resourceBlocked")
    off = lambda area, points: sum((count(area, is_("severity", s)) * p for s, p in points.items()), F.lit(0))
    most, least = F.greatest("raw_words", "rendered_words"), F.least("raw_words", "rendered_words")
    parts = {
        "indexability": F.when(count(index, is_("severity", "critical")) > 0, 0).otherwise(F.greatest(F.lit(0), 100 - off(index, OFF_INDEX))),
        "content": F.when(most > 0, F.floor(least / most * 100)).otherwise(100),
        "metadata": F.greatest(F.lit(0), 100 - F.floor(count(is_("aspect", *ASPECTS[5:9])) / 4 * 100)),
        "structured_data": F.when(count(is_("aspect", "structuredData.jsonLd")) > 0, 50).otherwise(100),
        "crawlability": F.greatest(F.lit(0), 100 - off(crawl, OFF_CRAWL)),
    }
    out = diffs.select("*", *(c.cast("int").alias(n) for n, c in parts.items()), *(count(is_("severity", s)).alias(f"n_{s}") for s in SEVERITIES))
    overall = F.floor(sum((F.col(n) * w for n, w in SHARES.items()), F.lit(0.0)) + 0.5)
    ratio = F.col("rendered_words") / F.greatest("raw_words", F.lit(1))
    strategy = F.when(ratio < 0.2, "csr").when(F.col("framework").isin("nextjs", "remix"), "hybrid").when(ratio > 0.9, "ssr").when(ratio > 0.7, "ssg").otherwise("unknown")
    aspects = F.transform("diffs", lambda d: d["aspect"])
    # Advice of one priority comes in the order of the differences that call for it.
    tips = [F.when(F.arrays_overlap(aspects, F.array(*map(F.lit, calls))), F.struct(F.lit(p).alias("p"), F.array_min(F.array(*(F.nullif(F.array_position(aspects, c), F.lit(0)) for c in calls))).alias("at"), F.lit(i).alias("i"), F.lit(t).alias("tip"))) for i, (t, p, calls) in enumerate(ADVICE)]
    advice = F.transform(F.array_sort(F.filter(F.array(*tips), lambda t: t.isNotNull())), lambda t: t["tip"])
    delta = F.when(F.col("raw_bytes") > 0, (F.col("rendered_bytes") - F.col("raw_bytes")) * 100.0 / F.col("raw_bytes")).otherwise(0.0)
    return out.select("*", overall.cast("int").alias("overall"), strategy.alias("strategy"), delta.alias("bytes_delta_pct"), advice.alias("advice"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def listed(diffs: DataFrame, *keys: str) -> DataFrame:
    """One row a difference, with its place in the report."""
    return diffs.select(*keys, F.posexplode("diffs").alias("place", "d")).select(*keys, "place", "d.*")
