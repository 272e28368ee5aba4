"""Technologies of a page from markers in its html, URLs, scripts and headers.

All needles of all technologies are one automaton that runs once over each
channel; what it finds are numbers of signals. Weights, thresholds,
suppression and the way of rendering are expressions over these numbers in the
page's row, so nothing is shuffled and no page is crossed with the signatures.

Defined results: a null html shows no markers; a null url leaves hosts of
relative assets empty; repeated rows give repeated results; technologies of one
confidence are listed by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.markers import found_markers

LEAST, MOST, HIGH = 55, 95, 80
ENOUGH_TEXT = 200

#: Technology, category, least confidence, what it suppresses, and its signals (channel, needles, weight). A needle of "" stands for any value.
TECHNOLOGIES = (
    ("Next.js", "frontendFramework", 55, "React", (("html", ("__next_data__",), 60), ("asset", ("/_next/static/", "/_next/image"), 45), ("header:x-powered-by", ("next.js",), 55), ("html", ("self.__next_f.push",), 45))),
    ("Nuxt", "frontendFramework", 55, "Vue", (("html", ("__nuxt__",), 60), ("html", ('id="__nuxt"',), 40), ("asset", ("/_nuxt/",), 45))),
    ("Astro", "frontendFramework", 55, "", (("html", ("astro-island",), 60), ("asset", ("/_astro/",), 35))),
    ("React", "frontendFramework", 60, "", (("html", ("data-reactroot",), 60), ("html", ("react-dom",), 35))),
    ("Vue", "frontendFramework", 60, "", (("html", ("data-v-app",), 60), ("regex", (r"\b__vue(?:ParentComponent|App)?\b",), 45), ("inline", ("createApp(", "createSSRApp("), 35))),
    ("WordPress", "cms", 55, "", (("asset", ("/wp-content/", "/wp-includes/"), 45), ("generator", ("wordpress",), 55), ("html", ("wp-emoji-release.min.js",), 35))),
    ("Webflow", "cms", 55, "", (("asset", ("webflow.js",), 55), ("attribute", (" data-wf-page ",), 45), ("attribute", (" data-wf-site ",), 40))),
    ("Shopify", "cms", 55, "", (("asset", ("cdn.shopify.com", "shopifycdn.net"), 45), ("html", ("shopify.theme",), 55), ("html", ("shopify-section",), 35))),
    ("Drupal", "cms", 55, "", (("generator", ("drupal",), 55), ("asset", ("/sites/default/files/", "/core/assets/"), 40), ("regex", (r"\bDrupal\s*=\s*\{",), 35))),
    ("Wix", "cms", 55, "", (("generator", ("wix",), 55), ("asset", ("wixstatic.com", "static.parastorage.com"), 40), ("html", ("wix-code-sdk",), 35))),
    ("HubSpot CMS", "cms", 55, "", (("asset", ("js.hs-scripts.com", "js.hsforms.net", "hubspotusercontent"), 45), ("generator", ("hubspot",), 55), ("html", ("hs-script-loader",), 35))),
    ("Contentful", "cms", 55, "", (("asset", ("ctfassets.net", "cdn.contentful.com"), 70),)),
    ("Sanity", "cms", 55, "", (("asset", ("cdn.sanity.io",), 70),)),
    ("Prismic", "cms", 55, "", (("asset", ("prismic.io", "prismicusercontent.com"), 70), ("html", ("prismic-toolbar",), 35))),
    ("Cloudflare", "cdn", 55, "", (("header:cf-ray", ("",), 55), ("header:server", ("cloudflare",), 45), ("asset", ("/cdn-cgi/",), 35))),
    ("Vercel", "hosting", 55, "", (("header:x-vercel-id", ("",), 55), ("header:x-vercel-cache", ("",), 40), ("header:server", ("vercel",), 45))),
    ("Netlify", "hosting", 55, "", (("header:x-nf-request-id", ("",), 55), ("header:server", ("netlify",), 45))),
    ("Amazon CloudFront", "cdn", 55, "", (("header:x-amz-cf-id", ("",), 55), ("header:server", ("cloudfront",), 45))),
    ("Fastly", "cdn", 55, "", (("header:x-fastly-request-id", ("",), 55), ("header:x-served-by", ("cache-",), 35))),
    ("Akamai", "cdn", 55, "", (("header:x-akamai-transformed", ("",), 55), ("header:server-timing", ("cdn-cache",), 20))),
    ("PHP", "backend", 55, "", (("header:x-powered-by", ("php",), 65),)),
    ("Express", "backend", 55, "", (("header:x-powered-by", ("express",), 70),)),
    ("ASP.NET", "backend", 55, "", (("header:x-powered-by", ("asp.net",), 65), ("header:x-aspnet-version", ("",), 55))),
    ("nginx", "backend", 55, "", (("header:server", ("nginx",), 70),)),
    ("Apache", "backend", 55, "", (("header:server", ("apache",), 70),)),
    ("OpenResty", "backend", 55, "", (("header:server", ("openresty",), 70),)),
    ("Caddy", "backend", 55, "", (("header:server", ("caddy",), 70),)),
    ("Google Tag Manager", "analytics", 55, "", (("script", ("googletagmanager.com/gtm.js",), 75), ("inline", ("gtm.start", "googletagmanager.com/gtm.js"), 30))),
    ("Google Analytics", "analytics", 55, "", (("script", ("googletagmanager.com/gtag/js", "google-analytics.com"), 75), ("inline", ("gtag(", "ga("), 25))),
    ("Microsoft Clarity", "analytics", 55, "", (("script", ("clarity.ms",), 75), ("inline", ("clarity(",), 25))),
    ("Meta Pixel", "analytics", 55, "", (("script", ("connect.facebook.net", "fbevents.js"), 75), ("inline", ("fbq(",), 25))),
    ("Hotjar", "analytics", 55, "", (("asset", ("hotjar.com", "static.hotjar.com"), 75), ("inline", ("hjSettings", "hotjar("), 25))),
    ("Segment", "analytics", 55, "", (("asset", ("cdn.segment.com", "analytics.next-integrations.com"), 75), ("inline", ("analytics.load(",), 25))),
    ("Plausible", "analytics", 55, "", (("script", ("plausible.io/js/script",), 80),)),
    ("Matomo", "analytics", 55, "", (("asset", ("matomo.js", "piwik.js"), 75), ("inline", ("_paq.push",), 25))),
    ("LinkedIn Insight Tag", "analytics", 55, "", (("script", ("snap.licdn.com/li.lms-analytics/insight.min.js",), 80),)),
    ("Tailwind CSS", "uiLibraries", 55, "", (("html", ("--tw-",), 45), ("regex", (r"\b(?:sm:|md:|lg:|xl:|2xl:|dark:|prose|line-clamp-)\S*",), 20), ("asset", ("tailwind", "tailwindcss"), 60))),
    ("Bootstrap", "uiLibraries", 55, "", (("asset", ("bootstrap.min.css", "bootstrap.min.js", "/bootstrap.css", "/bootstrap.js"), 75), ("regex", (r"\bbtn-(?:primary|secondary|outline)|\bcontainer-fluid\b|\bnavbar\b",), 20))),
    ("Material UI", "uiLibraries", 55, "Emotion", (("regex", (r"\bMui[A-Z][A-Za-z-]+-root\b",), 40), ("html", ('data-emotion="mui',), 45))),
    ("Styled Components", "uiLibraries", 55, "", (("html", ("data-styled",), 75),)),
    ("Emotion", "uiLibraries", 60, "", (("html", ("data-emotion=",), 70),)),
    ("Chakra UI", "uiLibraries", 55, "", (("regex", (r"\bchakra-[\w-]+\b",), 35), ("html", ("chakra-ui",), 35))),
    ("Webpack", "buildTools", 55, "", (("regex", (r"\b__webpack_require__\b|\bwebpackJsonp\b|\bwebpackChunk(?:_N_E)?\b",), 80),)),
    ("Vite", "buildTools", 55, "", (("asset", ("/@vite/client",), 80), ("html", ("__vite__",), 70))),
    ("Parcel", "buildTools", 55, "", (("html", ("parcelrequire",), 80),)),
    ("Google Fonts", "fonts", 55, "", (("link", ("fonts.googleapis.com",), 75), ("asset", ("fonts.gstatic.com",), 25))),
    ("Adobe Fonts", "fonts", 55, "", (("asset", ("use.typekit.net", "p.typekit.net"), 80),)),
    ("Bunny Fonts", "fonts", 55, "", (("asset", ("fonts.bunny.net",), 80),)),
    ("Font Awesome", "fonts", 55, "", (("asset", ("fontawesome.com", "fontawesome", "use.fontawesome.com", "kit.fontawesome.com"), 75),)),
    ("Cloudinary", "fonts", 55, "", (("asset", ("res.cloudinary.com",), 80),)),
    ("Imgix", "fonts", 55, "", (("host", (".imgix.net$", "\nimgix.net$"), 80),)),
    ("ImageKit", "fonts", 55, "", (("host", ("imagekit.io",), 80),)),
    ("jsDelivr", "fonts", 55, "", (("asset", ("cdn.jsdelivr.net",), 75),)),
    ("UNPKG", "fonts", 55, "", (("asset", ("unpkg.com",), 75),)),
    ("Stripe", "thirdPartyServices", 55, "", (("asset", ("js.stripe.com",), 80),)),
    ("reCAPTCHA", "thirdPartyServices", 55, "", (("asset", ("google.com/recaptcha", "gstatic.com/recaptcha"), 80),)),
    ("Intercom", "thirdPartyServices", 55, "", (("asset", ("widget.intercom.io", "js.intercomcdn.com"), 80),)),
    ("Zendesk", "thirdPartyServices", 55, "", (("asset", ("static.zdassets.com", "zopim.com"), 80),)),
    ("HubSpot Forms / Chat", "thirdPartyServices", 55, "", (("asset", ("js.hsforms.net", "js.usemessages.com", "js.hs-banner.com"), 75),)),
    ("Calendly", "thirdPartyServices", 55, "", (("asset", ("assets.calendly.com",), 80),)),
    ("YouTube", "thirdPartyServices", 55, "", (("asset", ("youtube.com/embed", "youtube-nocookie.com/embed", "i.ytimg.com"), 75),)),
    ("Vimeo", "thirdPartyServices", 55, "", (("asset", ("player.vimeo.com",), 75),)),
)
#: Frameworks that render on both sides, servers and languages that render pages, and what renders in the browser.
HYBRID, SERVERS, CLIENT = ("Next.js", "Nuxt", "Astro"), ("PHP", "ASP.NET", "nginx", "Apache", "OpenResty", "Caddy"), ("React", "Vue")

SIGNALS = [(channel, needles, weight, t) for t, row in enumerate(TECHNOLOGIES) for channel, needles, weight in row[4]]


def _found(signals: Column) -> Column:
    """Array of the technologies that reach their least confidence and are not suppressed."""
    out, reached = [], {}
    for t, (name, _, least, _, _) in enumerate(TECHNOLOGIES):
        own = [(i, s) for i, s in enumerate(SIGNALS) if s[3] == t]
        score = sum((F.when(F.array_contains(signals, i), s[2]).otherwise(0) for i, s in own), F.lit(0))
        reached[name] = (F.least(score, F.lit(MOST)), score >= least, own)
    for name, category, _, _, _ in TECHNOLOGIES:
        score, enough, own = reached[name]
        for other, _, _, suppresses, _ in TECHNOLOGIES:
            if suppresses == name:
                enough = enough & ~reached[other][1]
        evidence = F.array(*(F.when(F.array_contains(signals, i), f"{s[0]}: {' | '.join(s[1]) or 'present'}") for i, s in own))
        level = F.when(score >= HIGH, "high").otherwise("medium")
        out.append(F.when(enough, F.struct(F.lit(category).alias("category"), (-score).alias("order"), F.lower(F.lit(name)).alias("key"), F.lit(name).alias("name"), score.alias("confidence"), level.alias("level"), F.filter(evidence, lambda e: e.isNotNull()).alias("evidence"))))
    return F.filter(F.array(*out), lambda t: t.isNotNull())


def _strategy(found: Column, length: Column) -> Column:
    """How the page is rendered, from what it is built with and how much text it brings; null if nothing tells."""
    names = F.transform(found, lambda t: t["name"])
    any_of = lambda known: F.arrays_overlap(names, F.array(*map(F.lit, known)))
    full = length >= ENOUGH_TEXT
    cms = F.exists(found, lambda t: t["category"] == "cms")
    kind = lambda name, confidence: F.struct(F.lit("renderingStrategy").alias("category"), F.lit(name).alias("name"), confidence.alias("confidence"))
    pick = lambda much, little: F.when(full, much).otherwise(little)
    return (
        F.when(any_of(HYBRID), kind("Hybrid / SSR / SSG", pick(90, 80)))
        .when(cms | any_of(SERVERS), kind("Server-rendered HTML", pick(85, 70)))
        .when(any_of(CLIENT) & ~full, kind("Likely client-rendered shell", F.lit(70)))
        .when(any_of(CLIENT), kind("Client framework with pre-rendered HTML", F.lit(65)))
    )


def detected(pages: DataFrame) -> DataFrame:
    """``pages(url, html[, headers map][, added], ...)`` without html, headers and added, with ``technologies`` (by category, then confidence), ``strategy`` and ``has_backend``.

    ``added``: markup put behind the page, which is searched too; how much text a page brings is told from the page alone.
    """
    headers = F.col("headers") if "headers" in pages.columns else F.lit(None).cast("map<string,string>")
    added = F.col("added") if "added" in pages.columns else F.lit(None).cast("string")
    kept = [c for c in pages.columns if c not in ("html", "headers", "added")]
    marked = pages.select(*kept, found_markers([s[:2] for s in SIGNALS], "html", "url", headers, added).alias("m"))
    held = marked.withColumn("found", F.when(F.monotonically_increasing_id() >= 0, _found(F.col("m.signals"))))
    ordered = F.transform(F.array_sort("found"), lambda t: t.dropFields("order", "key"))
    return held.select(*kept, ordered.alias("technologies"), _strategy(F.col("found"), F.col("m.length")).alias("strategy"), F.exists("found", lambda t: t["category"] == "backend").alias("has_backend"))


def listed(pages: DataFrame, *keys: str) -> DataFrame:
    """One row a technology, the way of rendering included."""
    out = detected(pages)
    level = F.when(F.col("strategy.confidence") >= HIGH, "high").otherwise("medium")
    one = F.array(F.struct("strategy.category", "strategy.name", "strategy.confidence", level.alias("level"), F.array().cast("array<string>").alias("evidence")))
    every = F.when(F.col("strategy").isNotNull(), F.concat("technologies", one)).otherwise(F.col("technologies"))
    return out.select(*keys, F.explode(every).alias("t")).select(*keys, "t.*")
