"""Scalar expressions over columns: ids, dates, shingle signatures, schema and header helpers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base and modulus of the signature's two hashes, its prime and its length.
HASH_BASES, WORD32, PRIME, SLOTS = (31, 37), 4294967296, 2147483647, 64
#: Framework markers, the more specific first.
FRAMEWORKS = (
    ("nextjs", r"__NEXT_DATA__|_next/static"), ("nuxtjs", r"__NUXT__|_nuxt/"), ("sveltekit", "__sveltekit_"), ("gatsby", "___gatsby|gatsby-plugin"),
    ("remix", "__remix|remix-run"), ("angular", "<app-root|<ng-"), ("react", r'<div[^>]*id="(root|__next)"|<script[^>]*src=".*react'),
    ("vue", r'<div[^>]*id="app"|<script[^>]*src=".*vue'),
)
#: Names of files that hold a hash of their content.
HASHED_NAME = r"(?i)\.[a-f0-9]{8,32}\.|-[a-f0-9]{8,32}\.|/[a-f0-9]{20,40}/"


def _text(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(x: Column, digits: int = 0) -> Column:
    """Half away from minus infinity, as numbers are rounded in scripts."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def finding_id(rule: Column, url: Column, details: Column) -> Column:
    """Rule, the first sixteen characters of the URL's base64 form and, with details, their 32-bit hash in base 36."""
    safe = F.translate(F.base64(url.cast("binary")), "+/=", "-_")
    steps = F.transform(F.split(details, ""), lambda c: F.ascii(c).cast("bigint"))
    unsigned = F.aggregate(steps, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(WORD32 - 1)))
    signed = F.when(unsigned >= WORD32 // 2, F.lit(WORD32) - unsigned).otherwise(unsigned)
    suffix = F.when(F.coalesce(details, F.lit("")) != "", F.concat(F.lit(":"), F.lower(F.conv(signed.cast("string"), 10, 36)))).otherwise("")
    return F.concat(rule, F.lit(":"), F.substring(safe, 1, 16), suffix)


def diff_id(aspect: Column, url: Column, payload: Column) -> Column:
    """First sixteen hex digits of the SHA-256 of the three as a JSON object; payload is JSON text."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    data = F.concat(F.lit('{"aspect":'), quoted(aspect), F.lit(',"url":'), quoted(url), F.lit(',"payload":'), payload, F.lit("}"))
    return F.substring(F.sha2(data, 256), 1, 16)


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct shingles of k words of three letters and more, lower-cased; an array to hold in a column of its own."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2)
    return F.when(F.size(words) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def _mixed(shingle: Column, base: int) -> Column:
    return F.aggregate(F.transform(F.split(shingle, ""), lambda c: F.ascii(c).cast("bigint")), F.lit(0).cast("bigint"), lambda h, c: (h * base + c) % WORD32)


def min_hash(hashes: Column, slots: int = SLOTS) -> Column:
    """Signature of an array of structs (a, b), see ``hashed``: the least combination of every slot; empty sets have none."""
    one = lambda i: F.array_min(F.transform(hashes, lambda h: (h["a"] + i * h["b"]) % WORD32 % PRIME))
    return F.when(F.size(hashes) > 0, F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), one))


def hashed(shingles_: Column) -> Column:
    """Both hashes of every shingle, from which all slots follow."""
    return F.transform(shingles_, lambda s: F.struct(_mixed(s, HASH_BASES[0]).alias("a"), _mixed(s, HASH_BASES[1]).alias("b")))


def estimated_likeness(a: Column, b: Column) -> Column:
    """Share of equal slots of two signatures of one length, else 0."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: e))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), equal / F.size(a)).otherwise(0.0)


def parse_date(text: Column) -> Column:
    """ISO dates, ``/Date(ms)/`` and the dates of access logs; anything else is null."""
    ms = F.regexp_extract(text, r"^/Date\((-?\d+)", 1)
    log = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})$", 1), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.coalesce(F.when(ms != "", F.timestamp_millis(ms.cast("bigint"))), log, F.try_to_timestamp(text))


def cache_facts(header: Column, src: Column) -> Column:
    """max_age, no_cache, immutable and hashed_name of a response's cache header and its file name."""
    age = F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)max-age\s*=\s*(\d+)", 1)
    return F.struct(
        F.when(age != "", age.cast("bigint")).otherwise(0).alias("max_age"), F.coalesce(header, F.lit("")).rlike("(?i)no-cache|no-store|private").alias("no_cache"),
        F.coalesce(header, F.lit("")).contains("immutable").alias("immutable"), src.rlike(HASHED_NAME).alias("hashed_name"),
    )


def srcset_urls(srcset: Column) -> Column:
    """URL of every candidate of a srcset."""
    parts = F.transform(F.split(srcset, ","), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.substring_index(p, " ", 1))


def style_urls(style: Column) -> Column:
    """URLs of backgrounds in an inline style, without data URLs."""
    return F.filter(F.regexp_extract_all(style, F.lit(r"""(?i)url\s*\(\s*['"]?([^'")]+)['"]?\s*\)"""), 1), lambda u: ~u.startswith("data:"))


def internal_link_density(internal: Column, words: Column) -> Column:
    """Internal links a hundred words."""
    return F.when(words > 0, internal * 100.0 / words).otherwise(0.0)


def _slug(url: Column) -> Column:
    last = F.element_at(F.filter(F.split(url, "/"), lambda p: p != ""), -1)
    return F.regexp_replace(F.regexp_replace(F.coalesce(last, F.lit("")), r"\.[^.]+$", ""), "[-_]", " ")


def anchor_theme(url: Column, title: Column) -> Column:
    """The first four words of the title, else the URL's last part in words, else a phrase."""
    clean = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\w\s-]", ""))
    theme = F.array_join(F.slice(F.split(clean, r"\s+"), 1, 4), " ")
    return F.when(theme != "", theme).when(_slug(url) != "", _slug(url)).otherwise("Learn more")


def anchor_text(url: Column, title: Column) -> Column:
    """A title of under 80 characters, else the URL's last part capitalised; null if neither will do."""
    slug, n = _slug(url), F.length(F.coalesce(title, F.lit("")))
    return F.when((n > 0) & (n < 80), F.trim(title)).when((F.length(slug) > 0) & (F.length(slug) < 60), F.concat(F.upper(F.substring(slug, 1, 1)), F.substring(slug, 2, 60)))


def phone_digits(phone: Column) -> Column:
    """The last ten digits."""
    return F.right(F.regexp_replace(phone, r"\D", ""), F.lit(10))


def normal_keyword(keyword: Column) -> Column:
    """Lower case, letters and digits of any script only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(keyword), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def topic_key(key: Column) -> Column:
    """Words in the singular: -ies becomes -y, a plain final s goes."""
    ies, plain = lambda t: t.endswith("ies") & (F.length(t) > 4), lambda t: t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3)
    one = lambda t: F.when(ies(t), F.regexp_replace(t, "ies$", "y")).when(plain(t), F.regexp_replace(t, "s$", "")).otherwise(t)
    return F.trim(F.array_join(F.transform(F.split(key, r"\s+"), one), " "))


def topic_label(key: Column) -> Column:
    """Every word with a capital first letter, the rest as it is."""
    return F.array_join(F.transform(F.split(key, r"\s+"), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))), " ")


def lower_headers(headers: Column) -> Column:
    """A header map with lower-case names."""
    return F.transform_keys(headers, lambda k, _: F.lower(k))


def same_json(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold the same value, whatever the order of keys."""
    return F.to_json(F.try_parse_json(a)).eqNullSafe(F.to_json(F.try_parse_json(b)))


def escape_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def framework_hint(html: str | Column) -> Column:
    """The first framework whose marker is in the html, else null."""
    out = None
    for name, marker in FRAMEWORKS:
        hit = _text(html).rlike(marker)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
