"""The one HTML pass: an Arrow-batched UDF that reads a page once and returns every DOM-level fact, and URL resolution."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.slices import slices

#: Elements without content, elements whose text is raw, default ports, link prefixes that are no pages.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style"}
PORTS = {"http": "80", "https": "443", "ftp": "21"}
NO_PAGE = ("#", "javascript:", "mailto:", "tel:")

SCHEMA = """title string, description string, robots string, viewport string, canonical string, h1 array<string>, h2 array<string>, h3 array<string>,
links array<struct<url:string,text:string,is_internal:boolean>>, images array<struct<src:string,alt:string>>, hreflang array<struct<lang:string,url:string>>,
open_graph map<string,string>, twitter map<string,string>, json_ld array<string>, levels array<int>, text string"""


def resolve(href: str | None, base: str) -> str | None:
    """Absolute form of a reference: lower-case scheme and host, no default port, a path, percent-encoded; None if it can't be read."""
    try:
        parts = urlsplit(urljoin(base, (href or "").strip()))
        if not parts.scheme:
            return None
        host = (parts.hostname or "").encode("idna").decode() if parts.hostname and not parts.hostname.isascii() else parts.hostname or ""
        if parts.port and str(parts.port) != PORTS.get(parts.scheme):
            host += f":{parts.port}"
        safe = "/%:@!$&'()*+,;=-._~"
        path = quote(parts.path, safe=safe) or ("/" if host else "")
        return urlunsplit((parts.scheme, host, path, quote(parts.query, safe=safe + "?[]|^`{}"), quote(parts.fragment, safe=safe + "?")))
    except ValueError:
        return None


class _Page(HTMLParser):
    """Collects facts in document order; unclosed elements end with their page."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.host = base, urlsplit(base).hostname
        self.title: list[str] | None = None
        self.meta: dict[str, str] = {}
        self.og: dict[str, str] = {}
        self.twitter: dict[str, str] = {}
        self.canonical: str | None = None
        self.headings: list[tuple[int, list[str]]] = []
        self.links: list[tuple[str, list[str]]] = []
        self.images: list[tuple[str, str | None]] = []
        self.hreflang: list[tuple[str, str]] = []
        self.json_ld: list[list[str]] = []
        self.text: list[str] = []
        self.sinks: list[tuple[str, list[str]]] = []  # open elements whose text is wanted
        self.raw = ""

    def _open(self, tag: str, parts: list[str]) -> list[str]:
        self.sinks.append((tag, parts))
        return parts

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        rel = a.get("rel", "").lower().split()
        if tag == "title" and self.title is None:
            self.title = self._open(tag, [])
        elif tag == "meta":
            content = a.get("content", "").strip()
            if name := a.get("name", "").lower():
                self.meta.setdefault(name, content)
            for kind, found in (("og:", self.og), ("twitter:", self.twitter)):
                for key in (a.get("property", ""), a.get("name", "")):
                    if key.startswith(kind) and content:
                        found[key[len(kind) :]] = content
        elif tag == "link":
            url = resolve(a.get("href"), self.base)
            if "canonical" in rel and self.canonical is None and a.get("href"):
                self.canonical = url
            if "alternate" in rel and a.get("hreflang") and url:
                self.hreflang.append((a["hreflang"], url))
        elif re.fullmatch("h[1-6]", tag):
            self.headings.append((int(tag[1]), self._open(tag, [])))
        elif tag == "a" and "href" in a and not a["href"].strip().lower().startswith(NO_PAGE):
            if url := resolve(a["href"], self.base):
                self.links.append((url, self._open(tag, [])))
        elif tag == "img" and a.get("src"):
            self.images.append((resolve(a["src"], self.base), a["alt"].strip() if "alt" in a else None))
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.json_ld.append(self._open(tag, []))
        if tag in RAW:
            self.raw = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in RAW:
            self.raw = ""
        for i in range(len(self.sinks) - 1, -1, -1):
            if self.sinks[i][0] == tag:
                del self.sinks[i]
                break

    def handle_data(self, data: str) -> None:
        for tag, parts in self.sinks:
            if not self.raw or tag in RAW:
                parts.append(data)
        if not self.raw and not (self.sinks and self.sinks[-1][0] == "title"):
            self.text.append(data)


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def read_page(html: str | None, url: str | None) -> dict:
    """All facts of one page; a null page has none."""
    p = _Page(url or "")
    p.feed(html or "")
    p.close()
    by_level = lambda n: [t for k, x in p.headings if k == n and (t := _squeezed(x))]
    return {
        "title": (_squeezed(p.title) or None) if p.title is not None else None,
        "description": p.meta.get("description") or None, "robots": p.meta.get("robots") or None, "viewport": p.meta.get("viewport") or None,
        "canonical": p.canonical, "h1": by_level(1), "h2": by_level(2), "h3": by_level(3),
        "links": [{"url": u, "text": _squeezed(t) or "[Empty Link Text]", "is_internal": urlsplit(u).hostname == p.host} for u, t in p.links],
        "images": [{"src": s, "alt": alt} for s, alt in p.images], "hreflang": [{"lang": k, "url": u} for k, u in p.hreflang],
        "open_graph": p.og, "twitter": p.twitter, "json_ld": ["".join(x).strip() for x in p.json_ld], "levels": [k for k, _ in p.headings],
        "text": _squeezed(p.text),
    }


def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for html, url in slices(batches):
        yield pd.DataFrame([read_page(h, u) for h, u in zip(html, url)])


def _resolve(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(h, b or "") for h, b in zip(href, base)])


def extract_page(html: str | Column, url: str | Column) -> Column:
    """Struct of all facts of a page (SCHEMA)."""
    return F.pandas_udf(_extract, SCHEMA)(html, url)


def resolve_url(href: str | Column, base: str | Column) -> Column:
    return F.pandas_udf(_resolve, "string")(href, base)


def schema_items(raw: str) -> list[dict]:
    """Entities of one JSON-LD block: the items of a list or graph, or the one object; unreadable text gives an error item."""
    try:
        data = json.loads(raw)
    except ValueError:
        return [{"__error": True, "raw": raw}]
    data = data if isinstance(data, list) else data.get("@graph", [data]) if isinstance(data, dict) else []
    return [x for x in data if isinstance(x, dict)]
