"""What one form of a page (as sent, or as rendered) shows: an Arrow-batched UDF over the one HTML pass."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.html import VOID, _Page, _squeezed, resolve
from sitegrain.functions.slices import slices

#: Elements, classes and roles whose text is no content.
BLOCKED_TAGS = {"nav", "footer", "header", "aside", "script", "style", "noscript"}
BLOCKED_CLASSES = {"menu", "nav", "footer", "header", "sidebar", "advertisement", "ad"}
BLOCKED_ROLES = {"navigation", "complementary", "contentinfo"}

SCHEMA = """title string, description string, robots string, canonical string, og map<string,string>, twitter map<string,string>,
h1 array<string>, headings array<string>, internal array<string>, external array<string>,
images array<struct<src:string,alt:string,lazy:boolean>>, types array<string>, n_json_ld int, hreflang array<string>, words int, bytes int"""

#: Words as people count them: letters and digits, joined by marks inside; of Han characters and kana each counts.
_SIGN = r"\u3040-\u30ff\u3400-\u9fff"
_WORD = re.compile(rf"[{_SIGN}]|[^\W{_SIGN}]+(?:(?:(?<=\d)[.,;'](?=\d)|(?<=[^\W\d])['\u2019.:\u00b7](?=[^\W\d]))[^\W{_SIGN}]+)*")


def n_words(text: str) -> int:
    return sum(1 for _ in _WORD.finditer(text))


class _Surface(_Page):
    """Adds the text of main, article and body, less what is no content, and images that load later."""

    def __init__(self, base: str) -> None:
        super().__init__(base)
        self.open: list[tuple[str, bool]] = []  # elements, and whether their text is no content
        self.regions: dict[str, list[str]] = {"main": [], "article": [], "body": []}
        self.seen: set[str] = set()
        self.shown: list[dict] = []
        self.types_raw: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag in self.regions:
            self.seen.add(tag)
        if tag == "img" and (src := a.get("src") or a.get("data-src")) and (url := resolve(src, self.base)):
            self.shown.append({"src": url, "alt": a["alt"].strip() if "alt" in a else None, "lazy": not a.get("src")})
        if tag not in VOID:
            blocked = tag in BLOCKED_TAGS or bool(BLOCKED_CLASSES & set(a.get("class", "").split())) or a.get("role") in BLOCKED_ROLES
            self.open.append((tag, blocked))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        tags = [t for t, _ in self.open]
        if "head" in tags or "title" in tags:
            return
        for region, parts in self.regions.items():
            at = tags.index(region) if region in tags else -1
            if (at >= 0 or region == "body") and not any(blocked for _, blocked in self.open[at + 1 :]):
                parts.append(data)

    def content(self) -> str:
        return _squeezed(self.regions[next((r for r in ("main", "article") if r in self.seen), "body")])


def _items(raw: str) -> list:
    try:
        data = json.loads(raw)
    except ValueError:
        return [{}]
    if isinstance(data, list):
        return data
    graph = data.get("@graph") if isinstance(data, dict) else None
    return graph if isinstance(graph, list) else [data]


def _types(items: list) -> list[str]:
    found = [x.get("@type") for x in items if isinstance(x, dict)]
    return sorted(t for x in found for t in (x if isinstance(x, list) else [x]) if isinstance(t, str))


def read_surface(html: str | None, url: str | None) -> dict:
    """All that one form shows; a null form shows nothing."""
    p = _Surface(url or "")
    p.feed(html or "")
    p.close()
    texts = lambda levels: [t for n in levels for k, x in p.headings if k == n and (t := _squeezed(x))]
    inner, outer = [], []
    for link, _ in p.links:
        (inner if urlsplit(link).hostname == p.host else outer).append(link)
    items = [i for x in p.json_ld if (raw := "".join(x).strip()) for i in _items(raw)]
    return {
        "title": p.title and _squeezed(p.title) or None, "description": p.meta.get("description") or None, "robots": p.meta.get("robots") or None, "canonical": p.canonical,
        "og": p.og, "twitter": p.twitter, "h1": texts([1]), "headings": texts([2, 3, 4, 5, 6]), "internal": inner, "external": outer, "images": p.shown,
        "types": _types(items), "n_json_ld": len(items), "hreflang": [f"{k.strip()} → {u}" for k, u in p.hreflang], "words": n_words(p.content()), "bytes": len((html or "").encode("utf-8", "replace")),
    }


def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for html, url in slices(batches):
        yield pd.DataFrame([read_surface(h, u) for h, u in zip(html, url)], columns=[c.split()[0] for c in re.sub(r"<[^ ]*>", "", SCHEMA).split(",")])


def extract_surface(html: str | Column, url: str | Column) -> Column:
    """Struct of what a form of a page shows (SCHEMA)."""
    return F.pandas_udf(_extract, SCHEMA)(html, url)
