"""Structured data of one page: microdata and RDFa items, merging, validation and the entity graph, over parsed JSON."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urlsplit

from sitegrain.functions.html import VOID

#: Where an element keeps its value; required and recommended properties of types; types that a site should have.
VALUE_ATTRIBUTE = {
    "meta": "content", "link": "href", "a": "href", "area": "href", "object": "data", "data": "value", "meter": "value",
    "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src",
}
REQUIRED = {
    "Article": ("headline", "author"), "BlogPosting": ("headline", "author"), "Product": ("name",), "Organization": ("name",), "Person": ("name",),
    "LocalBusiness": ("name", "address"), "FAQPage": ("mainEntity",), "BreadcrumbList": ("itemListElement",), "Recipe": ("name",),
    "Event": ("name", "startDate", "location"), "JobPosting": ("title", "hiringOrganization", "jobLocation", "datePosted", "validThrough"),
}
RECOMMENDED = {
    "Article": ("datePublished", "image", "description"), "BlogPosting": ("datePublished", "image", "description"),
    "Product": ("image", "description", "offers", "brand"), "Organization": ("url", "logo", "sameAs"), "Person": ("url", "sameAs", "image"),
    "LocalBusiness": ("telephone", "url", "openingHours"),
    "Recipe": ("author", "datePublished", "image", "description", "prepTime", "cookTime", "totalTime", "recipeYield", "recipeIngredient", "recipeInstructions"),
    "Event": ("description", "image", "endDate", "organizer"), "JobPosting": ("description", "employmentType", "baseSalary"),
}
EXPECTED_TYPES = (
    "Organization", "WebSite", "WebPage", "Article", "BreadcrumbList", "Product", "Person", "VideoObject", "ImageObject", "FAQPage", "HowTo", "LocalBusiness", "Event",
)
AUTHORITIES = ("wikipedia.org", "wikidata.org", "linkedin.com", "twitter.com", "x.com", "crunchbase.com", "github.com")
_NAMES = ("@id", "@type", "@context")


def _tail(kind: str) -> str:
    return kind.strip().rstrip("/").rsplit("/", 1)[-1] if kind.strip().startswith(("http://", "https://")) else kind.strip()


def _prefixless(name: str) -> str:
    return name if name.startswith(("http://", "https://")) else name.rsplit(":", 1)[-1]


class _Items(HTMLParser):
    """Items of one vocabulary of attributes; ``scope`` opens an item, ``prop`` names a property of the innermost open one."""

    def __init__(self, rdfa: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.rdfa, self.items = rdfa, []
        self.open: list[tuple[str, dict | None, list[str] | None, str]] = []  # tag, item it opened, text it collects, property

    def _add(self, owner: dict, names: str, value) -> None:
        for name in names.split():
            name = _tail(_prefixless(name)) if self.rdfa else name
            owner[name] = value if name not in owner else [*owner[name], value] if isinstance(owner[name], list) else [owner[name], value]

    def _owner(self) -> dict | None:
        return next((item for _, item, _, _ in reversed(self.open) if item is not None), None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        scope = "typeof" in a if self.rdfa else "itemscope" in a
        prop = a.get("property" if self.rdfa else "itemprop", "")
        owner, item, text = self._owner(), None, None
        if scope:
            kind = _prefixless((a.get("typeof", "").split() or ["Thing"])[0]) if self.rdfa else a.get("itemtype", "") or "Thing"
            item = {"@type": _tail(kind) or "Thing"}
            if name := (a.get("resource") or a.get("about") if self.rdfa else a.get("itemid")):
                item["@id"] = name.strip()
            if prop and owner is not None:
                self._add(owner, prop, item)
            elif owner is None:
                self.items.append(item)
        elif prop and owner is not None:
            attribute = VALUE_ATTRIBUTE.get(tag)
            if self.rdfa and "content" in a:
                self._add(owner, prop, a["content"])
            elif tag == "time" and a.get("datetime"):
                self._add(owner, prop, a["datetime"])
            elif attribute and (attribute in a or not self.rdfa):
                self._add(owner, prop, a.get(attribute, ""))
            elif tag not in VOID:
                text = []
        if tag not in VOID:
            self.open.append((tag, item, text, prop))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        while at is not None and len(self.open) > at:
            self._close(*self.open.pop())

    def _close(self, tag: str, item: dict | None, text: list[str] | None, prop: str) -> None:
        if text is not None and (owner := self._owner()) is not None:
            self._add(owner, prop, "".join(text).strip())

    def handle_data(self, data: str) -> None:
        for _, _, text, _ in self.open:
            if text is not None:
                text.append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._close(*self.open.pop())


def _items(html: str | None, rdfa: bool) -> list[dict]:
    p = _Items(rdfa)
    p.feed(html or "")
    p.close()
    return p.items


def microdata(html: str | None) -> list[dict]:
    """Items that no other item holds, with nested items as values."""
    return _items(html, False)


def rdfa(html: str | None) -> list[dict]:
    """Typed resources; prefixes of types and properties are dropped."""
    return _items(html, True)


def _key(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def deep_merge(a, b):
    """Lists are joined and deduplicated, objects merged key by key; ids and types keep the left value, other scalars take the right one."""
    if not isinstance(a, dict | list):
        return b
    if not isinstance(b, dict | list):
        return a
    if isinstance(a, list) or isinstance(b, list):
        both = (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])
        return list({_key(x): x for x in reversed(both)}.values())[::-1]
    out = dict(a)
    for k, v in b.items():
        out[k] = v if k not in out else out[k] if k in ("@id", "@type") and out[k] else deep_merge(out[k], v)
    return out


def kind_of(item: dict) -> str:
    """An item's type; of several the first."""
    kind = item.get("@type")
    kind = (kind[0] if kind else None) if isinstance(kind, list) else kind
    return kind if isinstance(kind, str) else ""


def merge_items(items: list[dict]) -> list[dict]:
    """Items of one id as one; items without id as one where they share a property and agree on all they share; errors last."""
    by_id, loose, errors = {}, {}, []
    for item in items:
        if item.get("__error"):
            errors.append(item)
            continue
        item = item | {"@type": _tail(kind_of(item) or "Thing")}
        if name := item.get("@id"):
            by_id[name] = deep_merge(by_id[name], item) if name in by_id else item
            continue
        alike = loose.setdefault(item["@type"], [])
        for i, other in enumerate(alike):
            common = (other.keys() & item.keys()) - {"@type"}
            if common and all(_key(other[k]) == _key(item[k]) for k in common):
                alike[i] = deep_merge(other, item)
                break
        else:
            alike.append(item)
    return [*by_id.values(), *(x for alike in loose.values() for x in alike), *errors]


def _has(item: dict, name: str) -> bool:
    return item.get(name) not in (None, "")


def issues(item: dict, page: dict | None = None) -> list[tuple[str, str, str]]:
    """(level, property, message) of one item; page has title, url, canonical and open_graph."""
    if item.get("__error"):
        return [("error", "", "unreadable JSON")]
    kind, out = kind_of(item), []
    if not kind:
        return [("error", "@type", "no type")]
    if kind in REQUIRED:
        out += [("error", p, "required") for p in REQUIRED[kind] if not _has(item, p)]
        out += [("warning", p, "recommended") for p in RECOMMENDED.get(kind, ()) if not _has(item, p)]
    else:
        out.append(("info", "@type", "type without known requirements"))
    out += [("warning", k, "empty text") for k, v in item.items() if isinstance(v, str) and not v.strip()]
    out += _parts(item, kind) + _authority(item, kind) + (_mismatches(item, kind, page) if page else [])
    return out


def _parts(item: dict, kind: str) -> list[tuple[str, str, str]]:
    out = []
    if kind == "BreadcrumbList" and isinstance(item.get("itemListElement"), list):
        steps = item["itemListElement"]
        out += [("error", "itemListElement", "empty list")] if not steps else []
        for step in steps:
            step = step if isinstance(step, dict) else {}
            out += [("warning", "itemListElement", "step without position")] if not step.get("position") else []
            out += [("error", "itemListElement", "step without item")] if not step.get("item") else []
    if kind == "FAQPage" and isinstance(item.get("mainEntity"), list):
        for question in item["mainEntity"]:
            question = question if isinstance(question, dict) else {}
            out += [("warning", "mainEntity", "not a question")] if question.get("@type") != "Question" else []
            out += [("error", "mainEntity", "question without name")] if not question.get("name") else []
            out += [("error", "mainEntity", "question without answer")] if not question.get("acceptedAnswer") else []
    return out


def _authority(item: dict, kind: str) -> list[tuple[str, str, str]]:
    out = []
    if kind in ("Person", "Organization", "LocalBusiness"):
        links = item.get("sameAs") if isinstance(item.get("sameAs"), list) else [item.get("sameAs")]
        good = [u for u in links if isinstance(u, str) and any(d in u for d in AUTHORITIES)]
        if not _has(item, "sameAs"):
            out.append(("info", "sameAs", "missing"))
        else:
            out += [("info", "sameAs", "authority link")] * len(good) or [("info", "sameAs", "no authority link")]
    author = item.get("author")
    if isinstance(author, dict) and not _has(author, "sameAs"):
        out.append(("info", "author", "author without sameAs"))
    return out


def _mismatches(item: dict, kind: str, page: dict) -> list[tuple[str, str, str]]:
    og, out = page.get("open_graph") or {}, []
    name, title = item.get("headline") or item.get("name"), page.get("title") or og.get("title")
    if isinstance(name, str) and title:
        a, b = name.strip().lower(), title.strip().lower()
        if a not in b and b not in a:
            out.append(("warning", "headline" if item.get("headline") else "name", "mismatch with the page's title"))
    url, own = item.get("url") or item.get("mainEntityOfPage"), page.get("canonical") or page.get("url")
    url = url.get("@id") if isinstance(url, dict) else url
    if isinstance(url, str) and own and urlsplit(url).scheme and (urlsplit(url).path or "/") != (urlsplit(own).path or "/"):
        out.append(("warning", "url" if item.get("url") else "mainEntityOfPage", "mismatch with the page's path"))
    offers = item.get("offers")
    offers = (offers[0] if offers else None) if isinstance(offers, list) else offers
    if kind == "Product" and isinstance(offers, dict):
        price, shown = offers.get("price"), og.get("price:amount") or og.get("price")
        if price and shown and str(price) != str(shown):
            out.append(("warning", "offers.price", "mismatch with the page's price"))
        currency, named = offers.get("priceCurrency"), og.get("price:currency")
        if currency and named and str(currency).upper() != named.upper():
            out.append(("warning", "offers.priceCurrency", "mismatch with the page's currency"))
    return out


def entities(items: list) -> tuple[list[dict], list[tuple[int, str, dict]]]:
    """All typed nodes at any depth, those of one id as one, and their references (node, property, target) to nodes or ids."""
    nodes, by_id, references = [], {}, []

    def visit(value) -> int | None:
        if isinstance(value, list):
            for x in value:
                visit(x)
            return None
        if not isinstance(value, dict):
            return None
        at = None
        if kind_of(value):
            name = value.get("@id") if isinstance(value.get("@id"), str) else None
            if name in by_id and name:
                at = by_id[name]
                nodes[at] = nodes[at] | value
            else:
                at = len(nodes)
                nodes.append(dict(value))
                if name:
                    by_id[name] = at
        for k, v in value.items():
            if k in _NAMES:
                continue
            if at is not None:
                for target in v if isinstance(v, list) else [v]:
                    if isinstance(target, dict) and (target.get("@type") or target.get("@id")):
                        references.append((at, k, target))
            visit(v)
        return at

    visit(items)
    return nodes, references


def hierarchy(items: list) -> tuple[list[int], list[tuple[int, int, int, bool]]]:
    """Root nodes (referenced by none; the first three where all are) and (node, parent, depth, circular) below them."""
    nodes, references = entities(items)
    by_id = {n["@id"]: i for i, n in enumerate(nodes) if isinstance(n.get("@id"), str)}
    children: dict[int, list[int]] = {}
    for at, _, target in references:
        to = by_id.get(target.get("@id"))
        if to is None and target.get("@type"):
            to = next((i for i, n in enumerate(nodes) if n == target), None)
        if to is not None:
            children.setdefault(at, []).append(to)
    named = {t for ts in children.values() for t in ts}
    roots = [i for i in range(len(nodes)) if i not in named] or list(range(min(3, len(nodes))))
    rows: list[tuple[int, int, int, bool]] = []

    def walk(node: int, parent: int, depth: int, above: frozenset) -> None:
        circular = node in above
        rows.append((node, parent, depth, circular))
        if not circular:
            for child in dict.fromkeys(children.get(node, [])):
                walk(child, node, depth + 1, above | {node})

    for r in roots:
        walk(r, -1, 1, frozenset())
    return roots, rows
