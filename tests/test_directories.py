"""Listings against businesses, all pairs judged by the definition."""

import random
import re

from sitegrain.operators import directories as d

SOURCE = "source_id int, name string, phone string, address string, website string"
LISTING = "directory string, url string, name string, phone string, address string, website string, links array<string>, title string, snippet string, own_link boolean"


def _tokens(text, stop=()):
    return {w for w in re.split("[^a-z0-9]+", (text or "").lower()) if len(w) > 1 and w not in stop}


def _share(a, b):
    return len(a & b) / len(a) if a and b else 0.0


def _domain(url):
    m = re.match(r"[a-z]+://([^/:]+)", url or "")
    return ".".join(re.sub(r"^www\.", "", m[1].lower()).split(".")[-2:]) if m else None


def _expected(sources, listings):
    out = []
    for i, name, phone, address, site in sources:
        for directory, url, n, p, a, w, links, title, snippet, own in listings:
            tel = lambda x: re.sub(r"\D", "", x or "")[-10:]
            web = _domain(site) is not None and _domain(site) in {_domain(x) for x in [w, *(links or [])]}
            same = bool(tel(phone)) and tel(phone) in (tel(p), tel(snippet))
            named, placed = _share(_tokens(name, d.NAME_STOP_WORDS), _tokens(f"{n or ''} {title or ''}", d.NAME_STOP_WORDS)), _share(_tokens(address), _tokens(f"{a or ''} {snippet or ''}"))
            if web or same and (named >= 0.6 or placed >= 0.5) or named >= 0.75 and placed >= 0.65:
                bad_name, bad_phone = bool(n) and named < 0.6, bool(tel(phone) and tel(p)) and tel(phone) != tel(p)
                status = "Wrong Business Name, Wrong Phone Number" if bad_name and bad_phone else "Wrong Business Name" if bad_name else "Wrong Phone Number" if bad_phone else "No Phone Number" if tel(phone) and not tel(p) else "Issues not found"
                confidence = min(1, web * 0.55 + same * 0.25 + named * 0.15 + placed * 0.1 + bool(own) * 0.1)
                out.append((i, directory, url, web, same, round(named, 6), round(placed, 6), round(confidence, 6), status))
    return sorted(out)


def test_all_pairs(spark):
    draw = random.Random(6)
    words = ["Acme", "Dental", "The", "Smile", "House", "Inc", "Blue", "River", "Auto", "Clinic", "North", "Café"]
    name = lambda: draw.choice([None, "", *(" ".join(draw.sample(words, draw.randrange(1, 6))) for _ in range(8))])
    phone = lambda: draw.choice([None, "none", *(f"+1 ({draw.randrange(200, 203)}) 555-{draw.randrange(1000, 1004)}" for _ in range(3))])
    address = lambda: draw.choice([None, *(f"{draw.randrange(1, 4)} {draw.choice(['Main', 'Oak'])} Street, {draw.choice(['Springfield', 'Shelby ville'])}" for _ in range(5))])
    site = lambda: draw.choice([None, None, "not a url", *(f"https://www.{draw.choice('abcd')}.example.{draw.choice(['com', 'net'])}/x" for _ in range(2))])
    sources = [(i, name(), phone(), address(), site()) for i in range(40)]
    listings = [(draw.choice(["Yelp", "n49"]), f"https://l.test/{i}", name(), phone(), address(), site(), draw.choice([None, [], [site(), site()]]), name(), draw.choice([None, "call 200 555 1001", address()]), draw.choice([None, True, False])) for i in range(120)]
    found = d.evidence(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(listings, LISTING))
    got = sorted((*tuple(r)[:5], round(r.name_score, 6), round(r.address_score, 6), round(r.confidence, 6), r.status) for r in found.collect())
    expected = _expected(sources, listings)
    assert got == expected and len(got) > 100 and len({r[-1] for r in got}) == 5
    best = {}
    for r in expected:
        if (k := r[:2]) not in best or (-r[7], r[2]) < (-best[k][7], best[k][2]):
            best[k] = r
    assert sorted(r.listing_url for r in d.best(found).collect()) == sorted(r[2] for r in best.values())


def test_nothing(spark):
    none, one = spark.createDataFrame([], SOURCE), spark.createDataFrame([(1, "The Inc", "", None, None)], SOURCE)
    assert d.evidence(none, spark.createDataFrame([], LISTING)).count() == 0
    assert d.evidence(one, spark.createDataFrame([("Yelp", "u", "The Inc", "", None, None, None, None, None, None)], LISTING)).count() == 0
