"""The link plan on literal sites: who is a target, who a source, and the joint caps."""

from pyspark.sql import functions as F

from sitegrain.operators import linkplan

FACTS = "url string, title string, h1 array<string>, h2 array<string>, depth int, in_degree int, out_degree int, authority int, is_orphan boolean, n_schemas int, links array<struct<url:string,is_internal:boolean>>"


def _facts(spark, rows):
    base = {"title": None, "h1": [], "h2": [], "depth": 2, "in_degree": 1, "out_degree": 1, "authority": 10, "is_orphan": False, "n_schemas": 0, "links": []}
    names = [x.split()[0] for x in FACTS.replace("array<struct<url:string,is_internal:boolean>>", "x").split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], FACTS)


def test_hub_links_to_orphan(spark):
    site = [{"url": "https://e.org/hub", "title": "Garden lamps", "authority": 60, "in_degree": 20, "out_degree": 15}, {"url": "https://e.org/orphan-lamp", "title": "Orphan garden lamp", "in_degree": 0, "is_orphan": True}]
    rows = linkplan.suggestions(_facts(spark, site)).collect()
    assert [(r.source_url, r.target_url) for r in rows] == [("https://e.org/hub", "https://e.org/orphan-lamp")]
    # 20 + 10 + 20 + 2*8 + 1.5*3 + 5*(3 * "garden" + 2.5 * {https:, e.org} / 4)
    assert rows[0].score == round(20 + 10 + 20 + 16 + 4.5 + 5 * (3 + 2.5 * 2 / 4), 1) and rows[0].confidence == 50 + 10 + 0 + 15 + 15 + 5
    assert rows[0].reason == "High authority page (20 in-links) linking to orphan page" and rows[0].anchor_text == "Orphan garden lamp"
    linked = [site[0] | {"links": [{"url": site[1]["url"], "is_internal": True}]}, site[1]]
    assert linkplan.suggestions(_facts(spark, linked)).count() == 0
    assert linkplan.suggestions(_facts(spark, site), least_confidence=99).count() == 0 and linkplan.suggestions(_facts(spark, [])).count() == 0


def test_caps_and_targets(spark):
    site = [{"url": f"https://e.org/o{i:02}", "title": "common words here", "in_degree": 0} for i in range(30)] + [
        {"url": f"https://e.org/s{i}", "title": "common words here", "authority": 90 - i, "in_degree": 9} for i in range(6)] + [
        {"url": "https://e.org/login", "in_degree": 0}, {"url": "https://e.org/products/x", "title": "common", "in_degree": 1}]
    facts = _facts(spark, site)
    rows = linkplan.suggestions(facts, most=1000).collect()
    by_target, by_source = {}, {}
    for r in rows:
        by_target[r.target_url] = by_target.get(r.target_url, 0) + 1
        by_source[r.source_url] = by_source.get(r.source_url, 0) + 1
        assert r.source_url != r.target_url
    assert max(by_target.values()) == 5 and max(by_source.values()) == 10 and len(by_target) == 21
    assert linkplan.suggestions(facts).count() == 50
    assert [r.url for r in linkplan.priorities(facts).collect()] == ["https://e.org/products/x"] and linkplan.hubs(facts).where(F.col("url").endswith("login")).count() == 0
    assert linkplan.orphans(facts).where("target_score < 0").count() == 1
