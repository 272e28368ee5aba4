"""Reports, snapshots, settings, overrides and extension points."""

import json

import pytest
from pyspark.sql import functions as F

from sitegrain import sinks
from sitegrain.plans import config
from sitegrain.plans.tiers import Override

FINDINGS = "url string, rule_id string, sub_check string, severity string, message string"


@pytest.fixture(scope="module")
def findings(spark):
    return spark.createDataFrame([("https://e.org/", "missing-title", "missing", "critical", "no <title>"), ("https://e.org/a|b", "social-meta", "missing-og", "info", None)], FINDINGS)


def _joined(spark, path):
    parts = []
    for name in ("0-head", "1-results", "1-rows", "2-tail"):
        try:
            parts += [r.value for r in spark.read.text(f"{path}/{name}").collect()]
        except Exception:
            continue
    return "".join(parts)


def test_reports(spark, findings, tmp_path):
    sinks.write_sarif(findings, f"{tmp_path}/sarif")
    doc = json.loads(_joined(spark, f"{tmp_path}/sarif"))
    results = [r for r in doc["runs"][0]["results"] if r]
    assert doc["version"] == "2.1.0" and {(r["ruleId"], r["level"]) for r in results} == {("missing-title/missing", "error"), ("social-meta/missing-og", "note")}
    sinks.write_report(findings, f"{tmp_path}/html", "html")
    assert "no &lt;title&gt;" in _joined(spark, f"{tmp_path}/html")
    sinks.write_report(findings, f"{tmp_path}/md", "md")
    assert "a\\|b" in _joined(spark, f"{tmp_path}/md")
    sinks.write_report(findings, f"{tmp_path}/csv", "csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2
    sinks.write_report(findings, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    sinks.write_text(findings, "rule_id", f"{tmp_path}/txt")
    assert {r.value for r in spark.read.text(f"{tmp_path}/txt").collect()} == {"missing-title", "social-meta"}
    with pytest.raises(ValueError):
        sinks.write_report(findings, f"{tmp_path}/x", "pdf")


def test_snapshots_and_gate(spark, findings, tmp_path):
    sinks.save_snapshot(findings, f"{tmp_path}/s", "e.org", "2024-01-01T00")
    sinks.save_snapshot(findings.limit(1), f"{tmp_path}/s", "e.org", "2024-02-01T00")
    assert sinks.load_snapshot(spark, f"{tmp_path}/s", "e.org").count() == 1 and sinks.load_snapshot(spark, f"{tmp_path}/s", "e.org", "2024-01-01T00").count() == 2
    pages = spark.createDataFrame([(3000.0, 10)], "lcp double, js_bytes bigint")
    assert [sinks.exit_code(findings, pages, f, b) for f, b in ((("critical",), None), (("warning",), {"lcp": 2500}), (("critical",), {"js_bytes": 5}), (("error",), {"lcp": 9000}))] == [1, 2, 3, 0]


def test_settings(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"max_pages": 7, "fail_on": ["error"], "overrides": {"missing-title": {"weight": 3}}}')
    s = config.resolve("quick", str(file), {"max_depth": 2, "include": None}, {"SITEGRAIN_MAX_PAGES": "9", "SITEGRAIN_BROWSER": "yes"})
    assert (s.tier, s.max_pages, s.max_depth, s.fail_on, s.browser, s.overrides["missing-title"].weight) == ("fast", 9, 2, ("error",), True, 3)
    assert config.crawler(s) == "browser" and config.crawler(s, can_browse=False) == "http"
    for wrong in ({"max_pages": 0}, {"fail_on": ["bad"]}, {"strange": 1}, {"overrides": {"no-rule": {}}}, {"tier": "x"}):
        with pytest.raises(ValueError):
            config.resolve(arguments=wrong, environment={})
    assert config.difference(config.Settings(), config.Settings(max_pages=5)) == [("max_pages", "100", "5")]
    assert json.loads(config.example())["tier"] == "standard"


def test_rules_and_overrides(spark, findings):
    own = {"missing-title": Override(severities={"missing-title:missing": "warning"}), "social-meta": Override(enabled=False)}
    assert [(r.rule_id, r.severity) for r in config.overridden(findings, own).collect()] == [("missing-title", "warning")]
    rows = {r.rule_id: r for r in config.rule_table(spark, config.Settings(tier="fast", overrides={"missing-title": Override(weight=2)})).collect()}
    assert len(rows) == 43 and (rows["missing-title"].weight, rows["missing-title"].overridden) == (2, True) and sum(r.runs for r in rows.values()) == 9


def test_plugins(spark, findings):
    registry = config.Registry()
    pages = findings.select("url").withColumn("words", F.lit(3))

    @registry.rule("short", "seo", "warning")
    def short(df):
        return df.where("words < 5").select("url", F.lit("few").alias("sub_check"))

    @registry.rule("broken", "seo", "warning")
    def broken(df):
        return df.select("no_such_column")

    assert {(r.rule_id, r.severity) for r in registry.findings(pages).collect()} == {("short", "warning")} and registry.errors[0][0] == "broken"
    registry.plugins += [config.Plugin("p", after_analysis=lambda f: f.where("severity = 'info'"), data_sources=lambda _: {"x": ("ok", None)}), config.Plugin("q", after_analysis=lambda f: f.no, data_sources=lambda _: 1 / 0)]
    assert registry.chain("after_analysis", findings).count() == 1 and registry.sources(pages) == {"x": ("ok", None), "q": ("error", None)}
