"""Tables that several queries share are written once for a state of their inputs."""

import shutil

import pytest

from sitegrain.plans import dialect, stored
from sitegrain.operators import scoring, signatures, site  # noqa: F401  scoring registers its plans
from sitegrain.plans.dialect import PLANS, over

SF = "/root/testdata/sf0.001"


def test_once_until_the_input_changes(spark, tmp_path):
    calls, path = [], f"{tmp_path}/in.parquet"

    def make():
        calls.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    first = stored.once(spark, "t", [path], make)
    assert stored.once(spark, "t", [path], make) == first and len(calls) == 1
    assert stored.once(spark, "other", [path], make) != first
    spark.range(5).write.mode("append").parquet(path)
    second = stored.once(spark, "t", [path], make)
    assert second != first and spark.read.parquet(second).count() == 8
    shutil.rmtree(second.removeprefix("file://"))
    third = stored.once(spark, "t", [path], make)  # somebody deleted it
    assert third != second and spark.read.parquet(third).count() == 8 and len(calls) == 4


def test_forget(spark, tmp_path):
    path = f"{tmp_path}/in.parquet"
    spark.range(3).write.parquet(path)
    kept = stored.once(spark, "forgotten", [path], lambda: spark.read.parquet(path))
    stored.forget(spark)
    assert not stored.exists(spark, kept)
    assert stored.exists(spark, stored.once(spark, "forgotten", [path], lambda: spark.read.parquet(path)))


def test_findings_are_read_not_made_again(spark):
    PLANS["agg02_deductions"].run(spark, SF).collect()
    files = PLANS["agg04_overall"].run(spark, SF).inputFiles()
    assert any("/findings/" in f for f in files) and not any(f.endswith("/pages.parquet") for f in files)


def test_over_frames(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    a = over(spark, {"pages": pages}, "select count(*) as n, max(status_code) as s from pages").first()
    assert (a.n, a.s) == (pages.count(), 200)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("_pages")]
    b = over(spark, {"pages": pages.selectExpr("*", "cast(404 as bigint) as status_code")}, "select max(status_code) as s from pages").first()
    assert b.s == 404


def test_unread_tables_are_not_written(spark, monkeypatch):
    """Links between pages need neither findings nor near pages."""
    def refuse(*_):
        raise AssertionError("written although nothing reads it")

    for name in ("near_pages", "findings"):
        monkeypatch.setitem(dialect.STORED, name, dialect.Made(refuse, ("pages",)))
    stored.forget(spark)
    assert PLANS["jon07_page_edges"].run(spark, "/root/testdata/sf0.001").columns == ["source", "target"]
    with pytest.raises(AssertionError):
        PLANS["agg04_overall"].run(spark, "/root/testdata/sf0.001")


def test_site_links_need_no_near_pages(spark, monkeypatch):
    """Targets of the link plan follow from links and structured data."""
    def refuse(*_):
        raise AssertionError("made although nothing reads it")

    monkeypatch.setattr(signatures, "near_pages", refuse)
    stored.forget(spark)
    assert site.QUERIES["lp02_targets"](spark, SF).columns == ["url", "target_score"]


@pytest.mark.parametrize("name", ["agg08_ai", "agg07_mobile", "agg09_security", "agg09_security_buckets"])
def test_categories_of_single_pages_need_no_others(spark, monkeypatch, name):
    """No rule over several pages has a finding of these categories."""
    def refuse(*_):
        raise AssertionError("written although nothing reads it")

    for stored_name in ("near_pages", "findings"):
        monkeypatch.setitem(dialect.STORED, stored_name, dialect.Made(refuse, ("pages",)))
    stored.forget(spark)
    assert PLANS[name].run(spark, SF).count() > 0
