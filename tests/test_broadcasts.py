"""What grows with the pages is never gathered on the driver for a join, however small its files are."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sitegrain.operators import opportunities, scoring, signatures, whole  # noqa: F401  scoring registers its plans
from sitegrain.plans.dialect import PLANS, STORED

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings(spark):
    """Links, titles, degrees and near pages are joined without a broadcast."""
    plan = _plan(STORED["findings"].run(spark, SF))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sides_of_two_sites(spark):
    plan = _plan(PLANS["lim01_key_gaps"].run(spark, SF))
    assert "SortMergeJoin [page_id" in plan and "BroadcastHashJoin [page_id" not in plan


@pytest.mark.parametrize("name", ["agg04_overall", "agg07_mobile"])
def test_flags_of_the_site(spark, name):
    """The one row of the scale is broadcast, not the findings."""
    plan = _plan(PLANS[name].run(spark, SF))
    assert "BroadcastNestedLoopJoin" in plan and "LeftOuter" not in "".join(x for x in plan.splitlines() if "BroadcastNestedLoopJoin" in x)


@pytest.mark.parametrize("name", ["agg04_overall", "agg07_mobile"])
def test_flags_of_no_pages(spark, tmp_path, name):
    """Without findings the flags don't hold: the same row as the SQL's outer join."""
    spark.read.parquet(f"{SF}/pages.parquet").where("false").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert [tuple(r) for r in PLANS[name].run(spark, str(tmp_path)).collect()] == con.sql(PLANS[name].sql()).fetchall()


def test_near_pages(spark):
    signed = spark.range(6).select(F.col("id").alias("page_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i + F.col("id") % 3).alias("sig"))
    plan = _plan(signatures.near_kinds(signed))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_opportunities(spark):
    pages = spark.range(1).selectExpr("concat('u', id) as url", "'t' as title", "1 as depth", "0L as in_degree", "true as is_orphan", "0 as n_schemas", "true as has_vitals")
    kind = "array('metadata', 'performance', 'indexing')[id]"
    found = spark.range(3).selectExpr("concat('u', id div 9) as url", f"concat({kind}, '-rule') as rule_id", "'error' as severity", f"{kind} as category", "'thin text' as message", "'' as recommendation")
    known = opportunities._known(pages, None)
    for made in (opportunities.metadata(known, found), opportunities.indexing(known, found), opportunities.content(known, found), opportunities.performance(known, found)):
        assert "Broadcast" not in _plan(made) and made.count() == 1
