"""Registry of the engine's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegrain.operators import graph, pages, planning, rules, scoring, site, texts, whole  # noqa: F401  they register their plans
from sitegrain.plans import tiers  # noqa: F401
from sitegrain.plans.dialect import PLANS
from sitegrain.streaming import captures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: p.run for name, p in PLANS.items()} | graph.QUERIES | captures.QUERIES | whole.QUERIES | site.QUERIES
ORACLE_SQL: dict[str, str] = {name: p.sql() for name, p in PLANS.items()} | graph.ORACLE_SQL | captures.ORACLE_SQL | whole.ORACLE_SQL | site.ORACLE_SQL | texts.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_category_scores"](spark, sf_dir)
