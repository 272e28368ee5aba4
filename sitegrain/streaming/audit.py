"""The two-phase audit of a stream of captures.

While captures come in, every micro-batch is reduced to page rows (facts and
codes of the checks that hold, no html) and their findings; when the stream has
ended, the rules that look at several pages run over all page rows. All
findings are one table below ``folder``, partitioned by the part that wrote
them: ``batch-<number>`` or ``set``. A part is overwritten by whoever writes it
again, so a batch that failed half-way and is repeated leaves the rows it would
have left, and so does a second end.

Defined results: a batch of no rows writes an empty part; null html is an empty
page; rows that repeat a page_id stay rows of their own, as in the batch audit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegrain.operators.rules import fired_findings, page_rows, set_rules
from sitegrain.operators.signatures import near_kinds, signed_pages
from sitegrain.plans.dialect import SPARK, over

FINDING = "page_id bigint, url string, rule_id string, sub_check string, severity string, category string"


def _rows(folder: str) -> str:
    return f"{folder}/page_rows"


def _findings(folder: str) -> str:
    return f"{folder}/findings"


def page_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` sink of the first phase."""

    def write(batch: DataFrame, number: int) -> None:
        rows = over(batch.sparkSession, {"pages": batch}, page_rows(SPARK))
        signed_pages(batch).write.mode("overwrite").parquet(f"{folder}/signatures/part={number}")
        at = f"{_rows(folder)}/part={number}"
        rows.write.mode("overwrite").parquet(at)
        found = over(batch.sparkSession, {"page_facts": batch.sparkSession.read.parquet(at)}, fired_findings(SPARK))
        found.write.mode("overwrite").parquet(f"{_findings(folder)}/part=batch-{number}")

    return write


def start(captures: DataFrame, folder: str):
    """Starts the first phase over what is there; its checkpoint lies in ``folder`` too, so that a restart goes on."""
    writer = captures.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    return writer.foreachBatch(page_sink(folder)).start()


def finish(spark: SparkSession, folder: str) -> DataFrame:
    """The second phase; returns all findings."""
    rows = spark.read.parquet(_rows(folder)).drop("part")
    near = near_kinds(spark.read.parquet(f"{folder}/signatures").drop("part"))
    found = over(spark, {"stored_rows": rows, "stored_near": near}, f"with {set_rules(SPARK, 'stored_rows', 'stored_near')} select * from set_findings")
    found.write.mode("overwrite").parquet(f"{_findings(folder)}/part=set")
    return spark.read.parquet(_findings(folder)).drop("part")
