"""Reports as files: JSON, CSV, text, HTML, Markdown, SARIF and snapshots, written by Spark into any store it knows.

Rows stay distributed; only what a report states once (totals of a bounded
number of categories) is collected.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.scalars import escape_html

#: SARIF's levels and version.
LEVELS = {"critical": "error", "error": "error", "warning": "warning", "info": "note"}
SARIF_VERSION = "2.1.0"


def level(severity: str | Column = "severity") -> Column:
    col = F.col(severity) if isinstance(severity, str) else severity
    return F.when(col.isin("critical", "error"), "error").when(col == "warning", "warning").otherwise("note")


def write_json(df: DataFrame, path: str) -> None:
    """One object a line."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and all cells quoted."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """Results as JSON text, one a row: rule, level, message and place."""
    place = F.array(F.struct(F.struct(F.struct(F.col("url").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    row = F.struct(F.concat_ws("/", "rule_id", "sub_check").alias("ruleId"), level().alias("level"), F.struct(F.coalesce("message", "sub_check", "rule_id").alias("text")).alias("message"), place.alias("locations"))
    return findings.select(F.to_json(row).alias("value"))


def sarif_frame(rules: list[str], tool: str = "sitegrain") -> tuple[str, str]:
    """The document's text before and after its results."""
    head = {"version": SARIF_VERSION, "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in sorted(rules)]}}, "results": []}]}
    return tuple(json.dumps(head).rsplit("[]", 1))


def write_sarif(findings: DataFrame, path: str) -> None:
    """A document's parts as text files in name order: head, one result a line, tail. Joined they are one JSON document."""
    rules = [r.rule_id for r in findings.select("rule_id").distinct().collect()]  # bounded by the rules that exist
    head, tail = sarif_frame(rules)
    results = sarif_results(findings).select(F.concat("value", F.lit(",")).alias("value"))
    spark = findings.sparkSession
    for name, lines in (("0-head", spark.createDataFrame([(head + "[",)], "value string")), ("1-results", results), ("2-tail", spark.createDataFrame([("null]" + tail,)], "value string"))):
        lines.write.mode("overwrite").text(f"{path}/{name}")


def html_rows(df: DataFrame) -> DataFrame:
    """A table row of escaped cells for each row."""
    cells = [F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    cells = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_report(df: DataFrame, path: str, form: str = "json", title: str = "Report") -> None:
    """Any result as json, csv, html or md; html and md have a head, rows and (html) a tail, in name order."""
    spark = df.sparkSession
    if form in ("json", "csv"):
        {"json": write_json, "csv": write_csv}[form](df, path)
        return
    names = [c.replace("&", "&amp;").replace("<", "&lt;") for c in df.columns]
    if form == "html":
        head = f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1><table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
        rows, tail = html_rows(df), "</table>"
    elif form == "md":
        head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
        rows, tail = markdown_rows(df), ""
    else:
        raise ValueError(f"unknown form {form}")
    for name, lines in (("0-head", spark.createDataFrame([(head,)], "value string")), ("1-rows", rows), ("2-tail", spark.createDataFrame([(tail,)], "value string"))):
        lines.write.mode("overwrite").text(f"{path}/{name}")


def save_snapshot(findings: DataFrame, folder: str, host: str, saved_at: str) -> None:
    """Appends an audit's findings below host and time; a reader sees a snapshot once its files are committed."""
    rows = findings.withColumns({"host": F.lit(host), "saved_at": F.lit(saved_at)})
    rows.write.mode("append").partitionBy("host", "saved_at").parquet(folder)


def load_snapshot(spark, folder: str, host: str, saved_at: str | None = None) -> DataFrame:
    """A host's snapshot of that time, the last one by default."""
    rows = spark.read.option("basePath", folder).parquet(folder).where(F.col("host") == host)
    last = saved_at or rows.agg(F.max(F.col("saved_at").cast("string"))).first()[0]
    return rows.where(F.col("saved_at").cast("string") == F.lit(last)).drop("host", "saved_at")


def exit_code(findings: DataFrame, pages: DataFrame, fail_on: tuple[str, ...] = ("critical", "error"), budgets: dict[str, float] | None = None) -> int:
    """1 for failing severities, 2 for a broken budget (mean lcp, cls, inp, sum of js_bytes), 3 for both, 0 for none."""
    fails = not findings.where(F.col("severity").isin(*fail_on)).isEmpty()
    broken = False
    if budgets:
        means = [F.avg(k).alias(k) if k != "js_bytes" else F.sum(k).alias(k) for k in budgets]
        row = pages.agg(*means).first()
        broken = any(row[k] is not None and row[k] > limit for k, limit in budgets.items())
    return fails + 2 * broken
