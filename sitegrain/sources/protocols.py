"""Text protocol files as tables: robots.txt rules, sitemap locations, llms.txt sections; CSV backlink exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(files: DataFrame) -> DataFrame:
    """``files(host, content)`` → host, at, key, value of every ``key: value`` line, comments dropped."""
    lines = files.select("host", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))
    bare = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    return bare.where("line <> ''").select(
        "host", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"),
        F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"), F.contains("line", F.lit(":")).alias("has_value"),
    )


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """``(host, pattern)``: disallowed patterns of the groups for all agents or the given one.

    A group belongs to the last user-agent line before it; Allow lines are not read.
    """
    lines = _lines(files)
    running = Window.partitionBy("host").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    grouped = lines.withColumn("agent", F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True).over(running))
    rules = grouped.where((F.col("key") == "disallow") & (F.col("value") != "") & F.col("agent").isin("*", agent.lower()))
    return rules.select("host", F.col("value").alias("rule"), pattern_of(F.col("value")).alias("pattern"))


def pattern_of(rule: Column) -> Column:
    """A rule as an anchored pattern: ``*`` is any text, a final ``$`` the end."""
    literal = F.regexp_replace(rule, r"([.+?()\[\]{}|^\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")))


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths(host, path)`` that no rule of their host matches."""
    p, r = paths.alias("p"), rules.alias("r")
    return p.join(r, (F.col("p.host") == F.col("r.host")) & F.expr("p.path rlike r.pattern"), "left_anti")


def sitemap_locations(files: DataFrame) -> DataFrame:
    """``files(host, content)`` → ``(host, loc)``."""
    found = F.regexp_extract_all("content", F.lit(r"(?i)<loc>\s*(https?://[^\s<]+)\s*</loc>"), 1)
    return files.select("host", F.explode(found).alias("loc"))


def llms_sections(files: DataFrame) -> DataFrame:
    """``(host, section, agents, allows, disallows)``: consecutive user-agent lines open one section."""
    order = Window.partitionBy("host").orderBy("at")
    lines = _lines(files).withColumn("opens", (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent"))
    numbered = lines.withColumn("section", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pick = lambda key: F.array_sort(F.collect_list(F.when(F.col("key") == key, F.col("value"))))
    return numbered.where("section > 0").groupBy("host", "section").agg(
        pick("user-agent").alias("agents"), pick("allow").alias("allows"), pick("disallow").alias("disallows")
    )


def llms_errors(files: DataFrame) -> DataFrame:
    """``(host, line)``: numbers of lines that are no ``key: value``."""
    return _lines(files).where("not has_value").select("host", (F.col("at") + 1).alias("line"))


def bot_status(sections: DataFrame, bot: str) -> DataFrame:
    """``(host, status)``: the bot's own section, else that for all; allowed if it allows anything, else disallowed if it disallows."""
    own, any_ = F.exists("agents", lambda a: F.lower(a) == bot.lower()), F.array_contains("agents", "*")
    ranked = sections.where(own | any_).withColumn("rank", F.when(own, 2).otherwise(1))
    status = F.when(F.size("allows") > 0, "allowed").when(F.size("disallows") > 0, "disallowed").otherwise("implicit")
    return ranked.groupBy("host").agg(F.max_by(status, F.struct("rank", -F.col("section"))).alias("status"))


def backlink_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(source_url, target_url, anchor_text)`` of an export whose headers vary."""
    names = {
        "source_url": ("linkingpage", "sourceurl", "source", "referringpage", "url"),
        "target_url": ("targeturl", "target", "targetpage", "destination"),
        "anchor_text": ("anchortext", "anchor", "linktext"),
    }
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in raw.columns}
    found = {k: next((plain[n] for n in ns if n in plain), None) for k, ns in names.items()}
    return raw.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()))
