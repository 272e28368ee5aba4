"""One relational plan, two SQL dialects: Spark runs it, DuckDB checks it.

Patterns stay in the subset that Java's and RE2's engines share and hold no
single quote (write ``\\x27``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sitegrain.plans.stored import once

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps",
)


class Dialect:
    """The functions whose spelling differs."""

    name = ""

    def lit(self, pattern: str) -> str:
        raise NotImplementedError

    def rx(self, col: str, pattern: str, group: int = 1) -> str:
        """First match's group, '' without one."""
        return f"regexp_extract({col}, {self.lit(pattern)}, {group})"

    def all(self, col: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({col}, {self.lit(pattern)}, {group})"

    def count(self, col: str, pattern: str) -> str:
        return self.big(self.size(self.all(col, pattern, 0)))

    def big(self, x: str) -> str:
        return f"cast({x} as bigint)"

    def once(self, x: str) -> str:
        """``x`` as a column that later expressions read instead of repeating it, for arrays used inside lambdas."""
        return x

    def merged(self, *names: str) -> str:
        """What stands after SELECT so that joins with these relations sort both sides.

        Spark takes a file's size for that of its rows; page rows and findings compress so well
        that it would gather millions of them on the driver to broadcast them.
        """
        return ""


class SparkSql(Dialect):
    name = "spark"

    def lit(self, pattern: str) -> str:
        return f"r'{pattern}'"

    def once(self, x: str) -> str:
        return f"if(monotonically_increasing_id() >= 0, {x}, null)"  # the optimizer doesn't inline what depends on the row's number

    def merged(self, *names: str) -> str:
        return f"/*+ merge({', '.join(names)}) */ " if names else ""

    def has(self, col: str, pattern: str) -> str:
        return f"({col} rlike {self.lit(pattern)})"

    def repl(self, col: str, pattern: str, to: str) -> str:
        return f"regexp_replace({col}, {self.lit(pattern)}, '{to}')"

    def size(self, x: str) -> str:
        return f"size({x})"

    def split(self, col: str, pattern: str) -> str:
        return f"split({col}, {self.lit(pattern)})"

    def explode(self, x: str) -> str:
        return f"explode({x})"

    def explode_at(self, x: str, at: str, value: str) -> str:
        return f"posexplode({x}) as ({at}, {value})"

    def filter(self, x: str, var: str, cond: str) -> str:
        return f"filter({x}, {var} -> {cond})"

    def map(self, x: str, var: str, to: str) -> str:
        return f"transform({x}, {var} -> {to})"

    def distinct(self, x: str) -> str:
        return f"array_distinct({x})"

    def sorted_list(self, x: str) -> str:
        return f"array_join(array_sort(collect_list(cast({x} as string))), '|')"

    def seq(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def bytes(self, x: str) -> str:
        return f"cast(octet_length({x}) as bigint)"

    def overlap(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def at(self, x: str, i: str) -> str:
        return f"get({x}, {i})"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, '{sep}')"

    def hash(self, x: str) -> str:
        return f"md5({x})"


class DuckSql(Dialect):
    name = "duckdb"

    def lit(self, pattern: str) -> str:
        return f"'{pattern}'"

    def has(self, col: str, pattern: str) -> str:
        return f"regexp_matches({col}, {self.lit(pattern)})"

    def repl(self, col: str, pattern: str, to: str) -> str:
        return f"regexp_replace({col}, {self.lit(pattern)}, '{to}', 'g')"

    def size(self, x: str) -> str:
        return f"len({x})"

    def split(self, col: str, pattern: str) -> str:
        return f"regexp_split_to_array({col}, {self.lit(pattern)})"

    def explode(self, x: str) -> str:
        return f"unnest({x})"

    def explode_at(self, x: str, at: str, value: str) -> str:
        return f"unnest(range(len({x}))) as {at}, unnest({x}) as {value}"

    def filter(self, x: str, var: str, cond: str) -> str:
        return f"list_filter({x}, lambda {var}: {cond})"

    def map(self, x: str, var: str, to: str) -> str:
        return f"list_transform({x}, lambda {var}: {to})"

    def distinct(self, x: str) -> str:
        return f"list_distinct({x})"

    def sorted_list(self, x: str) -> str:
        return f"array_to_string(list_sort(list(cast({x} as varchar))), '|')"

    def seq(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def bytes(self, x: str) -> str:
        return f"cast(octet_length(encode({x})) as bigint)"

    def overlap(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def at(self, x: str, i: str) -> str:
        return f"{x}[{i} + 1]"

    def join(self, x: str, sep: str) -> str:
        return f"array_to_string({x}, '{sep}')"

    def hash(self, x: str) -> str:
        return f"md5({x})"


SPARK, DUCK = SparkSql(), DuckSql()


def _added(table: str, columns: list[str]) -> str:
    """The capture columns that a table of pages lacks."""
    if table != "pages":
        return ""
    have = {c.lower() for c in columns}
    return "".join(f", {default} as {c}" for c, default in CAPTURE_COLUMNS.items() if c not in have)


def _with(scans: str, text: str) -> str:
    body = text.strip()
    return f"with {scans}, {body[5:]}" if body.lower().startswith("with ") else f"with {scans} {body}"


def over(spark: SparkSession, frames: dict[str, DataFrame], text: str) -> DataFrame:
    """A plan's text over DataFrames instead of files, as for a micro-batch; the names are those of its tables."""
    names = {n: f"_{n}_{uuid.uuid4().hex}" for n in frames}
    for n, df in frames.items():
        df.createOrReplaceTempView(names[n])
    try:
        return spark.sql(_with(", ".join(f"{n} as (select *{_added(n, df.columns)} from {names[n]})" for n, df in frames.items()), text))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def _unread(text: str, mark: str) -> bool:
    """Whether a stored table stands only in a WITH entry of its own that nothing else in the text names."""
    entry = re.search(rf"(\w+) as \(select \* from {re.escape(mark)}\)", text)
    return entry is not None and text.count(mark) == 1 and len(re.findall(rf"\b{entry[1]}\b", text.replace(mark, ""))) == 1


@dataclass(frozen=True)
class Plan:
    """A query: ``build(dialect)`` is a WITH list and a SELECT over the tables of TABLES."""

    build: Callable[[Dialect], str]
    tables: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """Tables named ``{{name}}`` in the text are written once by their entry in STORED and then read, by later queries too."""
        text = self.build(SPARK)
        for name, needed in STORED.items():
            if (mark := "{{" + name + "}}") in text:
                if _unread(text, mark):
                    text = text.replace(mark, "values (0)")
                    continue
                files = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in needed.tables]
                text = text.replace(mark, f"parquet.`{once(spark, name, files, lambda n=needed: n.run(spark, sf_dir))}`")
        scans = []
        for t in self.tables:
            path = f"{sf_dir.rstrip('/')}/{t}.parquet"
            added = _added(t, spark.read.parquet(path).columns if t == "pages" else [])
            scans.append(f"{t} as (select *{added} from parquet.`{path}`)")
        return spark.sql(_with(", ".join(scans), text))

    def sql(self) -> str:
        return self.build(DUCK)


#: Columns that a capture may add to a table, and what stands for them where it doesn't.
CAPTURE_COLUMNS = {
    "status_code": "cast(200 as bigint)", "load_ms": "cast(0 as bigint)", "depth": "cast(null as bigint)", "robots_txt_found": "cast(null as boolean)", "sitemap_xml_found": "cast(null as boolean)",
    **{h: "cast(null as string)" for h in (
        "h_csp", "h_csp_report", "h_hsts", "h_xfo", "h_xcto", "h_referrer", "h_permissions", "h_coop", "h_coep", "h_corp", "h_server", "h_powered", "h_cookie", "h_cache", "h_etag",
    )},
}


PLANS: dict[str, Plan] = {}


@dataclass(frozen=True)
class Made:
    """A stored table that DataFrame code makes, ``make(spark, sf_dir)``."""

    make: Callable[[SparkSession, str], DataFrame]
    tables: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.make(spark, sf_dir)


#: Tables that Spark writes before the queries that read them, the later after the earlier; DuckDB's text holds them inline.
STORED: dict[str, Plan | Made] = {}


def plan(name: str, *tables: str):
    """Registers a plan under a query name."""

    def add(build: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
        PLANS[name] = Plan(build, tables)
        return build

    return add
