"""Link graph: degrees, PageRank, authority, hubs, crawl depth and class closure.

The iterative operators are DataFrame joins with the lineage cut by reliable
checkpoints; the one-row dangling mass and the convergence test are the only
values that reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.operators import ontology
from sitegrain.plans.dialect import DUCK, SPARK, Dialect, plan
from sitegrain.plans.stored import materialise, shared_dir

DAMPING, ITERATIONS, TOLERANCE = 0.85, 20, 1e-4


def _cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's folder; persisted first, so that it is computed once."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    kept = df.persist()
    cut = kept.checkpoint()
    kept.unpersist()
    return cut


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """``nodes(url)``, ``edges(source, target)`` → ``(url, rank)``; ranks start at 1 and sum to the number of nodes.

    Repeated edges count once; dangling mass is spread evenly; edges to
    unknown nodes lose their mass; it stops once ranks move less than the
    tolerance in sum.
    """
    nodes, edges = nodes.distinct(), edges.distinct()
    out = edges.groupBy("source").agg(F.count("*").alias("degree"))
    links = _cut(edges.join(nodes, edges.target == nodes.url, "left_semi").join(out, "source"))
    ranks = _cut(nodes.join(out, nodes.url == out.source, "left").select("url", F.lit(1.0).alias("rank"), F.col("degree").isNull().alias("dangling")))
    n = ranks.count()
    for i in range(iterations):
        if not n:
            break
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = links.join(ranks, links.source == ranks.url).groupBy("target").agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        base = (1 - damping) + damping * lost / n
        moved = ranks.join(given, ranks.url == given.target, "left").select(
            "url", (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("next"), "rank", "dangling"
        )
        moved = _cut(moved)
        delta = moved.agg(F.sum(F.abs(F.col("next") - F.col("rank")))).first()[0]
        ranks = moved.select("url", F.col("next").alias("rank"), "dangling")
        if delta < tolerance:
            break
    return ranks.select("url", "rank")


def crawl_depth(edges: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """``(url, depth)`` by breadth-first rounds from the start pages (depth 1)."""
    seen = _cut(start.select("url", F.lit(1).alias("depth")).distinct())
    frontier = seen
    for depth in range(2, max_depth + 1):
        reached = edges.join(frontier, edges.source == frontier.url).select(F.col("target").alias("url")).distinct()
        frontier = _cut(reached.join(seen, "url", "left_anti").select("url", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen = _cut(seen.union(frontier))
    return seen


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation → supplier nation: a graph that the star schema holds."""
    read = lambda t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")
    return (
        read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").cast("string").alias("source"), F.col("s_nationkey").cast("string").alias("target")).distinct()
    )


def gra02_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("url"))
    ranks = pagerank(nodes, order_edges(spark, sf_dir))
    return ranks.select("url", F.round("rank", 6).alias("rank"))


def _edges_sql() -> str:
    return """edges as (select distinct cast(c_nationkey as varchar) as source, cast(s_nationkey as varchar) as target
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey),
    nodes as (select cast(n_nationkey as varchar) as url from nation)"""


def _pagerank_sql(ctes: str, rounds: int = ITERATIONS, tolerance: float = TOLERANCE) -> str:
    """WITH entries up to ``ranks``, over ``nodes``, ``edges``: all rounds unrolled, of which the first that moves less than the tolerance counts."""
    out = f"""{ctes}, links as materialized (select e.source, e.target from edges e join nodes v on e.target = v.url),
    out_degrees as materialized (select source, cast(count(*) as double) as degree from edges group by source), n as materialized (select cast(count(*) as double) as n from nodes),
    r0 as materialized (select url, 1e0 as rank from nodes)"""
    for i in range(rounds):
        out += f""", r{i + 1} as materialized (
      select v.url, 0.15e0 + 0.85e0 * (select coalesce(sum(rank), 0e0) from r{i} where url not in (select source from out_degrees)) / (select n from n) + 0.85e0 * coalesce(g.given, 0e0) as rank
      from nodes v left join (select l.target, sum(r.rank / o.degree) as given from links l join out_degrees o on o.source = l.source join r{i} r on r.url = l.source group by l.target) g on g.target = v.url)"""
    every = " union all ".join(f"select {i} as i, url, rank from r{i}" for i in range(rounds + 1))
    return out + f""", rounds as materialized ({every}),
    moves as (select a.i, sum(abs(a.rank - b.rank)) as delta from rounds a join rounds b on a.url = b.url and b.i = a.i - 1 group by a.i),
    last_round as (select coalesce(min(case when delta < {tolerance} then i end), {rounds}) as i from moves),
    ranks as (select url, rank from rounds where i = (select i from last_round))"""


def gra06_bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("0",)], "url string")
    return crawl_depth(order_edges(spark, sf_dir), start).select("url", F.col("depth").cast("bigint").alias("depth"))


_BFS_SQL = f"""with recursive {_edges_sql()}, walk(url, depth) as (
  select '0', cast(1 as bigint) union select e.target, w.depth + 1 from walk w join edges e on e.source = w.url where w.depth < 10)
  select url, min(depth) as depth from walk group by url"""

QUERIES = {"gra02_pagerank": gra02_pagerank, "gra06_bfs_depth": gra06_bfs_depth}
ORACLE_SQL = {"gra02_pagerank": f"with {_pagerank_sql(_edges_sql())} select url, round(rank, 6) as rank from ranks", "gra06_bfs_depth": _BFS_SQL}


def host_edges(d: Dialect) -> str:
    """Bipartite graph of pages' hosts and all links on them."""
    return f"""base as (select page_id, lower({d.rx('url', r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)')}) as host, {d.explode(d.all("coalesce(html, '')", r'(?is)<a\s[^>]*href="([^"]*)"'))} as href from pages),
    edges as (select distinct host as source, concat(host, href) as target from base),
    nodes as (select source as url from edges union select target from edges)"""


@plan("gra01_degrees", "pages")
def gra01(d: Dialect) -> str:
    return f"""with {host_edges(d)}, outs as (select source as url, count(distinct target) as n from edges group by source), ins as (select target as url, count(distinct source) as n from edges group by target)
    select v.url, {d.big('coalesce(i.n, 0)')} as in_degree, {d.big('coalesce(o.n, 0)')} as out_degree, coalesce(i.n, 0) = 0 as is_orphan
    from nodes v left join ins i on v.url = i.url left join outs o on v.url = o.url"""


def authority(ranks: DataFrame) -> DataFrame:
    """``ranks(url, rank)`` → ``(url, authority)``: 1 to 100 by the largest rank."""
    top = max(ranks.agg(F.max("rank")).first()[0] or 0.0, 1e-4)
    return ranks.select("url", F.floor(1 + 99 * F.col("rank") / top + 0.5).cast("bigint").alias("authority"))


def gra03_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = f"pages as (select * from parquet.`{sf_dir.rstrip('/')}/pages.parquet`)"
    nodes, edges = (spark.sql(f"with {scan}, {host_edges(SPARK)} select * from {t}") for t in ("nodes", "edges"))
    return authority(pagerank(nodes, edges))


QUERIES["gra03_authority"] = gra03_authority
ORACLE_SQL["gra03_authority"] = f"""with {_pagerank_sql(host_edges(DUCK))}, top as (select greatest(max(rank), 1e-4) as top from ranks)
    select url, cast(floor(1 + 99 * rank / top + 0.5e0) as bigint) as authority from ranks cross join top"""


@plan("gra04_hubs", "pages")
def gra04(d: Dialect) -> str:
    """The five largest by outgoing links and the five largest by incoming ones."""
    top = lambda kind, col: f"select '{kind}' as kind, url, n from (select {col} as url, count(*) as n from edges group by {col} order by n desc, url limit 5) t"
    return f"""with {host_edges(d)}, tops as ({top('hub', 'source')} union all {top('authority', 'target')})
    select kind, url, {d.big('n')} as degree, {d.big('row_number() over (partition by kind order by n desc, url)')} as rn from tops"""


@plan("agg13_graph_metrics", "pages")
def agg13(d: Dialect) -> str:
    return f"""with {host_edges(d)}, ins as (select distinct target as url from edges)
    select count(*) as n_nodes, {d.big('sum(case when i.url is null then 1 else 0 end)')} as n_orphans from nodes v left join ins i on v.url = i.url"""


@plan("gra10_link_sets", "pages")
def gra10(d: Dialect) -> str:
    """Inbound and outbound links as membership rows with the size of each set: a set of any size stays in rows."""
    return f"""with {host_edges(d)}, ins as (select target as url, source as other, 'in' as direction from edges), outs as (select source as url, target as other, 'out' as direction from edges),
    both as (select * from ins union all select * from outs), sizes as (select url, direction, count(*) as n from both group by url, direction)
    select b.url, b.direction, b.other, s.n as set_size from both b join sizes s on b.url = s.url and b.direction = s.direction""".replace("both as", "members as").replace("from both", "from members")


def _closure(d: Dialect) -> str:
    return """with recursive sub_class(child, parent) as (
      select concat('c', cast(c_custkey as varchar(20))), concat('n', cast(c_nationkey as varchar(20))) from customer
      union all select concat('n', cast(n_nationkey as varchar(20))), concat('r', cast(n_regionkey as varchar(20))) from nation),
    closure(child, ancestor, depth) as (select child, parent, 1 from sub_class union all select c.child, s.parent, c.depth + 1 from closure c join sub_class s on c.ancestor = s.child)
    select child, ancestor, cast(depth as bigint) as depth from closure"""


def paths_up(edges: DataFrame) -> DataFrame:
    """``edges(child, parent)`` without cycles → ``(child, ancestor, depth)``: a row for every path, one level a round, until a level is empty."""
    edges, levels = materialise(edges, "edges"), []
    level = edges.select("child", F.col("parent").alias("ancestor"))
    while not (level := materialise(level, "level")).isEmpty():
        levels.append(level.withColumn("depth", F.lit(len(levels) + 1).cast("bigint")))
        steps = edges.select(F.col("child").alias("ancestor"), "parent").join(level.select("ancestor").distinct(), "ancestor", "left_semi")
        level = level.join(steps, "ancestor").select("child", F.col("parent").alias("ancestor"))
    return reduce(DataFrame.union, levels or [level.withColumn("depth", F.lit(1).cast("bigint"))])


def gra09_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under nations under regions."""
    read = lambda t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    customers = read("customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    return paths_up(customers.union(read("nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))))


QUERIES["gra09_ontology_closure"] = gra09_closure
ORACLE_SQL["gra09_ontology_closure"] = _closure(None)


def gra09_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of classes made from parts: two parents each (a diamond at every step) and a cycle at the top; a brand is a property of the first part that has it."""
    parts = spark.read.parquet(f"{sf_dir.rstrip('/')}/part.parquet").where("p_partkey is not null")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    k = F.col("p_partkey")
    parents = F.when(k > 3, F.array(F.floor(k / 2), F.floor(k / 3))).otherwise(F.array(k % 3 + 1))
    edges = parts.select(name(k).alias("child"), F.explode(parents).alias("parent")).select("child", name(F.col("parent")).alias("parent"))
    stated = parts.groupBy(F.col("p_brand").alias("property")).agg(F.min("p_partkey").alias("k")).select(name(F.col("k")).alias("class"), "property")
    return ontology.inherited_along(edges, stated)


QUERIES["gra09_inherited_properties"] = gra09_inherited
ORACLE_SQL["gra09_inherited_properties"] = """with recursive e as (select p_partkey as child, unnest(case when p_partkey > 3 then [p_partkey // 2, p_partkey // 3] else [p_partkey % 3 + 1] end) as parent from part),
  up(class, origin) as (select child, parent from e union select u.class, e.parent from up u join e on u.origin = e.child),
  s as (select p_brand as property, min(p_partkey) as k from part group by 1), w as (select class, origin from up union select k, k from s)
  select 'c' || class as class, property, count(distinct origin) as n_origins from w join s on s.k = w.origin group by 1, 2"""
