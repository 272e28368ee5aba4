"""A class hierarchy as tables: its closure, inherited properties, and whether one class is under another.

Inherited properties need no closure: only the classes that state something are
handed down, a step a round, and a round takes what the last one added. So the
rows made are those of the result times the number of parents, in as many
rounds as the hierarchy is deep.

The closure doubles the length of its paths each round and ends when a round
adds nothing, so it takes the logarithm of the depth in rounds, and a cycle
ends it like any other path. Every pair is kept once, however many ways lead to
it. Each round is written, so a lost executor costs one round at most.

Defined results: null and empty names are no classes; repeated rows count once;
a class of a cycle is above itself; a class that is only named as a parent has
no properties of its own but is an ancestor; an empty table gives an empty
closure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.plans.stored import materialise, written


def clean_uri(c: Column) -> Column:
    """One scheme for the vocabulary's own names."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("http://schema.org/"), F.lit("https://schema.org/"))


def _ids(text: Column) -> Column:
    """Ids of a JSON value that is one reference, a list of them, or missing."""
    one = F.get_json_object(text, "$.@id")
    many = F.from_json(text, "array<struct<`@id`:string>>")
    found = F.when(text.startswith("["), F.transform(many, lambda x: x["@id"])).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(found, clean_uri), lambda x: x != "")


def entries(definitions: DataFrame) -> DataFrame:
    """``definitions(json)``, JSON-LD graphs → ``(id, is_class, is_property, parents, domains)`` of every entry; unreadable text has none."""
    items = definitions.select(F.explode(F.from_json(F.get_json_object("json", "$.@graph"), "array<string>")).alias("x"))
    field = lambda name: F.get_json_object("x", f"$['{name}']")
    has = lambda kind: F.coalesce((field("@type") == kind) | field("@type").contains(f'"{kind}"'), F.lit(False))
    domains = F.array_union(_ids(F.coalesce(field("http://schema.org/domainIncludes"), field("domainIncludes"))), F.array().cast("array<string>"))
    return items.select(clean_uri(field("@id")).alias("id"), has("rdfs:Class").alias("is_class"), has("rdf:Property").alias("is_property"), _ids(field("rdfs:subClassOf")).alias("parents"), domains.alias("domains")).where("id <> ''")


def sub_classes(found: DataFrame) -> DataFrame:
    """``(child, parent)``."""
    return found.where("is_class").select(F.col("id").alias("child"), F.explode("parents").alias("parent")).distinct()


def properties(found: DataFrame) -> DataFrame:
    """``(class, property)`` as stated."""
    return found.where("is_property and not is_class").select(F.explode("domains").alias("class"), F.col("id").alias("property")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """``edges(child, parent)`` → ``(child, ancestor)``, every pair that a path joins."""
    known = edges.where("child <> '' and parent <> ''").select("child", F.col("parent").alias("ancestor")).distinct()
    known, n = materialise(known, "closure"), -1
    while n != (n := known.count()):
        further = known.select("child", F.col("ancestor").alias("middle")).join(known.select(F.col("child").alias("middle"), "ancestor"), "middle").select("child", "ancestor")
        known = materialise(known.union(further).distinct(), "closure")
    return known


def inherited(above: DataFrame, stated: DataFrame) -> DataFrame:
    """``above`` (a closure), ``stated(class, property)`` → ``(class, property, n_origins)``: own and inherited properties, each once, with how many classes state it."""
    own = stated.select("class", "property", F.col("class").alias("origin"))
    down = above.select(F.col("child").alias("class"), F.col("ancestor").alias("origin")).join(stated.withColumnRenamed("class", "origin"), "origin").select("class", "property", "origin")
    return own.union(down).distinct().groupBy("class", "property").agg(F.count("*").alias("n_origins"))


def handed_down(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """``edges(child, parent)``, ``origins(class)`` → ``(class, origin)``: the origins that are the class or above it, each pair once."""
    steps = materialise(edges.where("child <> '' and parent <> ''").select("child", F.col("parent").alias("class")).distinct(), "steps")
    first = origins.select("class", F.col("class").alias("origin")).distinct()
    read = lambda *paths: first.sparkSession.read.schema(first.schema).parquet(*paths)
    paths = [written(first, "pairs")]
    while not (last := read(paths[-1])).isEmpty():
        reached = last.join(steps, "class").select(F.col("child").alias("class"), "origin", F.lit(True).alias("new"))
        seen = reached.unionByName(read(*paths).withColumn("new", F.lit(False)))
        paths.append(written(seen.groupBy("class", "origin").agg(F.every("new").alias("new")).where("new").select("class", "origin"), "pairs"))
    return read(*paths)


def inherited_along(edges: DataFrame, stated: DataFrame) -> DataFrame:
    """The rows of ``inherited`` from ``edges(child, parent)``, without a closure."""
    stated = stated.select("class", "property").distinct()
    pairs = handed_down(edges, stated.select("class").distinct())
    return pairs.join(stated.withColumnRenamed("class", "origin"), "origin").groupBy("class", "property").agg(F.count("*").alias("n_origins"))


def under(pairs: DataFrame, above: DataFrame) -> DataFrame:
    """``pairs(child, parent)`` with ``holds``: the same class, or one above; names may stand without the vocabulary's address."""
    full = lambda c: F.when(F.col(c).contains("://") | F.col(c).contains(":"), F.col(c)).otherwise(F.concat(F.lit("https://schema.org/"), F.col(c)))
    known = above.select("child", "ancestor").union(above.select(F.regexp_replace("child", "^https://schema.org/", ""), F.regexp_replace("ancestor", "^https://schema.org/", "")).where("not child like '%:%'"))
    known = known.select(full("child").alias("_child"), full("ancestor").alias("_ancestor")).distinct()
    found = pairs.withColumn("_c", full("child")).withColumn("_p", full("parent")).join(known, (F.col("_c") == F.col("_child")) & (F.col("_p") == F.col("_ancestor")), "left")
    return found.select(*pairs.columns, (F.col("_child").isNotNull() | (F.col("child") == F.col("parent"))).alias("holds"))
