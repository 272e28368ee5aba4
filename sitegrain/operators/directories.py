"""Listings of a business in directories: record linkage by blocks, then weighted evidence.

A listing can only be validated for a source through its website, its phone
number or its name, so candidates meet in equi-joins on the registered domain,
on the last ten digits and on name tokens. A name match needs three quarters of
the source's tokens; of each source only its rarest tokens, as many as a match
can't all miss, are blocks, so that a word that many names hold brings no pairs.
Nothing that can be validated is lost, and each pair is judged once.

Defined results: a source without a token, number or website finds nothing;
null fields are missing ones; a listing that repeats is judged like any other
and the best of a source and directory is the one of greatest confidence, then
of least URL; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing in a name, weights and thresholds of the evidence.
NAME_STOP_WORDS = ("the", "and", "for", "of", "inc", "llc", "co", "company", "corp", "corporation", "clinic", "center", "services", "service", "group", "healthcare")
WEBSITE, PHONE, NAME, ADDRESS, OWN_LINK = 0.55, 0.25, 0.15, 0.1, 0.1
NAME_MATCH, ADDRESS_MATCH, NAME_ENOUGH, ADDRESS_ENOUGH = 0.75, 0.65, 0.6, 0.5


def digits(phone: Column) -> Column:
    """The last ten digits of a number; null if there is none."""
    return F.nullif(F.right(F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", ""), F.lit(10)), F.lit(""))


def registered_domain(url: Column) -> Column:
    """The last two labels of a URL's host; null if it has none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.filter(F.split(F.regexp_replace(host, r"^www\.", ""), r"\."), lambda x: x != "")
    return F.nullif(F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), "."), F.lit(""))


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of two ASCII letters or digits and more, without stop words."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"))
    words = F.filter(words, lambda w: F.length(w) > 1)
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def overlap(source: Column, candidate: Column) -> Column:
    """Share of the source's tokens that the candidate has."""
    return F.when((F.size(source) > 0) & (F.size(candidate) > 0), F.size(F.array_intersect(source, candidate)) / F.size(source)).otherwise(0.0)


def _prepared(sources: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = sources.select("source_id", "name", "phone", "address", "website", digits(F.col("phone")).alias("s_phone"), registered_domain(F.col("website")).alias("s_site"), tokens(F.col("name"), NAME_STOP_WORDS).alias("s_name"), tokens(F.col("address")).alias("s_address"))
    sites = F.array_distinct(F.filter(F.transform(F.concat(F.array("website"), F.coalesce("links", F.array().cast("array<string>"))), registered_domain), lambda x: x.isNotNull()))
    text = lambda *cols: F.concat_ws(" ", *cols)
    listed = listings.select(
        "directory", F.col("url").alias("listing_url"), F.col("name").alias("listing_name"), F.coalesce("own_link", F.lit(False)).alias("own_link"), digits(F.col("phone")).alias("l_phone"), digits(F.col("snippet")).alias("l_snippet"),
        sites.alias("l_sites"), tokens(text("name", "title"), NAME_STOP_WORDS).alias("l_name"), tokens(text("address", "snippet")).alias("l_address"),
    )
    return s, listed.withColumn("listing", F.monotonically_increasing_id())


def _candidates(s: DataFrame, listed: DataFrame) -> DataFrame:
    """``(source_id, listing)`` that share a domain, a number or one of the source's rarest name tokens."""
    words = s.select("source_id", F.size("s_name").alias("n"), F.explode("s_name").alias("key"))
    often = listed.select(F.explode("l_name").alias("key")).groupBy("key").agg(F.count("*").alias("often"))
    ranked = words.join(often, "key").groupBy("source_id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("by"))  # a name's tokens, in one row
    # Of n tokens a match has ceil(0.75 n), so it can't miss more than the others: one of the next rarest is shared, tokens of no listing included.
    spare = F.col("n") - F.ceil(F.col("n") * NAME_MATCH) + 1 - (F.col("n") - F.size("by"))
    keys = ranked.where(spare > 0).select("source_id", F.explode(F.slice("by", F.lit(1), spare.cast("int"))).alias("k")).select("source_id", F.concat(F.lit("n:"), "k.key").alias("key"))
    mark = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(kind), c))
    keys = keys.union(s.select("source_id", F.explode(F.array(mark("p:", "s_phone"), mark("s:", "s_site"))).alias("key")).where("key is not null"))
    own = F.concat(F.transform("l_name", lambda w: F.concat(F.lit("n:"), w)), F.transform("l_sites", lambda w: F.concat(F.lit("s:"), w)), F.array(mark("p:", "l_phone"), mark("p:", "l_snippet")))
    blocks = listed.select("listing", F.explode(F.array_distinct(F.filter(own, lambda k: k.isNotNull()))).alias("key"))
    return keys.join(blocks, "key").select("source_id", "listing").distinct()


def evidence(sources: DataFrame, listings: DataFrame) -> DataFrame:
    """``sources(source_id, name, phone, address, website)``, ``listings(directory, url, name, phone, address, website, links, title, snippet, own_link)`` → the validated pairs with scores, confidence and status."""
    s, listed = _prepared(sources, listings)
    both = _candidates(s, listed).join(s, "source_id").join(listed, "listing")
    site = F.coalesce(F.array_contains("l_sites", F.col("s_site")), F.lit(False))
    phone = F.coalesce((F.col("s_phone") == F.col("l_phone")), F.lit(False)) | F.coalesce(F.col("s_phone") == F.col("l_snippet"), F.lit(False))
    both = both.select("source_id", "directory", "listing_url", "listing_name", "own_link", "s_phone", "l_phone", site.alias("website_match"), phone.alias("phone_match"), overlap(F.col("s_name"), F.col("l_name")).alias("name_score"), overlap(F.col("s_address"), F.col("l_address")).alias("address_score"))
    valid = F.col("website_match") | (F.col("phone_match") & ((F.col("name_score") >= NAME_ENOUGH) | (F.col("address_score") >= ADDRESS_ENOUGH))) | ((F.col("name_score") >= NAME_MATCH) & (F.col("address_score") >= ADDRESS_MATCH))
    points = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    confidence = F.least(F.lit(1.0), points("website_match", WEBSITE) + points("phone_match", PHONE) + F.col("name_score") * NAME + F.col("address_score") * ADDRESS + points("own_link", OWN_LINK))
    wrong_name = (F.coalesce("listing_name", F.lit("")) != "") & (F.col("name_score") < NAME_ENOUGH)
    wrong_phone = F.coalesce(F.col("s_phone") != F.col("l_phone"), F.lit(False))
    status = (
        F.when(wrong_name & wrong_phone, "Wrong Business Name, Wrong Phone Number").when(wrong_name, "Wrong Business Name").when(wrong_phone, "Wrong Phone Number")
        .when(F.col("s_phone").isNotNull() & F.col("l_phone").isNull(), "No Phone Number").otherwise("Issues not found")
    )
    return both.where(valid).select("source_id", "directory", "listing_url", "website_match", "phone_match", "name_score", "address_score", F.round(confidence, 6).alias("confidence"), status.alias("status"))


def best(found: DataFrame) -> DataFrame:
    """Of each source and directory the listing of greatest confidence."""
    order = F.struct((-F.col("confidence")).alias("c"), "listing_url")
    rest = [c for c in found.columns if c not in ("source_id", "directory")]
    return found.groupBy("source_id", "directory").agg(F.min_by(F.struct(*rest), order).alias("b")).select("source_id", "directory", "b.*")
