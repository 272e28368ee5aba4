"""Keyword research over suggestions: normalising, noise, intent, scores, topics and clusters.

``suggestions(keyword, source, idx, seq)``: source is direct, semantic, question or alphabetical, idx the place in its
answer, seq the order of arrival. Everything is native expressions; clusters are one window and two aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain.functions.scalars import topic_key, topic_label

#: Word lists of the noise rules, the intents, the topic buckets and the niches; points of noise and intents.
SUFFIXES = "inc llc ltd corp corporation company hospital foundation".split()
ORGANIZATIONS = "department agency association foundation university county state city office bureau commission administration authority district".split()
OF = ("department of", "office of", "state of", "city of")
DIRECTORIES = ("healthgrades", "zocdoc", "psychology today", "webmd", "yelp", "glassdoor", "indeed", "linkedin", "yellow pages", "superpages", "bbb")
NAVIGATION = "reviews review address phone login portal hours directions map".split()
BRAND_HEADS = "crm software platform app apps shoes sneakers hosting analytics erp cms pricing login reviews alternatives".split()
BRAND_GENERIC = "best top guide how free cheap enterprise small business online for with".split()
JOBS = (
    "job jobs career careers salary hiring vacancy vacancies internship internships resume employment employer recruitment recruiter positions openings degree "
    "certification training license licensing"
).split()
LOCAL = ("near me", "nearby", "local", "in my area", "address", "phone number", "location", "locations", "directions", "map", "hours", "open now", "zip code", "postal code")
LOCAL_PLACES = r"(?i)\bin\s+[a-z]{2}\b|\b(nyc|la|boston|chicago|miami|houston|seattle|austin|denver|dallas|phoenix|atlanta|philadelphia|detroit)\b"
BUYING = (
    "buy purchase order hire consult book appointment services service agency provider providers clinic clinics shop online enroll register class classes course courses "
    "program programs center centers facility facilities therapist therapists hospital hospitals"
).split()
COMPARING = (
    "best top review reviews vs versus comparison compare alternative alternatives cost costs price pricing packages cheap expensive affordable ratings rated specifications specs"
).split()
INTENT_POINTS = {"transactional": 10, "commercial": 8, "local": 7, "informational": 5, "jobs-career": 1}
SOURCE_POINTS = {"direct": 2, "semantic": 1, "question": 1, "alphabetical": 0}
TOPIC_STOP = "the and for with a of to in on at by an is are about from how why what who where when which or best top new guide tips tip care beginner beginners near me vs versus".split()
BUCKETS = (
    ("services", "Services", "service services provider providers agency agencies"), ("treatment", "Treatment", "treatment therapy therapies rehab"),
    ("clinics", "Clinics", "clinic clinics center centers facility facilities"), ("symptoms", "Symptoms", "symptom symptoms signs"),
    ("disorders", "Disorders", "disorder disorders condition conditions"), ("costs", "Costs", "cost costs price prices pricing insurance"),
    ("reviews", "Reviews", "review reviews ratings rating"), ("comparisons", "Comparisons", "compare comparison comparisons vs versus alternative alternatives"),
)
NICHES = (
    ("Health, Medical & Wellness", "health medical therapy clinic treatment doctor patient hospital wellness disease disorder rehab psychiatrist psychologist counseling medicine care nursing".split()),
    ("Tech, SaaS & Software", ["software", "saas", "app", "tool", "platform", "tech", "api", "cloud", "database", "developer", "security", "code", "programming", "ai", "artificial intelligence", "crm"]),
    ("Finance & Insurance", "finance insurance loan credit bank investment stock crypto mortgage tax wealth savings account financial".split()),
    ("Business, Marketing & Agency", "marketing seo business agency consulting advertising sales growth brand strategy management leads".split()),
    ("E-commerce, Retail & Products", ["buy", "shop", "online", "store", "product", "deal", "discount", "cheap", "best price", "reviews", "purchase", "shipping", "shoes", "sneakers"]),
    ("Real Estate & Property", ["real estate", "property", "house", "apartment", "rent", "sell", "home", "agent", "broker", "mortgage", "listing"]),
    ("Education & Learning", "course learn degree training school class academy tutorial certification study education university".split()),
)
KIND_WEIGHTS = {"pillar": 40, "supporting": 20, "intent": 10, "fallback": -30}
FILTER_AT, FILTER_AT_STRICT = 85, 55


def _lits(words) -> Column:
    return F.array(*map(F.lit, words))


def _round(x: Column) -> Column:
    return F.floor(x + 0.5)


def normal(keyword: Column) -> Column:
    """Lower case; letters, digits, white space and & / + - stay; single spaces. (Compatibility forms are not folded.)"""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(keyword), r"[^\p{L}\p{N}\s&/+-]+", " "), r"\s+", " "))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: t != "")


def _any_token(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, _lits(words))


def _any_phrase(text: Column, phrases) -> Column:
    return F.exists(_lits(phrases), lambda p: text.contains(p))


def _pattern(text: Column, tokens: Column, words) -> Column:
    single, several = [w for w in words if " " not in w], [w for w in words if " " in w]
    hit = _any_token(tokens, single)
    return hit | _any_phrase(text, several) if several else hit


def niche(keyword: Column) -> Column:
    """The first niche of which a word, or a word's beginning after a space, is in the keyword; null without one."""
    text = F.lower(F.trim(keyword))
    tokens, out = F.split(text, r"\s+"), None
    for name, words in NICHES:
        hit = _any_token(tokens, words) | F.exists(_lits(words), lambda w: text.contains(F.concat(F.lit(" "), w)) | text.startswith(F.concat(w, F.lit(" "))))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def deduplicated(suggestions: DataFrame) -> DataFrame:
    """One row a normalised keyword: of the direct source if any, else of the first row's; there the least place, then the first."""
    rows = suggestions.withColumn("normal", normal(F.col("keyword"))).where("normal <> ''")
    own = Window.partitionBy("normal")
    direct_first = F.struct((F.col("source") != "direct").alias("other"), "seq")
    rows = rows.withColumn("_source", F.min_by("source", direct_first).over(own)).where("source = _source")
    rows = rows.withColumn("_n", F.row_number().over(own.orderBy("idx", "seq")))
    return rows.where("_n = 1").drop("_n", "_source")


def with_noise(rows: DataFrame, seed: str, strict: bool = False, keep_brands: bool = False) -> DataFrame:
    """Adds noise (points), allowlisted and filtered to rows of ``deduplicated``."""
    seed_normal = " ".join(seed.lower().split())
    seeds = seed_normal.split()
    branded = len(seeds) >= 2 and any(t in BRAND_HEADS for t in seeds) and any(t not in BRAND_HEADS and t not in BRAND_GENERIC for t in seeds)
    df = rows.withColumn("_t", _tokens(F.col("normal")))
    text, tokens = F.col("normal"), F.col("_t")
    suffix, organization = _any_token(tokens, SUFFIXES), _any_token(tokens, ORGANIZATIONS) | _any_phrase(text, OF)
    directory, navigation = _any_phrase(text, DIRECTORIES), _any_token(tokens, NAVIGATION)
    overlap = F.size(F.filter(tokens, lambda t: t.isin(seeds))) / max(1, len(set(seeds))) if seeds else F.lit(0.0)
    at = F.instr(text, seed_normal) if seeds else F.lit(0)
    before = _tokens(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(""))
    after = _tokens(F.when(at > 0, F.substring(text, at + len(seed_normal), F.length(text))).otherwise(""))
    df = df.select("*", suffix.alias("_suffix"), organization.alias("_org"), directory.alias("_dir"), navigation.alias("_nav"), overlap.alias("_overlap"), before.alias("_before"), after.alias("_after"))
    prefixed = F.size("_before").between(1, 3) & (F.col("_nav") | ((F.size("_after") > 0) & F.forall("_after", lambda t: t.isin(NAVIGATION))))
    entity = F.col("_suffix") | F.col("_org") | F.col("_dir")
    allowed = F.size(F.array_except(_lits(seeds), "_t")) == 0 if branded else F.lit(False)
    points = sum((F.when(c, n).otherwise(0) for c, n in (
        (F.col("_dir"), 50), (F.col("_suffix"), 30), (F.col("_org"), 30), (F.col("_nav"), 25), ((F.size("_t") >= 4) & (F.col("_overlap") <= 0.5), 20), (prefixed, 55), ((F.col("_overlap") == 0) & entity, 15),
    )), start=F.lit(0))
    points = F.when(allowed, F.greatest(F.lit(0), points - 45)).otherwise(points)
    hard = ~allowed & ((points >= (FILTER_AT_STRICT if strict else FILTER_AT)) | (F.col("_nav") & entity) | prefixed)
    out = df.withColumns({"noise": points, "allowlisted": allowed, "filtered": F.lit(False) if keep_brands else hard})
    return out.drop("_t", "_suffix", "_org", "_dir", "_nav", "_overlap", "_before", "_after")


def intent(keyword: Column) -> Column:
    """jobs-career, local, transactional, commercial or informational, the first that fits."""
    text = F.lower(F.trim(keyword))
    tokens = F.split(text, r"\s+")
    near = text.rlike(r" (?:in|at|near|around) ") & text.rlike(LOCAL_PLACES)
    return (
        F.when(_pattern(text, tokens, JOBS), "jobs-career").when(_pattern(text, tokens, LOCAL) | near, "local").when(_pattern(text, tokens, BUYING), "transactional")
        .when(_pattern(text, tokens, COMPARING), "commercial").otherwise("informational")
    )


def scored(rows: DataFrame, seed: str) -> DataFrame:
    """Adds intent and score (0 to 100) to rows with noise: closeness to the seed .6 and worth of the intent .4, less noise."""
    text, seed = F.lower(F.trim("keyword")), seed.lower().strip()
    seeds = seed.split()
    shared = F.size(F.array_intersect(_lits(seeds), F.split(text, r"\s+"))) if seeds else F.lit(0)
    base = F.when(text == seed, 10).when(text.startswith(seed), 9).when(text.contains(seed), 8).otherwise(F.greatest(F.lit(1), _round(shared / max(1, len(seeds)) * 7)))
    source = F.lit(0)
    for k, n in SOURCE_POINTS.items():
        source = F.when(F.col("source") == k, n).otherwise(source)
    topical = F.greatest(F.lit(0), F.least(F.lit(10), base + _round(F.greatest(F.lit(0), 10 - F.col("idx")) / 10 * 2) + source))
    df = rows.withColumn("intent", intent(F.col("keyword")))
    worth = F.lit(4)
    for k, n in INTENT_POINTS.items():
        worth = F.when(F.col("intent") == k, n).otherwise(worth)
    plain = _round((topical * 0.6 + worth * 0.4) * 10)
    penalty = F.when(F.col("allowlisted"), 0).otherwise(_round(F.col("noise") * F.when(F.col("intent") == "commercial", 0.18).otherwise(0.3)))
    return df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), plain - penalty)).cast("int"))


def phrases(keyword: Column, seeds: list[str]) -> Column:
    """Distinct topic words and pairs of neighbours, in the singular, without stop words and the seed's words."""
    words = F.filter(_tokens(keyword), lambda t: ~t.isin(TOPIC_STOP) & ~t.isin(seeds) & (F.length(t) >= 3))
    single = F.transform(words, topic_key)
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: topic_key(F.array_join(F.slice(words, i, 2), " "))))
    pairs = F.filter(F.coalesce(pairs, F.array().cast("array<string>")), lambda p: F.forall(F.split(p, " "), lambda t: F.length(t) >= 3))
    return F.array_distinct(F.concat(single, pairs))


def with_topics(rows: DataFrame, seed: str) -> DataFrame:
    """Adds cluster_key, cluster_name and label_source to scored rows: a bucket's, the best phrase of two keywords and more, or the rest."""
    seeds = seed.lower().split()
    tokens = _tokens(F.col("keyword"))
    hits = [(k, label, F.size(F.array_intersect(tokens, _lits(words.split())))) for k, label, words in BUCKETS]
    order = F.array(*(F.struct((-n).alias("less"), F.lit(i).alias("place"), F.lit(k).alias("key"), F.lit(label).alias("label"), n.alias("n")) for i, (k, label, n) in enumerate(hits)))
    best = F.array_min(F.filter(order, lambda b: b["n"] > 0))
    aside = F.col("intent").isin("local", "jobs-career")
    df = rows.select("*", best.alias("_bucket"), phrases(F.col("keyword"), seeds).alias("_phrases"))
    spread = df.select("normal", F.explode("_phrases").alias("phrase"))
    counts = spread.groupBy("phrase").agg(F.count("*").alias("c")).where("c > 1")
    rank = F.struct(F.when(F.col("phrase").contains(" "), 2).otherwise(1).alias("specific"), "c", F.length("phrase").alias("n"), "phrase")
    chosen = spread.join(counts, "phrase").groupBy("normal").agg(F.max(rank)["phrase"].alias("_phrase"))
    df = df.join(chosen, "normal", "left")
    return df.select(
        *rows.columns,
        F.when(F.col("intent") == "local", "local-care").when(aside, "careers").otherwise(F.coalesce(topic_key(F.col("_bucket.key")), "_phrase", F.lit("general-extensions"))).alias("cluster_key"),
        F.when(F.col("intent") == "local", "Local care").when(aside, "Careers").otherwise(F.coalesce("_bucket.label", topic_label(F.col("_phrase")), F.lit("General extensions"))).alias("cluster_name"),
        F.when(aside, "intent").when(F.col("_bucket").isNotNull(), "semantic-bucket").when(F.col("_phrase").isNotNull(), "phrase").otherwise("fallback").alias("label_source"),
    )


def clusters(rows: DataFrame, seed: str) -> DataFrame:
    """One row a cluster of ``with_topics``: size, means, quality (mean of four measures), kind and weight; see ``ordered``."""
    seeds = seed.lower().split()
    names = rows.groupBy("cluster_key").agg(F.min("cluster_name").alias("name"), F.min("label_source").alias("label_source"))
    df = rows.join(names.withColumnsRenamed({"name": "_name", "label_source": "_label"}), "cluster_key")
    words = F.array_distinct(_tokens(F.col("_name")))
    cohesion = F.size(F.array_intersect(words, F.split(F.lower("keyword"), r"\s+"))) / F.greatest(F.lit(1), F.size(words))
    by_intent = df.groupBy("cluster_key", "intent").agg(F.count("*").alias("c"))
    place = F.lit(0)
    for i, k in enumerate(("informational", "commercial", "transactional", "local", "jobs-career")):
        place = F.when(F.col("intent") == k, -i).otherwise(place)
    main = by_intent.groupBy("cluster_key").agg(F.max("c").alias("most"), F.max_by("intent", F.struct("c", place.alias("p"))).alias("intent"))
    used = df.select("cluster_key", F.explode(F.array_distinct(F.filter(_tokens(F.col("keyword")), lambda t: ~t.isin(seeds)))).alias("t"))
    often = used.groupBy("cluster_key", "t").agg(F.count("*").alias("c")).where("c > 1").groupBy("cluster_key").agg(F.avg("c").alias("often"))
    out = df.groupBy("cluster_key", "_name", "_label").agg(F.count("*").alias("n"), _round(F.avg("score")).alias("average_score"), _round(F.avg(cohesion) * 100).alias("cohesion"))
    out = out.join(main, "cluster_key").join(often, "cluster_key", "left")
    out = out.withColumn("consistency", _round(F.col("most") / F.col("n") * 100)).withColumn("tightness", _round(F.coalesce("often", F.lit(0.0)) / F.col("n") * 100))
    out = out.withColumn("quality", _round((F.col("average_score") + F.col("cohesion") + F.col("consistency") + F.col("tightness")) / 4))
    kind = F.when(F.col("_label").isin("fallback", "intent"), F.col("_label")).when((F.col("n") >= 3) & (F.col("quality") >= 70), "pillar").otherwise("supporting")
    weight = F.lit(0)
    for k, n in KIND_WEIGHTS.items():
        weight = F.when(F.col("kind") == k, n).otherwise(weight)
    out = out.withColumn("kind", kind)
    out = out.withColumn("weight", weight + F.least(F.col("n") * 5, F.lit(30)) + F.col("quality") + F.col("average_score"))
    return out.select("cluster_key", F.col("_name").alias("name"), "kind", "n", "intent", "average_score", "cohesion", "consistency", "tightness", "quality", "weight")


def ordered(clusters_: DataFrame) -> DataFrame:
    return clusters_.orderBy(F.desc("weight"), "cluster_key")


def research(suggestions: DataFrame, seed: str, strict: bool = False, keep_brands: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept keywords with scores and clusters, filtered ones) of a table of suggestions."""
    rows = with_noise(deduplicated(suggestions), seed, strict, keep_brands)
    return with_topics(scored(rows.where("not filtered"), seed), seed), rows.where("filtered")


def intent_distribution(rows: DataFrame) -> DataFrame:
    """Keywords by intent, intents without any included."""
    every = rows.sparkSession.createDataFrame([(k,) for k in INTENT_POINTS], "intent string")
    return every.join(rows.groupBy("intent").agg(F.count("*").alias("n")), "intent", "left").na.fill(0)
