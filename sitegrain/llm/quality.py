"""Operator 6 — quality rules as a learned decision list.

Statistics of every text are DataFrame expressions over one row (no explode,
no shuffle of words). From the statistics of labelled documents, sequential
covering learns an ordered list of threshold conjunctions for the rejected
class: a rule is grown condition by condition on two thirds of the rows by
FOIL's gain, pruned from its end on the other third, kept while it is precise
enough there, and the rows that it covers are removed before the next one.
The list is emitted as one ordered Spark conditional expression.

The learner sees a bounded sample: at most about ``MAX_ROWS`` labelled rows,
chosen by a hash of their id. Labels of one id that disagree count by their
mean, half and more meaning good. Null labels and labels without a document
are ignored; without labelled rows the list is empty and keeps everything that
the base rule keeps.

Defined results: null and empty texts have all-zero statistics and fail the
base rule; repeated rows are judged alike; a value equal to a threshold counts
as not above it, and rules of equal gain are tried in the order of FEATURES;
an empty table gives an empty result; very long texts are read whole, with
memory in proportion to their length. All columns that are added begin with a
prefix that no column of the documents begins with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, table

MAX_ROWS = 10_000
CUTS = 24  # candidate thresholds a statistic
CONDITIONS = 4  # at most in a rule
PRECISION = 0.95  # of a rule on the pruning rows
COVER = 3  # rejected pruning rows that a rule covers at least
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACE = r" \t\n\x0B\f\r"


#: Prefix of the columns that are added. They are flat on purpose: fields taken from a struct
#: would let the optimizer inline, and so repeat, the array expressions below them.
AS = "_sg_"


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = AS) -> DataFrame:
    """Adds whole-text statistics: the base counts and, after a further ``f_``, the learner's shares."""
    if fresh(docs, prefix) != prefix:
        raise ValueError(f"a column begins with {prefix}; take fresh(docs, prefix)")
    cols = columns(docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")
    df = docs.select(*cols, text.alias(f"{prefix}t"), words.alias(f"{prefix}w"))
    lines = F.filter(F.split(f"{prefix}t", "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    grams = F.expr(
        f"""if(size({prefix}w) < 3, cast(array() as array<bigint>),
              transform(sequence(0, size({prefix}w) - 3), i -> xxhash64({prefix}w[i], {prefix}w[i + 1], {prefix}w[i + 2])))"""
    )
    df = df.select(*cols, f"{prefix}t", f"{prefix}w", grams.alias(f"{prefix}g"), lines.alias(f"{prefix}l"))
    # positions of the windows found twice or more, in order
    df = df.select(
        *cols, f"{prefix}t", f"{prefix}w", f"{prefix}l",
        F.expr(
            f"""if(size(array_distinct({prefix}g)) = size({prefix}g), cast(array() as array<struct<g:bigint,i:int>>),
                  sort_array(transform({prefix}g, (g, i) -> named_struct('g', g, 'i', i))))"""
        ).alias(f"{prefix}s"),
    )
    df = df.select(
        *cols, f"{prefix}t", f"{prefix}w", f"{prefix}l",
        F.expr(
            f"""sort_array(transform(filter({prefix}s, (x, j) ->
                 (j > 0 and {prefix}s[greatest(j - 1, 0)].g = x.g) or
                 (j + 1 < size({prefix}s) and {prefix}s[least(j + 1, size({prefix}s) - 1)].g = x.g)), x -> x.i))"""
        ).alias(f"{prefix}p"),
    )
    joined = F.array_join(f"{prefix}w", "")
    counts = df.select(
        *cols,
        F.size(f"{prefix}w").cast("bigint").alias(f"{prefix}c_n_words"),
        F.length(joined).cast("bigint").alias(f"{prefix}c_word_chars"),
        F.regexp_count(joined, F.lit("[#*$%&|<>]")).cast("bigint").alias(f"{prefix}c_n_symbols"),
        (F.size(f"{prefix}l") - F.size(F.array_distinct(f"{prefix}l"))).cast("bigint").alias(f"{prefix}c_n_dup_lines"),
        F.expr(
            f"""if(size({prefix}p) = 0, 0L, 3L + aggregate(sequence(0, size({prefix}p) - 1), 0L,
                 (a, j) -> a + if(j = 0, 0, least(3, {prefix}p[j] - {prefix}p[greatest(j - 1, 0)]))))"""
        ).alias(f"{prefix}c_n_repeat_words"),
        F.size(f"{prefix}l").cast("bigint").alias(f"{prefix}c_n_lines"),
        F.regexp_count(joined, F.lit(r"\p{Lu}")).cast("bigint").alias(f"{prefix}c_n_upper"),
        F.regexp_count(joined, F.lit("[0-9]")).cast("bigint").alias(f"{prefix}c_n_digits"),
        F.regexp_count(joined, F.lit("[.!?;:]")).cast("bigint").alias(f"{prefix}c_n_stops"),
        F.size(F.array_distinct(f"{prefix}w")).cast("bigint").alias(f"{prefix}c_n_distinct"),
    )
    share = lambda a, b: F.col(f"{prefix}c_" + a) / F.greatest(F.col(f"{prefix}c_" + b), F.lit(1))
    features = {
        "n_words": F.col(f"{prefix}c_n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "stop_share": share("n_stops", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }
    # A condition on the row's number holds filters above the statistics: pushed down, they would
    # inline the array expressions into each other and evaluate them anew for every element.
    held = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
    return counts.select(
        *cols, *(held(F.col(f"{prefix}c_" + c)).alias(prefix + c) for c in BASE), *(held(c).alias(f"{prefix}f_{k}") for k, c in features.items())
    )


FEATURES = (
    "n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share",
    "upper_share", "digit_share", "stop_share", "distinct_share", "line_words",
)


def base_failed(prefix: str = AS) -> Column:
    n, rep = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * rep > 50 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > cut, else feature <= cut
    cut: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.cut) == self.above

    def column(self, prefix: str = AS) -> Column:
        c = F.col(f"{prefix}f_{self.feature}")
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, rows: list[dict]) -> list[dict]:
    for c in rule:
        rows = [r for r in rows if c.holds(r)]
    return rows


def _counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _grow(rows: list[dict]) -> Rule:
    from math import log2

    rule: Rule = ()
    while len(rule) < CONDITIONS:
        p0, n0 = _counts(rows)
        if not p0 or not n0:
            break
        base, best, gain = log2(p0 / (p0 + n0)), None, 0.0
        for f in FEATURES:
            ordered = sorted((r[f], r["bad"]) for r in rows)
            bads = [0]
            for _, b in ordered:
                bads.append(bads[-1] + b)
            poor = sorted(v for v, b in ordered if b)  # thresholds between quantiles of both classes
            good = [v for v, b in ordered if not b]
            cuts = {vs[min(len(vs) - 1, i * len(vs) // CUTS)] for vs in (poor, good) for i in range(CUTS + 1)} | {good[-1], good[0], poor[0]}
            at = 0
            for cut in sorted(cuts):
                while at < len(ordered) and ordered[at][0] <= cut:
                    at += 1
                for above, p, n in ((False, bads[at], at - bads[at]), (True, p0 - bads[at], len(rows) - at - p0 + bads[at])):
                    if p and p + n < len(rows) and (g := p * (log2(p / (p + n)) - base)) > gain + 1e-9:
                        following = ordered[at][0] if at < len(ordered) else cut
                        best, gain = Condition(f, above, (cut + following) / 2), g
        if best is None:
            break
        rule, rows = (*rule, best), [r for r in rows if best.holds(r)]
    return rule


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    def worth(r: Rule) -> float:
        p, n = _counts(_covered(r, rows))
        return (p - n) / (p + n) if p + n else -1.0

    best = max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())
    return best


def learn(rows: list[dict]) -> list[Rule]:
    """Ordered rules for the rejected class from rows of FEATURES, ``bad`` (0/1) and ``fold`` (0, 1, 2)."""
    grow, prune = [r for r in rows if r["fold"]], [r for r in rows if not r["fold"]]
    rules: list[Rule] = []
    while any(r["bad"] for r in grow) and len(rules) < 32:
        rule = _prune(_grow(grow), prune)
        p, n = _counts(_covered(rule, prune))
        if not rule or p < COVER or p < PRECISION * (p + n):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grow, prune))
    return rules


def verdict(rules: list[Rule], prefix: str = AS) -> Column:
    """Index of the first rule that rejects, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        c = rule[0].column(prefix)
        for more in rule[1:]:
            c = c & more.column(prefix)
        out = F.when(c, i) if out is None else out.when(c, i)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[dict]:
    """Statistics of a bounded sample of labelled documents, those that the base rule keeps."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    n = marks.count()
    pick = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(max(n, 1))) < max_rows
    chosen = marks.where(pick).select(F.col("doc_id").alias("_id"), (F.col("q") < 0.5).cast("int").alias("bad"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    stats = with_statistics(texts).where(~base_failed())
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)).alias("fold")
    return [r.asDict() for r in stats.select("bad", fold, *(F.col(f"{AS}f_{f}").alias(f) for f in FEATURES)).collect()]


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, prefix: str = AS) -> DataFrame:
    """``docs`` with, after the prefix, the statistics, base_failed, rule (first rejecting one, 0 if none) and kept."""
    rules = learn(labelled_rows(docs, labels, max_rows))
    return (
        with_statistics(docs, prefix=prefix)
        .withColumn(prefix + "base_failed", base_failed(prefix))
        .withColumn(prefix + "rule", verdict(rules, prefix))
        .withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & (F.col(prefix + "rule") == 0))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base rule and the learned list keep, with their columns as they are."""
    prefix = fresh(docs, AS)
    return judged(docs, labels, prefix=prefix).where(F.col(prefix + "kept")).select(*columns(docs))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", *(F.col(AS + c).alias(c) for c in (*BASE, "base_failed", "kept")), F.col(AS + "rule").cast("int").alias("rule"))
