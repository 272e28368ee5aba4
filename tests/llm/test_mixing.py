"""Operator 13 against its definition worked out row by row."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from sitegrain.llm import mixing
from sitegrain.llm.common import shared_dir

SCHEMA = "doc_id bigint, text string, source string"


def _size(text):
    return len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))


def _targets(sizes, weights=(5, 2, 1), most=3, total=None):
    """Clamp and deal anew, in exact numbers."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = min(sum(sizes.values()) if total is None else total, most * sum(sizes.values())), set(names), {}
    while free:
        level = Fraction(left) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in free}
        for s in above:
            out[s] = Fraction(most * sizes[s])
            left -= most * sizes[s]
        free -= above
    return out


def _expected(rows, seed=0, **options):
    """``Counter`` of (id, size, source size, target, taken)."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += _size(text)
    targets, out = _targets(sizes, **options), Counter()
    for source, words in sizes.items():
        key = lambda r: (hashlib.md5(b"|".join([b"%d" % seed, *([b"%d" % r[0]] if r[0] is not None else [])])).hexdigest()[:16], _size(r[1]))
        whole = min(3, targets[source] // words) if words else 0
        want, before = targets[source] - whole * words, Fraction(0)
        for r in sorted((r for r in rows if r[2] == source), key=key):
            n = _size(r[1])
            out[r[0], n, words, round(float(targets[source]), 6), n * min(3, whole + (before + Fraction(n, 2) <= want))] += 1
            before += n
    return out


def _got(df):
    return Counter((r.id, r.size, r.source_size, round(r.target, 6), r.times * r.size) for r in df.collect())


def _docs(draw, n):
    word = lambda: draw.choice(["a", "b c", "é", "x\x1cy"])
    text = lambda: draw.choice([None, "", " \n ", *(draw.choice(" \t\n\x0b") .join(word() for _ in range(draw.randrange(40))) for _ in range(6))])
    return [(draw.choice([i, i, i, None]), text(), draw.choice(["s1"] * 8 + ["s2", "S", "é", "\U0001f600", "￮", None, "tiny"])) for i in range(n)]


@pytest.mark.parametrize("seed, n, small", [(1, 300, 10_000), (2, 40, 0), (3, 700, 0)])
def test_mixture_by_definition(spark, monkeypatch, seed, n, small):
    monkeypatch.setattr(mixing, "SMALL", small)
    rows = _docs(random.Random(seed), n)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as size", "3 as `order`", "4 as tie", "5 as of").repartition(5)
    assert _got(mixing.mixture(df, seed=seed)) == _expected(rows, seed)


def test_cells_are_cut_twice(spark, monkeypatch):
    """One digit a cell, so that both cuts and the sorted cell hold many rows."""
    monkeypatch.setattr(mixing, "_DIGITS", 1)
    rows = [(i, "w " * (1 + i % 7), "a" if i % 5 else "b") for i in range(4000)]
    assert _got(mixing.mixture(spark.createDataFrame(rows, SCHEMA), seed=9)) == _expected(rows, 9)


def test_water_filling(spark):
    def filled(sizes, weights, total, most=3):
        rows = [(n, w) for n, w in zip(sizes, weights)]
        return [r.target for r in mixing.water_filled(spark.createDataFrame(rows, "size bigint, weight int").coalesce(1), total, most).collect()]

    assert filled([100, 100], [1, 1], 200) == [100, 100]
    assert filled([10, 190], [5, 1], 200) == [30, 170]
    assert filled([1, 10, 100], [5, 5, 1], 111) == [3, 30, 78]  # the second is above only after the first was clamped
    assert filled([0, 5], [5, 2], 5) == [0, 5] and filled([0, 0], [5, 2], 0) == [0, 0] and filled([4, 4], [1, 1], 24) == [12, 12]


def test_words_come_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mixture(docs)
    by = out.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("times") * F.col("size")).alias("taken"), F.max("size").alias("most"), F.max("times").alias("times"), F.first("source_size").alias("n")).collect()
    assert all(abs(r.taken - r.target) <= r.most / 2 + 1e-6 and r.times <= 3 and r.target <= 3 * r.n + 1e-6 for r in by)
    assert sum(r.target for r in by) == pytest.approx(sum(r.n for r in by))
    assert _got(out) == _got(mixing.mixture(docs.repartition(7))) != _got(mixing.mixture(docs, seed=1))


def test_mixed_rows(spark):
    rows = _docs(random.Random(4), 120) + [(5, "same row", "s1")] * 3
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as _mix_row", "8 as `a.b`")
    times, out = mixing.mixture(docs, total=900), mixing.mixed(docs, total=900)
    assert out.columns == docs.columns
    taken = Counter((r.doc_id, _size(r.text), r.source) for r in out.collect())
    expected = Counter()
    for r in times.collect():
        expected[r.id, r["size"], r.source] += r.times
    assert taken == +expected


def test_odd_tables_and_sql(spark):
    for rows in ([], [(None, None, None)] * 3, [(1, "one two", "s")] * 5, [(1, "a " * 50_000, "s"), (2, "", "t"), (3, "b", None)]):
        folder = f"{shared_dir(spark)}/odd"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.op13_mixing(spark, folder).collect())
        assert got == _expected(rows)
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    sql = con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.ORACLE})").fetchall()
    got = [tuple(r) for r in mixing.op13_mixing(spark, "/root/testdata/sf0.001").select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got) == sorted(sql)
    with pytest.raises(ValueError):
        mixing.mixture(spark.createDataFrame([], SCHEMA), weights=(1, 0))
