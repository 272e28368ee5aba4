"""Streams in several micro-batches, with recaptures, late events, failures and restarts, against the batch results."""

import random

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sitegrain.functions import scalars
from sitegrain.operators import signatures
from sitegrain.operators.rules import all_findings
from sitegrain.plans.dialect import SPARK, PLANS
from sitegrain.plans.stored import shared_dir
from sitegrain.streaming import audit, captures, index

SF = "/root/testdata/sf0.001"
CAPTURE = "url string, html string, seq bigint"


def _page(title, description, h1, body):
    return f"<html><head><title>{title}</title><meta name='description' content='{description}'></head><body><h1>{h1}</h1><p>{body}</p></body></html>"


def _feed(spark, folder, rows, number):
    spark.createDataFrame(rows, CAPTURE).coalesce(1).write.parquet(f"{folder}/in/b={number}")
    return spark.readStream.schema(CAPTURE).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_index_follows_recaptures(spark):
    draw, folder = random.Random(3), shared_dir(spark)
    last, words = {}, "alpha beta gamma delta omega kappa sigma lambda".split()
    for number in range(4):
        rows = []
        for _ in range(25):
            seq = draw.randrange(10_000) if draw.random() < 0.2 else 10_000 * (number + 1) + draw.randrange(9_999)
            url = draw.choice([None, *(f"https://a.test/{i}" for i in range(14))])
            values = (draw.choice(["", "One", "ONE  ", "Two", "Three"]), draw.choice(["", "d", "e"]), draw.choice(["", "H", "h"]), " ".join(draw.choices(words, k=draw.choice([2, 60]))) if draw.random() < 0.6 else "the very same body of eight words here")
            rows.append((url, _page(*values), seq))
            if url and seq > last.get(url, (-1,))[0]:
                last[url] = (seq, values)
        changes, sizes = index.keep_up(_feed(spark, folder, rows, number), folder)
        groups = defaultdict(set)
        for url, (_, (title, description, h1, _)) in last.items():
            for kind, value in (("title", title), ("description", description), ("h1", h1)):
                if value.strip():
                    groups[kind, " ".join(value.lower().split())].add(url)
        expected = {(u, k, v, len(g) - 1) for (k, v), g in groups.items() if len(g) > 1 for u in g}
        assert {tuple(r) for r in index.duplicates(changes, sizes).select("url", "kind", "key", "n_others").collect()} == expected
        signed = {u: signatures.signature(" ".join([v[0], v[2], v[3]]).strip()) for u, (_, v) in last.items()}
        near = {a: [sum(x == y for x, y in zip(s, t)) / 64 for b, t in signed.items() if a != b and s and t] for a, s in signed.items()}
        expected = {(a, max(x), sum(l >= 0.8 for l in x)) for a, x in near.items() if x and max(x) >= 0.8}
        assert {tuple(r) for r in index.near_duplicates(changes).collect()} == expected


def test_index_of_nothing(spark):
    folder = shared_dir(spark)
    changes, sizes = index.keep_up(_feed(spark, folder, [(None, "<title>x</title>", 1), ("https://a.test/", None, 1)], 0), folder)
    assert index.duplicates(changes, sizes).collect() == [] and index.near_duplicates(changes).collect() == []


def test_signature_is_the_scalar_one(spark):
    """The array form against the row's expression, with accents, wide characters, repeats and long words."""
    texts = [None, "", "one two three four", "one two three four five", "Ünïcode wörds ÇA vå über straße größe " * 3, "日本語の テキスト です から 長い 文字列 を", "a bb ccc dddd eeeee ffffff ggggggg hhhhhhhh", "same same same same same same", "x" * 5000 + " yyy zzz www vvv uuu", "tab\tnew\nline nbsp words split here also"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    df = df.select("i", "t", scalars.shingles(F.regexp_replace("t", " ", " ")).alias("s")).select("i", "t", scalars.hashed(F.col("s")).alias("h"))
    for r in df.select("i", scalars.min_hash(F.col("h")).alias("sig")).collect():
        assert signatures.signature(texts[r.i]) == (r.sig or None), r.i


def test_near_pages_lose_no_pair(spark):
    draw = random.Random(2)
    base = [[draw.choice("abcdefghijklmnop") * draw.randrange(3, 9) + str(i) for i in range(120)] for _ in range(6)]
    pages = []
    for i in range(90):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 4, 9])):
            words[draw.randrange(120)] = f"new{draw.randrange(9)}"
        pages.append((i, f"<p>{' '.join(words)}</p>"))
    got = {r.page_id: (r.likeness, r.n_others) for r in signatures.near_pages(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    signed = {i: signatures.signature(h[3:-4]) for i, h in pages}
    expected = {}
    for a, s in signed.items():
        near = [x for b, t in signed.items() if a != b and (x := sum(p == q for p, q in zip(s, t)) / 64) >= 0.8]
        if near:
            expected[a] = (max(near), len(near))
    assert got == expected and len({v for v, _ in got.values()}) > 3
    assert signatures.near_pages(spark.createDataFrame([], "page_id int, html string")).collect() == []


def _split(spark, folder):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.repartition(4, "page_id").write.parquet(f"{folder}/in")
    return spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_audit_survives_a_failed_batch(spark, monkeypatch):
    folder = shared_dir(spark)
    stream, real, calls = _split(spark, folder), audit.page_sink(folder), []

    def failing(batch, number):
        calls.append(number)
        real(batch, number)
        if calls.count(number) == 1 and number == 2:
            raise RuntimeError("the driver was lost after the batch was written")

    monkeypatch.setattr(audit, "page_sink", lambda _: failing)
    with pytest.raises(Exception, match="foreach_batch|FOREACH_BATCH|lost"):
        audit.start(stream, folder).awaitTermination()
    audit.start(stream, folder).awaitTermination()
    assert calls == [0, 1, 2, 2, 3]
    expected = sorted(map(tuple, PLANS["rules_all_findings"].run(spark, SF).collect()))
    for _ in range(2):  # the end may be repeated, too
        found = audit.finish(spark, folder).select("page_id", "rule_id", "sub_check", "severity", "category").collect()
        assert sorted(map(tuple, found)) == expected
    assert all_findings(SPARK)


def test_windows_over_late_events(spark):
    """Events out of order within the watermark's delay merge sessions that stood apart."""
    folder, schema = shared_dir(spark), "event_id bigint, user_id bigint, event_type string, ts timestamp, value double"
    batches = [
        [(1, 1, "view", "2024-01-01 10:00:00", 1.0), (2, 1, "view", "2024-01-01 10:50:00", 2.0), (3, 2, "view", "2024-01-01 10:00:00", None)],
        [(4, 1, "view", "2024-01-01 10:25:00", 4.0), (5, None, "view", "2024-01-01 10:25:00", 8.0), (6, 2, "view", "2024-01-01 10:30:00", 1.0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/{i}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = sorted((r.user_id, r.begin[11:16], r["last"][11:16], r.n) for r in captures.drain(captures.user_sessions(stream()), "complete").collect())
    assert got == [(1, "10:00", "10:50", 3), (2, "10:00", "10:30", 2)]  # a gap of exactly thirty minutes still joins
    got = {(r.begin[11:], r.n, r.total) for r in captures.drain(captures.sliding_windows(stream(), "1 hour"), "complete").collect()}
    assert got == {("09:30", 4, 13.0), ("10:00", 6, 16.0), ("10:30", 2, 3.0)}


def test_a_folder_is_a_stream_too(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "n").repartition(3).write.parquet(f"{tmp_path}/things.parquet")
    assert captures.drain(captures.stream_of(spark, str(tmp_path), "things")).count() == 10


@pytest.fixture(scope="module")
def one_url(spark, tmp_path_factory):
    """Four pages, three of them of one URL and one without."""
    folder, body = str(tmp_path_factory.mktemp("one_url")), "the very same body of eight words here"
    rows = [(1, "https://a.test/", _page("One", "d", "x", body)), (2, "https://a.test/", _page("one", "", "y", "")), (3, "https://a.test/", _page("Two", "d", "y", "")), (4, None, _page("One", "", "x", body))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


def test_pages_of_one_url_are_pages_of_their_own(spark, one_url):
    got = [tuple(r) for r in captures.QUERIES["st03_page_index"](spark, one_url).collect()]
    a = "https://a.test/"
    assert sorted(got, key=str) == sorted([(a, "title", "one", 2), (a, "title", "one", 2), (None, "title", "one", 2), (a, "description", "d", 1), (a, "description", "d", 1), (a, "h1", "x", 1), (None, "h1", "x", 1), (a, "h1", "y", 1), (a, "h1", "y", 1)], key=str)


def test_near_pages_of_one_url_are_pages_of_their_own(spark, one_url):
    assert {tuple(r) for r in captures.QUERIES["st03_near_pages"](spark, one_url).collect()} == {("https://a.test/", 1.0, 1), (None, 1.0, 1)}
