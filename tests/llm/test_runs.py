"""Operator 11 against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sitegrain.llm import runs
from sitegrain.llm.common import shared_dir

SCHEMA = "doc_id bigint, text string"


def _runs(words, least=6, times=4):
    """Every maximal stretch of every period, of each stretch the smallest period."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def _expected(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join("%d,%d,%d\n" % r for r in found)
    text = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (5, 3)])
def test_runs_brute_force(least, times):
    draw = random.Random(5)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 200, list("abab" * 9), list("abcabcabcabcabca"), list("aabaabaabaabb" * 5)]
    for _ in range(400):
        t = [draw.choice("ab" if draw.random() < 0.5 else "abcdef") for _ in range(draw.randrange(60))]
        if draw.random() < 0.6:
            at = draw.randrange(len(t) + 1)
            t[at:at] = (t[at : at + draw.randrange(1, 7)] or ["x"]) * draw.randrange(2, 8)
        texts.append(t)
    got = runs.runs_of_texts(texts, least, times)
    assert [[tuple(r) for r in x.tolist()] for x in got] == [_runs(t, least, times) for t in texts]
    assert runs.runs_of_texts([]) == []


def test_extensions():
    draw = random.Random(1)
    values = np.array([draw.choice([0, 0, 1]) for _ in range(300)])
    reach = runs.Extensions(values, 300)
    a, b = np.array([(i, j) for i in range(300) for j in range(i + 1, 300)]).T
    for i, j, right, left in zip(a, b, reach.forward(a, b), reach.backward(a, b)):
        assert right == next((k for k in range(300 - j) if values[i + k] != values[j + k]), 300 - j)
        assert left == next((k for k in range(i) if values[i - 1 - k] != values[j - 1 - k]), i)


def test_mask_keeps_what_runs_need():
    assert runs.overlap() == 5 and runs.overlap(2, 2) == 1
    ids, owner = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 1, 2, 3, 4, 5]), np.array([0] * 11 + [1] * 5)
    assert runs._repeated(ids, owner, 5).tolist() == [True] * 5 + [False] + [True] * 5 + [False] * 5


def test_query_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in runs.op11_runs(spark, sf).collect()}
    assert got == {r.doc_id: _expected(r.doc_id, r.text) for r in docs}
    assert sum(r[0] > 0 for r in got.values()) > 10


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "one", "a " * 30_000, "a b c " * 8 + "Ü é\x85ß " * 9, "same same same same same same", "x y", "x y"]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(None, None), (45, "w v u t " * 40), (45, "w v u t " * 40)]
    folder = f"{shared_dir(spark)}/odd"
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as runs", "2 as start", "3 as id").write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(repr, map(tuple, runs.op11_runs(spark, folder).collect())))
    assert got == sorted(repr((i, *_expected(i, t))) for i, t in rows)
    found = runs.periodic_runs(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as runs", "2 as collapsed"))
    assert {r.collapsed for r in found.where("id = 6").collect()} == {"same"}
    assert found.where("id = 4").first().runs == [(0, 30_000, 1)]
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
