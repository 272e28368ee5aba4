"""PageRank, depth and closure over whole tables, on a fixture that SQL's cuts would change."""

import pytest

from sitegrain import catalog


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Nation i orders from nation i + 1 up to 7, in small quantities; eight customers, none of a key that 10 divides."""
    path = str(tmp_path_factory.mktemp("chain"))
    n = range(8)
    tables = {
        "nation": ([(i, i % 2) for i in n], "n_nationkey int, n_regionkey int"),
        "customer": ([(i + 1, i) for i in n], "c_custkey bigint, c_nationkey int"),
        "supplier": ([(i + 1, i) for i in n], "s_suppkey bigint, s_nationkey int"),
        "orders": ([(i, i + 1) for i in n], "o_orderkey bigint, o_custkey bigint"),
        "lineitem": ([(i, i + 2, 1.0) for i in range(7)], "l_orderkey bigint, l_suppkey bigint, l_quantity double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_depth(spark, chain):
    assert {(r.url, r.depth) for r in catalog.QUERIES["gra06_bfs_depth"](spark, chain).collect()} == {(str(i), i + 1) for i in range(8)}


def test_pagerank(spark, chain):
    ranks = [1.0] * 8
    for _ in range(20):
        base = 0.15 + 0.85 * ranks[7] / 8
        ranks, before = [base + (0.85 * ranks[i - 1] if i else 0) for i in range(8)], ranks
        if sum(abs(a - b) for a, b in zip(ranks, before)) < 1e-4:
            break
    got = {r.url: r["rank"] for r in catalog.QUERIES["gra02_pagerank"](spark, chain).collect()}
    assert got == pytest.approx({str(i): r for i, r in enumerate(ranks)}, abs=2e-6)


def test_closure(spark, chain):
    expected = {(f"n{i}", f"r{i % 2}", 1) for i in range(8)}
    expected |= {(f"c{i + 1}", f"n{i}", 1) for i in range(8)} | {(f"c{i + 1}", f"r{i % 2}", 2) for i in range(8)}
    assert {tuple(r) for r in catalog.QUERIES["gra09_ontology_closure"](spark, chain).collect()} == expected


def test_closure_beyond_the_rows_of_a_recursion(spark, chain):
    """A recursion in SQL ends with an error at a number of rows, a million by default."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "5")
    try:
        assert catalog.QUERIES["gra09_ontology_closure"](spark, chain).count() == 24
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
