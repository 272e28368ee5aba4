"""UDFs over pages hold the results of a few rows, not of a whole batch."""

import pandas as pd

from sitegrain.functions import html, slices


def test_results_come_in_slices():
    n = 3 * slices.SLICE + 1
    pages = pd.Series([f"<title>{i}</title>" if i % 2 else None for i in range(n)])
    parts = list(html._extract(iter([(pages, pd.Series([None] * n)), (pages[:0], pages[:0])])))
    assert [len(p) for p in parts] == [slices.SLICE] * 3 + [1]
    assert pd.concat(parts).title.tolist() == [str(i) if i % 2 else None for i in range(n)]


def test_rows_keep_their_order(spark):
    pages = spark.range(5000, numPartitions=1).selectExpr("id", "concat('<title>', id, '</title>') as html", "'' as url")
    rows = pages.select("id", html.extract_page("html", "url").title.alias("title")).collect()
    assert len(rows) == 5000 and all(r.title == str(r.id) for r in rows)
