"""The columns that a capture brings, or their defaults, decide what jon04_broken_links finds."""

from sitegrain.operators import rules  # noqa: F401  it registers its plans
from sitegrain.plans.dialect import PLANS


def test_answers_of_the_capture_reach_broken_links(spark, tmp_path):
    link = '<a href="/{}">x</a>'.format
    rows = [(1, "https://a.example/", link("gone") + link("gone") + link("fine") + link("silent") + link("nowhere"), 200), (2, "https://a.example/gone", "", 404), (3, "https://a.example/fine", link("gone"), 200), (4, "https://a.example/silent", "", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, status_code bigint")
    pages.write.parquet(f"{tmp_path}/with/pages.parquet")
    pages.drop("status_code").write.parquet(f"{tmp_path}/without/pages.parquet")
    found = {tuple(r) for r in PLANS["jon04_broken_links"].run(spark, f"{tmp_path}/with").collect()}
    home, gone = "https://a.example/", "https://a.example/gone"
    assert found == {(1, home, gone, 404, 2), (1, home, "https://a.example/silent", 0, 1), (3, "https://a.example/fine", gone, 404, 1)}
    assert PLANS["jon04_broken_links"].run(spark, f"{tmp_path}/without").count() == 0
