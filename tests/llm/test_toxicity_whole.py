"""The pipeline's toxicity model learns from every labelled row outside the held-out fold."""

import zlib

import numpy as np

import corpus_pipeline
from sitegrain.llm import toxicity


def test_pipeline_reads_all_labelled_rows(spark, tmp_path, monkeypatch):
    n, seen, written = 9_000, {}, toxicity.materialise

    def note(df, name="table"):
        out = written(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(toxicity, "materialise", note)
    docs = spark.range(n).selectExpr("id as doc_id", "concat(if(id % 3 = 0, 'vile ', 'kind '), 'word', translate(cast(id % 50 as string), '0123456789', 'abcdefghij'), ' end') as text")
    spark.range(n).selectExpr("id as doc_id", "1 as quality", "cast(id % 3 = 0 as int) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))
    assert seen["labelled"] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(n)) > 5_000
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i in range(n) if i % 3}


def test_sums_over_rows_fit_as_the_rows_do(spark):
    rnd = np.random.default_rng(5)
    y = (np.arange(900) % 5 == 0).astype(int)
    x = np.column_stack([y + rnd.normal(size=900), -y + rnd.normal(size=900), 3 * y * rnd.random(900)])
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "y int, x array<double>").repartition(5)
    slopes, shift = toxicity._fitted(toxicity._total(rows), 3)
    want, at = toxicity._calibrated(x, y)
    assert np.allclose(slopes, want, rtol=1e-6) and np.isclose(shift, at, rtol=1e-6) and slopes[1] == 0.0
    assert toxicity._fitted(toxicity._total(rows.where("y = 0")), 3) is None
    assert toxicity._fitted(toxicity._total(rows.where("false")), 3) is None
