"""Stages give every column back, whatever its name."""

import corpus_pipeline
import pytest


@pytest.mark.parametrize("name", ["quality rules", "simhash near-dedup", "decontamination", "source mixing"])
def test_dotted_and_clashing_names(spark, tmp_path, name):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(k, f"{text} tail{k % 3} of {k % 3}" * (1 + k % 2), "en", "s", 7, 1, 2, 3, 4, 5) for k in range(12)] + [(3, None, None, None, None, 1, 2, 3, 4, 5), (None, "", "de", "s", 0, 1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `a b` int, label int, node int, `x``y` int")
    spark.createDataFrame([(1, "some item of the benchmark with enough words in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, df, str(tmp_path))
    assert out.schema.names == df.schema.names
    assert {tuple(r)[5:] for r in out.collect()} <= {(1, 2, 3, 4, 5)}
    assert dict(corpus_pipeline.STAGES)[name](spark, df.limit(0), str(tmp_path)).count() == 0
