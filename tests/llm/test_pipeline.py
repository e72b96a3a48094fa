"""The pipeline against brute-force stages over a small folder."""

import random

import corpus_pipeline
import pytest
from plait.llm import mixing, quality

from .test_decontam import brute as brute_contamination
from .test_quality import verdicts
from .test_simhash import brute_components, brute_fingerprint


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(21)
    vocabulary = [f"word{k}" for k in range(500)]
    items = [(k, " ".join(rng.choices(vocabulary, k=20))) for k in range(5)]
    docs = []
    for k in range(260):
        words = rng.choices(vocabulary, k=rng.randint(15, 90))
        if k % 13 == 0:
            words[3:3] = rng.choice(items)[1].split()
        if k % 11 == 0:
            words = [w + "%%%" for w in words]
        docs.append([k, " ".join(words), rng.choice(["en", "de"]), rng.choice(["src0", "src0", "src1"])])
    for k in range(260, 300):
        docs.append([k, docs[k % 50][1], "en", "src0"])
    rows = [(d, t, lang, s, len(t)) for d, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, items


def test_stages_match_brute_force(spark, folder):
    path, docs, items = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    columns = df.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "simhash near-dedup", "decontamination", "source mixing", "sharding"]

    rows = [(d, lang, s, t) for d, t, lang, s in docs]
    good = {d for d, _, kept in verdicts(rows, quality.MIN_ROWS) if kept}
    df = steps["quality rules"](spark, df, path)
    assert df.columns == columns and {r.doc_id for r in df.collect()} == good

    left = [d for d in docs if d[0] in good]
    comp = brute_components([brute_fingerprint(d[1]) for d in left])
    df = steps["simhash near-dedup"](spark, df, path)
    unique = {left[k][0] for k in set(comp)}
    assert df.columns == columns and {r.doc_id for r in df.collect()} == unique

    clean = {d[0] for d in left if d[0] in unique and not brute_contamination(d[1], items)[2]}
    df = steps["decontamination"](spark, df, path)
    assert df.columns == columns and {r.doc_id for r in df.collect()} == clean and clean != unique

    kept = {r.doc_id for r in mixing.mix_report(df).collect() if r.kept}
    df = steps["source mixing"](spark, df, path)
    assert df.columns == columns and {r.doc_id for r in df.collect()} == kept

    out = steps["sharding"](spark, df, path).collect()
    assert {r.doc_id for r in out} == kept and len(out) == len(kept)
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(str, whole)) == sorted(map(str, out))
    assert corpus_pipeline.ORACLE_SQL is None
