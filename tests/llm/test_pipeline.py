"""The pipeline on a small table, stage by stage."""

from pathlib import Path

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}
    assert kept and len(kept) < docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(labels.get(i) != 0 for i in kept)
    assert not any(x in texts[i] for i in kept for x in items)
    assert len({texts[i] for i in kept}) == len(kept)
    gone = [i for i in texts if i not in kept and labels.get(i) == 1 and not any(x in texts[i] for x in items)]
    assert len(gone) < 0.15 * len(texts)


def test_stage_columns(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words in a row here", "en", "s", 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[2:4]:
        assert stage(spark, docs, DATA).columns == docs.columns
