"""The stages of the corpus pipeline on the smallest documents."""

import re

import corpus_pipeline
from ionweave.llm import chosen_path
from ionweave.llm.store import stored

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL))
        assert docs.columns == before and 0.5 * kept < docs.count() <= kept, name
        if name == "near_duplicates":
            assert chosen_path.near_duplicates(docs).filter("not kept").count() == 0
    assert not [r for r in docs.collect() if re.search(r"[a-z0-9.]+@[a-z0-9]+\.example\.com", r.text)]
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_result(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
