import corpus_pipeline
from profila.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, FOLDER, "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settled(stage(spark, docs, FOLDER), f"test-{name}")
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= set(texts)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    ids = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert len(ids) > 100
