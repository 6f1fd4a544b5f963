import tracemalloc

from profila.llm import langid
from profila.llm.queries import op2_language_id

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = [r for r in op2_language_id(spark, FOLDER).collect() if r.held_out]
    assert len(out) > 200 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, "der die das und nicht" if i % 2 else "the of and to not", "de" if i % 2 else "en", "x") for i in range(20)]
    docs = spark.createDataFrame([*rows, (50, None, "en", "x"), (51, "12 34", None, "x"), (51, "", None, "x")], schema)
    out = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(docs, langid.train(docs)).collect()]
    assert len(out) == 23
    assert {x for x in out if x[0] >= 50} == {(50, "und", True), (51, "und", True)}
    assert all(pred == ("de" if i % 2 else "en") for i, pred, _ in out if i < 20)
    assert langid.keep_identified(docs.limit(0)).collect() == []


def test_training_holds_no_dense_table(spark):
    words = [" ".join(f"{c}{d}" for d in "aeiou" for c in part) for part in ("bcdf", "ghjk", "lmnp", "rstv")]
    docs = spark.range(4000).selectExpr(
        "id AS doc_id", "concat('l', id % 4) AS lang", f"concat(element_at(array({', '.join(map(repr, words))}), int(id % 4) + 1), hex(id)) AS text")
    docs.count()
    tracemalloc.start()
    model = langid.train(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(set(model.languages)) == ["l0", "l1", "l2", "l3"]
    assert most < 4000 * langid.PLACES * 8, most  # the rows as one dense table, and its vectors, take that
