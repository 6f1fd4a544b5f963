import numpy as np
import pytest

from profila.llm import ann

SCHEMA = "vec_id long, embedding array<double>, v string, leaf string"


def brute(rows, queries, k):
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    return {q: [i for _, i in sorted((-float(v[q] @ v[i]), i) for i in v if i != q)[:k]] for q in queries}


@pytest.mark.parametrize("small", [1, 3])
def test_queries_in_small_leaves_get_all_answers(spark, small):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16)) * 10
    sizes = [40] * 7 + [small]
    rows = [(100 + n, (centres[c] + rng.normal(size=16) * 0.05).tolist())
            for n, c in enumerate(np.repeat(np.arange(8), sizes))]
    odd = [(1, [1.0, 2.0], None, None), (2, None, None, None), (3, [0.0] * 16, None, None)]
    df = spark.createDataFrame([(i, x, "a", "b") for i, x in rows] + odd, SCHEMA)
    got = {}
    for r in sorted(ann.nearest(df, "vec_id % 2 = 0").collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, [i for i, _ in rows if i % 2 == 0], 5)
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    found = np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want])
    assert found >= 0.9


def test_recall_over_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in ann.nearest(df, "vec_id % 50 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.97
