"""Kernels: the distributed routes give the values of the plain ones, under skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from profila.operators import kernels, quality, relate, stats
from profila.plans import inputs


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows share one value; the rest has a long tail, negatives and nulls."""
    rng = np.random.default_rng(7)
    v = np.concatenate([np.full(500, 3.5), rng.standard_cauchy(700) * 1e6, rng.integers(-4, 5, 300)])
    pdf = pd.DataFrame({"k": np.arange(1500) % 4, "v": rng.permutation(v), "w": rng.normal(size=1500).round(1)})
    pdf.loc[pdf.index % 7 == 0, "v"] = np.nan
    pdf.loc[pdf.index % 5 == 0, "w"] = np.nan
    pdf["id"] = np.arange(1500)
    return pdf


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.select("id", "k", *[kernels.number(df, c).alias(c) for c in ("v", "w")])


PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


def check_quantiles(spark, pdf):
    rows = kernels.quantiles(frame(spark, pdf), ["k"], "v", PROBS).collect()
    assert len(rows) == 4
    for r in rows:
        want = pdf.v[pdf.k == r["k"]]
        assert r["n"] == want.count()
        assert r["q"] == pytest.approx(want.quantile(list(PROBS)).tolist(), rel=1e-12)


def test_quantiles(spark, skewed):
    check_quantiles(spark, skewed)


@pytest.mark.parametrize("sketch", [20, 200])
def test_quantiles_of_a_coarse_sketch(spark, skewed, sketch, monkeypatch):
    """Narrow spans, as groups of many rows have them, give the same values."""
    monkeypatch.setattr(kernels, "SKETCH", sketch)
    monkeypatch.setattr(kernels, "REACHES", (3 / sketch, 0.3))
    check_quantiles(spark, skewed)


def test_quantiles_missed_by_the_sketch(spark, skewed, monkeypatch):
    monkeypatch.setattr(kernels, "_spans", lambda group, at, probs: [(group["hi"], group["hi"])])
    check_quantiles(spark, skewed)


def test_quantiles_of_null_groups_and_one_row(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("b", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["q"]) for r in kernels.quantiles(df, ["k"], "v", (0.0, 0.5, 1.0)).collect()}
    assert got == {None: (2, [1.0, 2.0, 3.0]), "a": (1, [5.0, 5.0, 5.0])}
    assert kernels.quantiles(df.where("v > 9"), ["k"], "v", (0.5,)).collect() == []


def test_quantiles_extreme_range(spark):
    pdf = pd.DataFrame({"v": [-1.7e308, -1e-300, 0.0, 1e-300, 1.0, 1.7e308] * 5})
    df = spark.createDataFrame(pdf).withColumn("k", F.lit("a"))
    q = kernels.quantiles(df, ["k"], "v", (0.25, 0.5)).first()["q"]
    assert q == pytest.approx(pdf.v.quantile([0.25, 0.5]).tolist())


def rank_correlation(pdf, a, b):
    d = pdf[[a, b]].dropna().rank()
    return d[a].corr(d[b])


def test_spearman_with_gaps(spark, skewed):
    pdf = skewed.assign(u=np.exp(skewed.w.fillna(0)) + skewed.k)
    df = spark.createDataFrame(pdf)
    found = relate.spearman(df, ["v", "w", "u"])
    assert found.columns == ["v", "w", "u"]
    for p in found.pairs.collect():
        assert p["r"] == pytest.approx(rank_correlation(pdf, p["a"], p["b"]), abs=1e-12)
        assert p["n"] == len(pdf[[p["a"], p["b"]]].dropna())


def test_ranks_of_every_row_under_skew(spark):
    """A hot value, nulls and partners with and without gaps: ranks among the rows where both are present."""
    pdf = pd.DataFrame({"v": [1.0] * 400 + list(np.arange(200) % 90 + 2.0), "u": np.arange(600) % 11 - 0.0, "w": np.arange(600) % 7 + 0.5})
    pdf.loc[pdf.index % 3 == 0, "u"] = np.nan
    pdf.loc[pdf.index % 4 == 1, "v"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "vuw"]).repartition(4)
    ranks = kernels.rank_table(df, ["v", "u", "w"], ["v", "u"])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        want = pdf[["vuw"[i], "vuw"[j]]].dropna().rank()
        want = sorted(map(tuple, want.to_numpy()))
        got = ranks.rows.select(ranks.rank(i, j), ranks.rank(j, i)).dropna().toPandas()
        assert sorted(map(tuple, got.to_numpy())) == want


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("k"))
    first = {r["id"] for r in kernels.sample_rows(df, 400, 5000, ["id"]).collect()}
    again = {r["id"] for r in kernels.sample_rows(df.repartition(7), 400, 5000, ["id"]).collect()}
    assert len(first) == 400 and first == again
    assert kernels.sample_rows(df, 6000, 5000, ["id"]).count() == 5000


def test_sample_is_spread(spark):
    ids = [r["id"] for r in kernels.sample_rows(spark.range(10_000), 1000, 10_000, ["id"]).collect()]
    assert 4500 < np.mean(ids) < 5500


def test_duplicates(spark):
    pdf = pd.DataFrame({"a": ["x", "x", "y", None, None, "x", "z"] * 20, "b": [1.0, 1.0, 2.0, None, None, 1.0, 3.0] * 20})
    pdf["b"] += np.where(pdf.index >= 70, 0.0, pdf.index // 35)
    df = spark.createDataFrame(pdf.assign(_row=np.arange(1, 141)))
    df = df.withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    dup = pdf.duplicated()
    assert quality.duplicate_count(df) == dup.sum()
    assert [r["_row"] for r in quality.duplicate_examples(df).collect()] == [i + 1 for i in pdf.index[dup][:10]]
    kept = sorted(r["_row"] for r in quality.dedupe(df).collect())
    assert kept == [i + 1 for i in pdf.index[~dup]]


def test_top_labels_ties_and_other(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "b", "a", "a", "Other", "c", None]], "g string")
    label, order = kernels.top_labels(df, "g", 3)
    assert order == ["a", "b", "(missing)", "Other"]
    counts = {r[0]: r[1] for r in df.groupBy(label.alias("g")).count().collect()}
    assert counts == {"a": 2, "b": 2, "(missing)": 1, "Other": 2}
    assert kernels.top_labels(df, "g", 9)[1] == ["a", "b", "(missing)", "Other", "c"]


def test_report_numbers_do_not_depend_on_the_route(spark):
    d = "/root/testdata/sf0.001"
    ev = inputs.table(spark, d, "events")
    pdf = ev.select("value").toPandas()
    r = stats.describe(ev, ["value"]).first()
    assert r["median"] == pytest.approx(pdf.value.median())
    assert r["kurtosis"] == pytest.approx(pdf.value.kurt(), rel=1e-9)
    hist = stats.histograms(ev, ["value"]).orderBy("bin").toPandas()
    counts, edges = np.histogram(pdf.value, bins=len(hist))
    assert hist["count"].tolist() == counts.tolist()
    assert hist.left.tolist() == pytest.approx(edges[:-1].tolist())
    pivot = relate.pivot(ev, "event_type", None, "value", "median").toPandas()
    want = ev.toPandas().groupby("event_type").value.median().round(4)
    assert pivot.set_index("row").value.to_dict() == pytest.approx(want.to_dict())


def test_equal_values_of_many_tasks_do_not_vary(spark):
    """49 times the double 1 / 49 is not 1, so the mean drifts when parts of 49 rows are merged."""
    df = spark.range(49 * 40, numPartitions=40).select(F.lit(1.0).alias("same"), F.col("id").cast("double").alias("up"))
    assert relate.eligible(df, ["same", "up"])[0] == ["up"]
    assert relate.spearman(df, ["same", "up"]) is None


def test_cells_meet_their_rows_in_bounded_tasks(spark, skewed, monkeypatch):
    """Tasks grow with the cells, and nothing is aggregated by row number before they are dealt."""
    monkeypatch.setattr(kernels, "CELLS", 200)
    df = frame(spark, skewed)
    whole = kernels.rank_table(df, ["v", "w"], ["v"], "id").rows
    assert whole.rdd.getNumPartitions() == 15  # 1500 rows of two cells
    plan = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    top, below = plan.split("REPARTITION_BY_NUM")[:2]
    assert "=[id#" in top and "Aggregate(key=[id#" not in below and "Aggregate(keys=[id#" not in below
