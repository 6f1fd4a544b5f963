"""Small hand-computed cases of the rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from profila import profile_table
from profila.functions import text
from profila.functions.tails import chi2_p, pearson_p
from profila.operators import compare, infer, quality, relate, stats
from profila.operators.timeseries import auto_frequency, timeseries
from profila.plans import defaults, views


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], f"_row long, v {kind}")


@pytest.mark.parametrize("written, value", [
    ("12", 12.0), (" 1 234 ", 1234.0), ("1,5", 15.0), ("5%", 5.0), ("(500)", -500.0), ("$1,200.50", 1200.5),
    ("1e3", 1000.0), ("-.5", -0.5), ("7.", 7.0), ("1d", None), ("1f", None), ("nan", None), ("inf", None),
    ("1e400", None), ("", None), ("%", None), ("1.2.3", None), ("(-5)", None), ("0x1F", None), ("٣", None),
])
def test_numbers(spark, written, value):
    assert column(spark, [written]).select(text.to_number(F.col("v"))).first()[0] == value


@pytest.mark.parametrize("written, value", [("1,5", 1.5), ("3.5", 35.0), ("1.234,5", 1234.5)])
def test_decimal_comma_numbers(spark, written, value):
    assert column(spark, [written]).select(text.to_number(F.col("v"), True)).first()[0] == value


def test_every_date_format_reads_its_own_rendering(spark):
    stamp = dt.datetime(2024, 3, 7, 14, 5, 9)
    for shown, _ in text.DATE_FORMATS:
        got = column(spark, [stamp.strftime(shown)]).select(text.to_date(F.col("v"), shown)).first()[0]
        assert got == dt.datetime.strptime(stamp.strftime(shown), shown), shown


def test_vote_prefers_day_first_and_earlier_formats():
    names = [n for n, _ in text.DATE_FORMATS]
    shares = [0.0] * 28
    shares[names.index("%d/%m/%Y")] = shares[names.index("%m/%d/%Y")] = 0.95
    assert infer.choose_format(shares) == ("%d/%m/%Y", True)
    shares[names.index("%m/%d/%Y")] = 0.97
    assert infer.choose_format(shares) == ("%m/%d/%Y", True)
    assert infer.choose_format([0.0] * 27 + [0.92]) == (text.AUTO_DETECTED, False)
    assert infer.choose_format([0.5] * 28) == (None, False)


@pytest.mark.parametrize("name, is_id", [
    ("id", True), ("Order_ID", True), ("user-key", True), ("S.No", True), ("Sr No", True), ("serial", True),
    ("uuid_v4", True), ("valid", False), ("o_orderkey", False), ("number", True), ("phone no", True), ("grid", False),
])
def test_id_names(name, is_id):
    assert infer.is_id_name(name) is is_id


def test_row_numbers_need_row_order(spark):
    n = 30
    df = spark.createDataFrame(
        [(i * 3, float(i + 5), float(n - i), float((i * 7) % n), None if i == 4 else float(i)) for i in range(n)],
        "_row long, up double, down double, mixed double, gap double")
    kinds = {c.name: c.type for c in profile_table("t", df).columns}
    assert kinds == {"up": "identifier", "down": "numeric", "mixed": "numeric", "gap": "numeric"}


def test_discrete_and_constant_columns(spark):
    df = spark.createDataFrame([(i, i % 4, 1.5, "x") for i in range(40)], "_row long, q int, c double, s string")
    ds = profile_table("t", df)
    assert ds.column("q").discrete and not ds.column("c").discrete
    assert ds.grouping() == ["q", "s"]
    issues = [(r["column"], r["text"]) for r in quality.issues(ds).collect()]
    same = "Every row has the same value, so this column carries no information."
    assert issues == [("c", same), ("s", same)]


def test_nan_and_infinity_are_missing(spark):
    df = column(spark, [1.0, float("nan"), float("inf"), None, 3.0], "double")
    c = profile_table("t", df).column("v")
    assert (c.non_null, c.missing, c.unique) == (2, 3, 2)
    r = stats.describe(df, ["v"]).first()
    assert (r["count"], r["missing"], r["mean"], r["skewness"], r["skew_label"]) == (2, 3, 2.0, None, "not enough data")


def test_statistics_of_tiny_columns(spark):
    r = stats.describe(column(spark, [5.0], "double"), ["v"]).first()
    assert (r["count"], r["std"], r["mode"], r["mode_count"], r["range"]) == (1, None, None, 1, 0.0)
    r = stats.describe(column(spark, [2.0] * 5, "double"), ["v"]).first()
    assert (r["skewness"], r["kurtosis"], r["mode"], r["std"]) == (0.0, 0.0, 2.0, 0.0)
    r = stats.describe(column(spark, [None, None], "double"), ["v"]).first()
    assert (r["count"], r["missing"], r["mean"], r["unique"]) == (0, 2, None, 0)


def test_bins():
    assert stats.bin_count(100, 0, 100, 25, 75) == 10
    assert stats.bin_count(100_000, 0, 1e6, 1, 2) == 60
    assert stats.bin_count(1000, 0, 5, 1, 1) == 11  # no spread: ceil(log2 n + 1)


def test_histogram_kinds(spark):
    whole = stats.histograms(column(spark, [3.0, 1.0, 3.0], "double"), ["v"]).orderBy("bin").collect()
    assert [(r["kind"], r["center"], r["count"]) for r in whole] == [("discrete", 1.0, 1), ("discrete", 3.0, 2)]
    parts = stats.histograms(column(spark, [0.5, 1.0, 3.0, 9.0], "double"), ["v"]).collect()
    assert len(parts) == 10 and sum(r["count"] for r in parts) == 4


def test_correlation_edges(spark):
    df = spark.createDataFrame(
        [(float(i), float(-i * i), 7.0, float(i) if i < 2 else None, float(i) if i > 4 else 1.0 * (i % 1)) for i in range(8)],
        "a double, b double, fixed double, few double, half double")
    found = relate.pearson(df, df.columns)
    assert found.columns == ["a", "b", "half"]
    assert relate.pearson(df, ["a", "fixed"]) is None
    gaps = df.withColumn("a", F.when(F.col("half") == 0, F.col("a")))
    pair = {(p["a"], p["b"]): p["r"] for p in relate.pearson(gaps, ["a", "half"]).pairs.collect()}
    assert pair == {("a", "half"): None}  # half is constant where a is present
    assert relate.spearman(df, ["a", "b"]).pairs.first()["r"] == pytest.approx(-1.0)


def test_more_than_25_columns(spark):
    df = spark.range(40).select(*[
        F.when(F.col("id") >= i, F.sin(F.col("id") * (i + 1))).alias(f"c{i}") for i in range(28)])
    found = relate.pearson(df, df.columns)
    assert not found.truncated and found.columns == df.columns
    assert found.ranked().count() == 28 * 27 // 2
    found = relate.pearson(df, df.columns, most=25)
    assert found.truncated and found.columns == [f"c{i}" for i in range(25)]
    assert found.ranked(30).count() == 30


def test_scatter(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + 1, "g") for i in range(10)], "id long, x double, y double, c string")
    r = relate.scatter_fit(df, "x", "y").first()
    assert (r["pearson"], r["spearman"], r["slope"], r["intercept"], r["n"]) == (1.0, 1.0, 2.0, 1.0, 10)
    assert (r["trend_x0"], r["trend_y0"], r["trend_x1"], r["trend_y1"]) == (0.0, 1.0, 9.0, 19.0)
    assert r["p_value"] < 1e-50 and r["strength"] == "strong positive"
    flat = relate.scatter_fit(df.withColumn("y", F.lit(1.0)), "x", "y").first()
    assert (flat["pearson"], flat["spearman"], flat["slope"], flat["p_value"]) == (None, None, None, None)
    assert flat["strength"] == "undefined"
    assert relate.scatter_points(df, "x", "y", ["id"], "c", limit=4).count() == 4
    with pytest.raises(ValueError, match="Fewer than 3 rows"):
        relate.scatter_fit(df.limit(2), "x", "y")
    with pytest.raises(ValueError, match="between 2 and 6"):
        relate.scatter_matrix(df, ["x"], ["id"])


def test_pivot_edges(spark):
    df = spark.createDataFrame([("a", "u", 1.0), ("a", "v", None), ("b", "u", None)], "r string, c string, x double")
    cells = {(r["row"], r["col"]): (r["value"], r["count"]) for r in relate.pivot(df, "r", "c", "x", "sum").collect()}
    assert cells == {("a", "u"): (1.0, 1), ("a", "v"): (0.0, 0), ("b", "u"): (0.0, 0), ("b", "v"): (None, 0)}
    counts = {r["row"]: r["count"] for r in relate.pivot(df, "r", None, "x", "count").collect()}
    assert counts == {"a": 2, "b": 1}
    with pytest.raises(ValueError, match="Unknown aggregation"):
        relate.pivot(df, "r", agg="mode")


def test_tails():
    assert pearson_p(0.5, 10) == pytest.approx(0.1411132812)
    assert pearson_p(1.0, 10) == 0.0 and pearson_p(None, 10) is None
    x, dof = 20.09, 8
    assert chi2_p(x, dof) == pytest.approx(math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(4)))
    assert chi2_p(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_p(0.0, 3) == 1.0


def test_chi2_agrees_with_spark_ml(spark):
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("a"),
                                 F.pmod(F.col("id") * F.col("id"), F.lit(5)).cast("string").alias("b"))
    mine = relate.crosstab(df, "a", "b").test().first()
    idx = StringIndexer(inputCols=["a", "b"], outputCols=["ai", "bi"]).fit(df).transform(df)
    row = ChiSquareTest.test(VectorAssembler(inputCols=["ai"], outputCol="f").transform(idx), "f", "bi").first()
    assert mine["chi2"] == pytest.approx(row["statistics"][0]) and mine["dof"] == row["degreesOfFreedom"][0]
    assert mine["p_value"] == pytest.approx(row["pValues"][0], abs=1e-12)


# --- time series -------------------------------------------------------------------------

def days(spark, values, start=dt.datetime(2024, 1, 1)):
    return spark.createDataFrame(
        [(start + dt.timedelta(days=i), v) for i, v in enumerate(values)], "d timestamp_ntz, v double")


@pytest.mark.parametrize("span, freq", [(92, "D"), (93, "W"), (730, "W"), (731, "M"), (5475, "M"), (5476, "Y")])
def test_auto_frequency(span, freq):
    assert auto_frequency(span) == freq


def test_series_arguments(spark):
    df = days(spark, [1.0, 2.0])
    with pytest.raises(ValueError, match="Unknown aggregation"):
        timeseries(df, "d", "v", "mode")
    with pytest.raises(ValueError, match="Unknown frequency"):
        timeseries(df, "d", "v", "sum", "H")
    with pytest.raises(ValueError, match="Not enough rows"):
        timeseries(df.limit(1), "d", "v")
    far = df.unionByName(days(spark, [1.0], dt.datetime(1990, 1, 1)))
    with pytest.raises(ValueError, match="Daily resolution would create about 12,419 points. Choose a coarser frequency"):
        timeseries(far, "d", "v", "sum", "D")


def test_gaps_sum_null_and_count_zero(spark):
    df = days(spark, [1.0, None, None, 4.0])
    points = timeseries(df, "d", "v", "sum", "D").points().collect()
    assert [(r["value"], r["ma"], r["count"]) for r in points] == [(1.0, 1.0, 1), (None, 1.0, 0), (None, 1.0, 0), (4.0, 2.5, 1)]
    counted = timeseries(df, "d", "v", "count", "D").points().collect()
    assert [r["value"] for r in counted] == [1.0, 0.0, 0.0, 1.0]
    s = timeseries(df, "d", "v", "sum", "D").summary().first()
    assert (s["periods"], s["periods_with_data"], s["empty_periods"], s["missing_values"], s["trend"]) == (4, 2, 2, 2, None)


def test_weeks_start_on_monday(spark):
    df = days(spark, [1.0] * 15, dt.datetime(2024, 1, 7, 15))  # a Sunday afternoon
    points = timeseries(df, "d", "v", "count", "W").points().collect()
    assert [(str(r["period"]), r["count"]) for r in points] == [
        ("2024-01-01", 1), ("2024-01-08", 7), ("2024-01-15", 7)]


def test_trend_and_anomaly(spark):
    values = [10.0 + i for i in range(40)]
    values[20] += 100
    ts = timeseries(days(spark, values), "d", "v", "sum", "D")
    found = ts.anomalies().collect()
    assert [(str(r["period"]), r["direction"]) for r in found] == [("2024-01-21", "above")]
    s = ts.summary().first()
    assert s["trend"] == "increasing" and str(s["peak_period"]) == "2024-01-21" and s["first_to_last_pct"] == 390.0
    assert timeseries(days(spark, [5.0] * 10), "d", "v").summary().first()["trend"] == "roughly flat"
    assert timeseries(days(spark, [5.0] * 10), "d", "v").anomalies().count() == 0


def test_seasons_need_enough_data(spark):
    ts = timeseries(days(spark, [1.0] * 13), "d", "v")
    assert ts.season_weekday().count() == 0 and ts.season_month().count() == 0 and ts.season_hour().count() == 0
    full = timeseries(days(spark, [float(i % 7) for i in range(400)]), "d", "v")
    best = {r["label"] for r in full.season_weekday().where("peak").collect()}
    assert best == {"Sun"} and full.season_month().count() == 12


# --- comparison and defaults -------------------------------------------------------------

def test_compare_sets(spark):
    a = profile_table("a", spark.createDataFrame([(i, "x" if i % 2 else "y", 1.0 * i * i) for i in range(30)], "_row long, g string, v double"))
    b = profile_table("b", spark.createDataFrame([(i, "x" if i % 2 else "z", 2.0 * i * i) for i in range(30)], "_row long, g string, v double"))
    r = compare.compare_categorical(a, b).first()
    assert (r["new_in_b"], r["new_count"], r["missing_in_b"], r["missing_count"]) == (["z"], 1, ["y"], 1)
    n = compare.compare_numeric(a, b).first()
    assert n["mean_change_pct"] == pytest.approx(100.0)


def test_roles(spark):
    ds = profile_table("t", spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "_row long, g string, v double"))
    assert ds.require("v", "the X axis", "numeric") == "v"
    with pytest.raises(ValueError, match="'g' cannot be used as the X axis"):
        ds.require("g", "the X axis", "numeric")
    with pytest.raises(ValueError, match="does not exist"):
        ds.require("nope", "the X axis", "numeric")


def test_views_check_their_arguments(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "xy"[i % 2], i % 3, 1.5 * i) for i in range(30)]
    ds = profile_table("t", spark.createDataFrame(rows, "_row long, day timestamp_ntz, g string, q int, v double"))
    fit, points = views.scatter(ds, "q", "v", "g")
    assert fit.first()["n"] == 30 and points.count() == 30
    assert views.scatter_matrix(ds, ["q", "v"]).count() == 30
    assert views.pivot(ds, "q", "g").count() == 6
    assert views.crosstab(ds, "g", "q").test().first()["dof"] == 2
    assert views.timeseries(ds, "day", "v").points().count() == 30
    for call, words in (
        (lambda: views.scatter(ds, "g", "v"), "'g' cannot be used as the X axis"),
        (lambda: views.scatter(ds, "v", "v"), "two different columns for X and Y"),
        (lambda: views.scatter(ds, "q", "v", "v"), "'v' cannot be used as a colour group"),
        (lambda: views.scatter_matrix(ds, ["v", "day"]), "'day' cannot be used as a scatter-matrix column"),
        (lambda: views.pivot(ds, "v"), "'v' cannot be used as pivot rows"),
        (lambda: views.pivot(ds, "g", "g"), "different columns for rows and columns"),
        (lambda: views.crosstab(ds, "g", "g"), "two different columns"),
        (lambda: views.timeseries(ds, "v"), "'v' cannot be used as a date column"),
        (lambda: views.timeseries(ds, "day", "g"), "'g' cannot be used as a time-series value"),
        (lambda: views.pivot(ds, "nope"), "Column 'nope' does not exist"),
    ):
        with pytest.raises(ValueError, match=words):
            call()


def test_default_measure(spark):
    df = spark.createDataFrame([(i, i * 1.5, i * 2.5, i * 3.5) for i in range(30)], "_row long, height double, unit_cost double, Sales double")
    assert defaults.measure(profile_table("t", df)) == ("Sales", "sum")
    assert defaults.measure(profile_table("t", df.select("_row", "height"))) == ("height", "mean")
    assert defaults.measure(profile_table("t", df.select("_row", F.lit("x").alias("s")))) == (None, "count")


def test_reads_are_split_finely_but_never_coarser(spark):
    from profila.session import SPLIT_BYTES, use_utc

    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for given, used in (("128m", str(SPLIT_BYTES)), ("1m", "1m")):
            spark.conf.set(name, given)
            use_utc(spark)
            assert spark.conf.get(name) == used
    finally:
        spark.conf.set(name, before)
