"""Full reports over small rebuilt versions of typical files."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from profila import build_report, load_csv
from profila.operators import compare, quality, relate
from profila.operators.timeseries import FREQUENCIES, timeseries
from profila.sources.cleaned import write_cleaned_csv


def students(n=600):
    rng = np.random.default_rng(1)
    study = np.clip(rng.normal(4.5, 1.8, n), 0.5, 10).round(1)
    df = pd.DataFrame({
        "Student_ID": [f"S{i:04d}" for i in range(1, n + 1)],
        "Gender": rng.choice(["Male", "Female"], n),
        "Department": rng.choice(["Science", "Commerce", "Arts", "Engineering"], n),
        "Age": rng.integers(17, 24, n),
        "Attendance_Pct": np.clip(rng.normal(80, 10, n), 40, 100).round(1).astype(object),
        "Study_Hours": study,
        "Final_Marks": np.clip(15 + study * 6 + rng.normal(0, 7, n), 0, 100).round(0),
        "Enrollment_Date": [(dt.date(2023, 6, 1) + dt.timedelta(days=int(x))).strftime("%d/%m/%Y") for x in rng.integers(0, 800, n)],
    })
    df.loc[:24, "Attendance_Pct"] = np.nan
    df.loc[30:33, "Attendance_Pct"] = "absent"
    df.loc[40:51, "Gender"] = "M"
    df.loc[60:65, "Gender"] = "female"
    df.loc[70:84, "Study_Hours"] = np.nan
    df.loc[90:92, "Study_Hours"] = [22.0, 25.5, 30.0]
    return pd.concat([df, df.iloc[100:108]], ignore_index=True)


def weather():
    rng = np.random.default_rng(2)
    days = pd.date_range("2023-01-01", "2025-12-31", freq="D")
    parts = [pd.DataFrame({
        "Date": days.strftime("%Y-%m-%d"), "City": city,
        "Temperature_C": (base + 6 * np.sin(days.dayofyear / 365 * 6.28) + rng.normal(0, 1.5, len(days))).round(1),
        "Rainfall_mm": rng.gamma(0.3, 2, len(days)).round(1), "AQI": rng.normal(90, 40, len(days)).round(0),
    }) for city, base in (("Chennai", 29), ("Delhi", 25), ("Mumbai", 28))]
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("samples")
    students().to_csv(folder / "students.csv", index=False)
    weather().to_csv(folder / "weather.csv", index=False, sep=";")
    return {n: load_csv(spark, str(folder / f"{n}.csv")) for n in ("students", "weather")}


@pytest.fixture(scope="module")
def student_report(loaded):
    return build_report(loaded["students"])


def test_student_schema(loaded):
    ds = loaded["students"]
    assert {c.name: c.type for c in ds.columns} == {
        "Student_ID": "identifier", "Gender": "categorical", "Department": "categorical", "Age": "numeric",
        "Attendance_Pct": "numeric", "Study_Hours": "numeric", "Final_Marks": "numeric", "Enrollment_Date": "datetime"}
    assert ds.column("Age").discrete
    assert ds.column("Enrollment_Date").date_format == "%d/%m/%Y"
    a = ds.column("Attendance_Pct")
    assert (a.missing, a.invalid, a.invalid_examples) == (25, 4, ["absent"])
    assert ds.column("Gender").case_variants == [["Female", "female"]]
    assert ds.column("Gender").abbreviations == [["M", "Male"]]


def test_student_quality(loaded, student_report):
    q = student_report["quality"].first()
    assert (q["duplicate_rows"], q["duplicate_examples"]) == (8, list(range(601, 609)))
    texts = [r["text"] for r in student_report["issues"].collect()]
    assert texts == [
        "8 repeated value(s) in an ID column; IDs are usually unique.",
        'Same value written with different capitalisation: "Female", "female".',
        '"M" may be an abbreviation of "Male". Check whether they mean the same thing.',
        '4 value(s) could not be read as numbers (e.g. "absent"). They are treated as missing.']


def test_student_statistics_match_pandas(student_report):
    pdf = students()
    got = {r["column"]: r for r in student_report["statistics"].collect()}
    for name in ("Attendance_Pct", "Study_Hours", "Final_Marks", "Age"):
        v, r = pd.to_numeric(pdf[name], errors="coerce"), got[name]
        assert (r["count"], r["missing"], r["unique"]) == (v.count(), v.isna().sum(), v.nunique())
        for mine, want in (("mean", v.mean()), ("std", v.std()), ("median", v.median()), ("q1", v.quantile(0.25)),
                           ("p95", v.quantile(0.95)), ("skewness", v.skew()), ("kurtosis", v.kurt())):
            assert r[mine] == pytest.approx(want, rel=1e-9), (name, mine)
        assert r["mode"] == v.mode()[0] and r["mode_count"] == (v == v.mode()[0]).sum()


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_student_correlations_match_pandas(student_report, method):
    cols = ["Age", "Attendance_Pct", "Study_Hours", "Final_Marks"]
    pdf = students()[cols].apply(pd.to_numeric, errors="coerce")
    want = pdf.corr(method=method, min_periods=3)
    got = student_report[f"{method}_matrix"].collect()
    assert len(got) == 16
    for r in got:
        assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]], abs=6e-5)


def test_student_findings(student_report):
    rows = [(r["area"], r["level"], r["text"]) for r in student_report["findings"].collect()]
    areas = [r[0] for r in rows]
    assert areas == ["Overview", "Data quality", "Data quality", "Data quality", "Data quality", "Relationships",
                     "Outliers", "Time series", "Columns"] or "Distributions" in areas
    assert rows[0][2] == "608 rows and 8 columns were analysed: 4 numeric, 2 categorical, 1 date/time, 1 ID."
    assert rows[1][1] == "info" and rows[1][2].startswith(
        "0.8% of all cells are missing, spread across 2 column(s). Most affected: Attendance_Pct (4.1%), Study_Hours (2.5%).")
    assert rows[2][2] == "8 row(s) (1.3%) are exact duplicates of an earlier row."
    assert rows[3][2] == "Some values do not match their column's type: Attendance_Pct (4)."
    assert rows[4][2] == "Possible inconsistent category spellings in: Gender."
    assert "between Study_Hours and Final_Marks (r = 0." in rows[5][2] and "tend to rise together. 1 pair(s)" in rows[5][2]
    assert rows[-1][2] == "Treated as identifiers and left out of statistics: Student_ID."
    series = next(t for a, _, t in rows if a == "Time series")
    assert series.startswith("Monthly average of Attendance_Pct over Enrollment_Date is ")


def test_student_report_is_complete(student_report):
    assert set(student_report) == {
        "schema", "type_counts", "quality_columns", "issues", "charts", "load", "quality", "preview", "statistics",
        "boxes", "outliers", "histograms", "outlier_extremes", "pearson_matrix", "pearson_pairs", "spearman_matrix",
        "spearman_pairs", "categories", "category_bars", "series_summary", "series_points", "series_anomalies",
        "series_month", "series_weekday", "series_hour", "defaults", "sections", "findings"}
    assert student_report["preview"].count() == 50
    sections = {r["section"]: r["available"] for r in student_report["sections"].collect()}
    assert all(sections.values())
    charts = {(r["column"], r["chart"]) for r in student_report["charts"].collect()}
    assert {("Gender", "pie"), ("Age", "bar"), ("Age", "histogram"), ("Enrollment_Date", "line")} <= charts
    assert ("Student_ID", "bar") not in charts
    chosen = {(r["analysis"], r["argument"]): r["value"] for r in student_report["defaults"].collect()}
    assert chosen["crosstab", "a"] == "Gender" and chosen["pivot", "values"] == "Attendance_Pct"
    assert chosen["scatter_matrix", "column_1"] == "Study_Hours"


def test_student_views(loaded):
    ds = loaded["students"]
    fit = relate.scatter_fit(ds.table, "Study_Hours", "Final_Marks").first()
    assert fit["pearson"] > 0.5 and 0 <= fit["p_value"] < 1e-10
    groups = {r["group"] for r in relate.scatter_points(ds.table, "Study_Hours", "Final_Marks", ["_row"], "Gender").collect()}
    assert groups == {"Male", "Female", "M", "female"}
    table = relate.pivot(ds.table, "Department", "Gender", "Final_Marks", "mean")
    assert table.count() == 16
    assert relate.crosstab(ds.table, "Department", "Gender").test().first()["chi2"] is not None


def test_deduplicated_download(loaded, tmp_path):
    write_cleaned_csv(loaded["students"], str(tmp_path), remove_duplicates=True)
    lines = [x for p in tmp_path.glob("*/part-*.csv") for x in p.read_text(encoding="utf-8-sig").splitlines()]
    assert len([x for x in lines if "Student_ID" not in x]) == 600


def test_decimal_points_stay_in_a_semicolon_file(loaded):
    ds = loaded["weather"]
    assert ds.column("Temperature_C").type == "numeric" and ds.load_report.first()["notes"] == []
    assert ds.column("Date").date_format == "%Y-%m-%d"


@pytest.mark.parametrize("freq", list(FREQUENCIES))
@pytest.mark.parametrize("agg", ["sum", "median", "count"])
def test_resampling_matches_pandas(loaded, freq, agg):
    ts = timeseries(loaded["weather"].table, "Date", "Temperature_C", agg, freq)
    pdf = weather()
    series = pd.Series(pdf.Temperature_C.values, index=pd.to_datetime(pdf.Date)).sort_index()
    alias = {"D": "D", "W": "W", "M": "ME", "Q": "QE", "Y": "YE"}[freq]
    want = series.resample(alias).agg(agg)
    got = ts.points().toPandas()
    assert got.value.tolist() == pytest.approx(want.astype(float).tolist())
    assert got.ma.tolist() == pytest.approx(want.rolling(ts.window, min_periods=1).mean().tolist())


def test_compare_different_tables(loaded):
    diff = {r["name"]: r["status"] for r in compare.schema_diff(loaded["students"], loaded["weather"]).collect()}
    assert set(diff.values()) == {"only_a", "only_b"}
    assert compare.compare_numeric(loaded["students"], loaded["weather"]).count() == 0
    assert compare.compare_categorical(loaded["students"], loaded["weather"]).count() == 0
    sides = {r["side"]: r["duplicates"] for r in compare.compare_overview(loaded["students"], loaded["weather"]).collect()}
    assert sides == {"a": 8, "b": 0}


def test_empty_date_series_becomes_an_error(spark):
    from profila import profile_table

    df = spark.createDataFrame([(i, dt.datetime(1900 + 4 * i, 1, 1), 1.5 * i) for i in range(3)], "_row long, d timestamp_ntz, v double")
    rep = build_report(profile_table("t", df.where("_row < 1").unionByName(df.where("_row >= 2"))))
    assert "series_summary" in rep
    one = build_report(profile_table("t", df.where("_row = 1")))
    assert one["series_error"].first()[0] == "Not enough rows with a valid date to build a time series."


def test_quality_of_small_tables(loaded):
    q = quality.per_column(loaded["weather"]).where("missing > 0").count()
    assert q == 0
