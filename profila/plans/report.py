"""The full report of a dataset as a set of tidy tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profila.model import NUMERIC, ROW, Dataset
from profila.operators import quality, relate, stats
from profila.operators.kernels import settled
from profila.operators.timeseries import TimeSeries, timeseries
from profila.plans import defaults
from profila.plans.findings import findings
from profila.session import together
from profila.sources.cleaned import preview


def build_report(ds: Dataset) -> dict[str, DataFrame]:
    """Run the whole programme. Metric tables are bounded by columns, labels and periods and
    are settled here; the row-level table is cached while the report is built."""
    ds.compared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ds.compared.count()
        out: dict[str, DataFrame] = {
            "schema": ds.schema_table(), "type_counts": defaults.type_counts(ds),
            "quality_columns": quality.per_column(ds), "issues": quality.issues(ds), "charts": defaults.charts(ds),
        }
        if ds.load_report is not None:
            out["load"] = ds.load_report
        for tables in together(ds.spark, *_sections(ds)):
            out |= tables
        pairs = [(r["a"], r["b"]) for r in out["pearson_pairs"].collect()] if "pearson_pairs" in out else []
        out["defaults"] = defaults.defaults(ds, pairs)
        out["sections"] = defaults.sections(
            ds, "pearson_pairs" in out, "outliers" in out and not out["outliers"].isEmpty())
        out["findings"] = findings(ds, out)
        return out
    finally:
        ds.compared.unpersist()


def _sections(ds: Dataset) -> list:
    """Independent parts of the report as tasks returning named tables."""
    table, groups = ds.table, defaults.category_columns(ds)
    tasks = [
        lambda: {"quality": settled(quality.overview(ds))}, lambda: {"preview": settled(preview(ds))}]
    if ds.names(NUMERIC):
        tasks.append(lambda: _numeric(ds))
    if defaults.date_column(ds):
        tasks.append(lambda: _default_series(ds))
    if groups:
        tasks += [lambda: {"categories": settled(stats.category_summary(table, groups))},
                  lambda: {"category_bars": settled(stats.category_bars(table, groups))}]
    return tasks


def _numeric(ds: Dataset) -> dict[str, DataFrame]:
    """Everything that builds on the numeric profile, which is measured once."""
    table, cols = ds.table, ds.names(NUMERIC)
    profile = stats.numeric_profile(table, cols)
    out = {"statistics": stats.describe(table, cols, profile)}

    def spread() -> dict[str, DataFrame]:
        one = settled(stats.spread_table(table, cols, profile))
        return {"boxes": stats.box_stats(table, cols, one), "outliers": stats.outlier_table(table, cols, one)}

    for tables in together(
        ds.spark,
        lambda: _correlation(relate.spearman, ds, profile, row=ROW), lambda: _correlation(relate.pearson, ds, profile),
        lambda: {"histograms": settled(stats.histograms(table, cols, profile))}, spread,
        lambda: {"outlier_extremes": settled(stats.outlier_extremes(table, cols, ROW, profile=profile))},
    ):
        out |= tables
    return out


def _correlation(method, ds: Dataset, profile: DataFrame, **options) -> dict[str, DataFrame]:
    found = method(ds.table, ds.names(NUMERIC), profile, **options)
    if not found:
        return {}
    found.pairs = settled(found.pairs)
    return {f"{found.method}_matrix": found.matrix(), f"{found.method}_pairs": settled(found.ranked())}


def _default_series(ds: Dataset) -> dict[str, DataFrame]:
    value, agg = defaults.measure(ds)
    try:
        return series_tables(timeseries(ds.table, defaults.date_column(ds), value, agg))
    except ValueError as problem:
        return {"series_error": ds.spark.createDataFrame([(str(problem),)], "error string")}


def series_tables(ts: TimeSeries) -> dict[str, DataFrame]:
    """The tables of one time series."""
    named = ts.summary().select(
        F.lit(ts.date).alias("date"), F.lit(ts.value).alias("value"), F.lit(ts.agg).alias("agg"),
        F.lit(ts.freq).alias("freq"), F.lit(ts.freq_label).alias("freq_label"),
        F.lit(ts.ma_label).alias("ma_label"), "*")
    ts.periods  # settled before the tasks share it
    build = {
        "series_summary": lambda: named, "series_points": ts.points, "series_anomalies": ts.anomalies,
        "series_month": ts.season_month, "series_weekday": ts.season_weekday, "series_hour": ts.season_hour,
    }
    return dict(zip(build, together(ts.frame.sparkSession, *[lambda b=b: settled(b()) for b in build.values()])))
