"""Registered queries: every operator over the given tables. Doubles are rounded so that the
order of summation does not show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profila.functions.text import quoted
from profila.functions import text
from profila.model import ROW
from profila.operators import compare, infer, kernels, quality, relate, stats
from profila.operators.timeseries import timeseries
from profila.plans import defaults, inputs
from profila.plans.inputs import RELATED, table
from profila.plans.report import build_report
from profila.session import staging_path
from profila.sources.cleaned import cleaned_rows, preview, write_cleaned_csv
from profila.sources.delimited import load_csv
from profila.sources.tables import load_parquet, profile_table, read_parquet

Query = Callable[[SparkSession, str], DataFrame]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRIORITY, STATUS, PRICE, DATE = "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double; ``special`` overrides the digits of single columns."""
    return df.select(*[
        F.round(quoted(f.name), special.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(quoted(f.name))
        for f in df.schema.fields])


def joined(df: DataFrame, *names: str) -> DataFrame:
    """Arrays of strings as one string."""
    return df.withColumns({n: F.array_join(n, " | ") for n in names})


# --- sources and sinks -------------------------------------------------------------------

def parquet_rows(spark, d):
    return read_parquet(spark, f"{d}/orders.parquet").select(
        ROW, "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def csv_rows(spark, d):
    ds = load_csv(spark, inputs.orders_csv(spark, d), "orders.csv")
    return rounded(ds.table.drop(ROW), 2)


def csv_profile(spark, d):
    ds = load_csv(spark, inputs.orders_csv(spark, d), "orders.csv")
    return ds.schema_table().select(
        "name", "type", "dtype_label", "non_null", "missing", "invalid", "unique", "date_format", "whitespace_fixed")


def csv_load_report(spark, d):
    r = load_csv(spark, inputs.orders_csv(spark, d), "orders.csv").load_report
    return joined(r, "empty_columns_removed", "notes").drop("missing_markers")


def csv_cleaned(spark, d):
    """Repeated orders written as cleaned CSV without duplicates, read back as text."""
    ds = profile_table("orders.csv", inputs.orders_repeated(spark, d))
    target = write_cleaned_csv(ds, staging_path(spark, "cleaned"), remove_duplicates=True)
    schema = T.StructType([T.StructField(c.name, T.StringType()) for c in ds.columns])
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(target)


def csv_odd_headers(spark, d):
    """A file whose header has dots, repeats, backticks, blanks and names that differ by case alone."""
    ds = load_csv(spark, inputs.odd_csv(spark, d), "odd.csv")
    found = stats.describe(ds.table, ds.names("numeric", "identifier")).select(
        F.col("column").alias("name"), "count", F.round("mean", 4).alias("mean"), "max")
    return ds.schema_table().select("name", "type", "non_null").join(found, "name", "left")


def csv_late_comma(spark, d):
    """One in a hundred values has a decimal comma; the notes of the first rows hold commas instead of text."""
    ds = load_csv(spark, inputs.late_comma_csv(spark, d), "late.csv")
    return rounded(ds.table.drop(ROW), 2)


def csv_late_report(spark, d):
    r = load_csv(spark, inputs.late_comma_csv(spark, d), "late.csv").load_report
    return joined(r, "empty_columns_removed", "notes").drop("missing_markers")


def parquet_odd_names(spark, d):
    """Correlations and label counts of columns with dots, backticks and names that differ by case alone."""
    ds = load_parquet(spark, inputs.odd_parquet(spark, d))
    pairs = relate.spearman(ds.table, ["o.key", "`price`", "PRICE"], row=ROW).pairs
    labels = stats.label_counts(ds.table, ["Status.", "status."])
    return pairs.select("a", "b", F.round("r", 6).alias("r"), "n").unionByName(
        labels.select(F.col("column").alias("a"), F.col("label").alias("b"), F.lit(None).cast("double").alias("r"), "n"))


def preview50(spark, d):
    return preview(inputs.orders(spark, d))


# --- type inference ----------------------------------------------------------------------

def schema_profile(spark, d):
    s = inputs.orders_text(spark, d).schema_table()
    return rounded(s.select(
        "name", "type", "dtype_label", "non_null", "missing", "missing_pct", "invalid", "discrete", "unique",
        "unique_pct", "date_format", "min_date", "max_date"))


def schema_examples(spark, d):
    s = inputs.orders_text(spark, d).schema_table()
    return joined(s.select("name", "samples", "invalid_examples", "notes"), "samples", "invalid_examples", "notes")


def type_counts(spark, d):
    return defaults.type_counts(inputs.orders_text(spark, d))


def numeric_parse(spark, d):
    o = inputs.orders_as_text(spark, d)
    return o.select(ROW, *[text.to_number(F.col(c)).alias(c) for c in ("order_id", "price", "mixed_price", "day")])


def date_parse(spark, d):
    o = inputs.orders_as_text(spark, d)
    return o.select(ROW, text.to_date(F.col("day"), "%d/%m/%Y").alias("day"), text.any_date(F.col("zoned")).alias("zoned"))


def date_vote(spark, d):
    """Share of values each of the 27 formats reads, for three renderings of the order date."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias(ROW),
        F.date_format(DATE, "dd/MM/yyyy").alias("day_first"), F.date_format(DATE, "yyyy-MM-dd HH:mm").alias("stamp"),
        F.date_format(DATE, "d MMMM yyyy").alias("words"))
    votes = infer.date_votes(kernels.value_counts(o, ["day_first", "stamp", "words"], first=ROW))
    names = F.array(*[F.lit(n) for n, _ in text.DATE_FORMATS])
    pairs = F.arrays_zip(F.slice("shares", 1, len(text.DATE_FORMATS)).alias("share"), names.alias("fmt"))
    return rounded(votes.select("column", F.inline(pairs)))


def identifier_flags(spark, d):
    """Identifier, row-number and discrete rules over typed lineitem and customer columns."""
    c = table(spark, d, "customer").select((F.col("c_custkey") + 1).alias(ROW), "*", F.col("c_custkey").alias("place"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias(ROW), "p_partkey", "p_size", (-F.col("p_partkey")).alias("backwards"),
                                       (F.col("p_partkey") % 7).alias("weekday"))
    tables = [profile_table("customer", c).schema_table(), profile_table("part", p).schema_table()]
    return tables[0].unionByName(tables[1]).select("name", "type", "dtype_label", "discrete", "unique", "non_null")


def text_kinds(spark, d):
    """Free text, text identifiers and categories of documents and part."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias(ROW), "text", "lang", "source")
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias(ROW), "p_name", "p_brand", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("part_code"))
    both = profile_table("documents", docs).schema_table().unionByName(profile_table("part", parts).schema_table())
    return rounded(both.select("name", "type", "dtype_label", "unique", "unique_pct"))


def _spelled(spark, d):
    return kernels.value_counts(inputs.segments(spark, d), ["segment"], first=ROW)


def case_variants(spark, d):
    return joined(infer.case_variants(_spelled(spark, d)), "spellings")


def abbreviations(spark, d):
    """Segments shortened to one or two letters, beside part names, whose first letters are ambiguous."""
    short = kernels.value_counts(inputs.short_segments(spark, d), ["segment"], first=ROW)
    p = table(spark, d, "part").select(F.col("p_partkey").alias(ROW), F.when(
        F.col("p_partkey") % 9 == 0, F.substring("p_name", 1, 1)).otherwise(F.col("p_name")).alias("p_name"))
    return infer.abbreviations(short.unionByName(kernels.value_counts(p, ["p_name"], first=ROW)))


def sample_values(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias(ROW), STATUS, PRIORITY)
    first = infer.first_values(kernels.value_counts(o, [STATUS, PRIORITY], first=ROW))
    return first.select("column", F.col("_nth").alias("position"), "value")


# --- statistics --------------------------------------------------------------------------

def _described(df):
    return rounded(df, 6, mean=4, std=4, variance=0, sum=2, median=4, p5=4, q1=4, q3=4, p95=4, iqr=4, range=4)


def describe_lineitem(spark, d):
    return _described(stats.describe(table(spark, d, "lineitem"), MEASURES))


def describe_events_gaps(spark, d):
    return _described(stats.describe(inputs.events_gaps(spark, d), ["value", "user_id"]))


def quantiles_wide(spark, d):
    """Quantiles of values over 600 powers of ten, shown as logarithms; equal widths would put all into one cell."""
    wide = table(spark, d, "events").select(
        "event_type", (F.exp((F.col("event_id") * 7919 % 7001) / 10.0) * F.lit(1e-290)).alias("v"))
    q = kernels.quantiles(wide, ["event_type"], "v", (0.01, 0.25, 0.5, 0.75, 0.99))
    names = ("p1", "q1", "median", "q3", "p99")
    return rounded(q.select("event_type", "n", *[F.log(F.get("q", F.lit(i))).alias(c) for i, c in enumerate(names)]))


def hist_discrete(spark, d):
    return stats.histograms(table(spark, d, "lineitem"), ["l_linenumber"])


def hist_binned(spark, d):
    return rounded(stats.histograms(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"]), 4)


def box_stats(spark, d):
    return rounded(stats.box_stats(table(spark, d, "events"), ["value", "user_id"]), 4)


def box_outlier_points(spark, d):
    return stats.box_points(table(spark, d, "events"), ["value"], "event_id")


def box_outliers_all(spark, d):
    """Every outlier, as a box plot shows them while they are few."""
    return stats.box_points(table(spark, d, "events"), ["value"], "event_id", limit=None).select("column", "event_id", "value")


def outlier_table(spark, d):
    return rounded(stats.outlier_table(table(spark, d, "events"), ["value", "user_id"]), 4)


def outlier_extremes(spark, d):
    return stats.outlier_extremes(table(spark, d, "events"), ["value"], "event_id")


def value_counts(spark, d):
    return stats.label_counts(table(spark, d, "part"), ["p_name", "p_brand", "p_size"])


def category_bars(spark, d):
    return rounded(stats.category_bars(table(spark, d, "part"), ["p_name", "p_brand", "p_size"]), 4)


def category_summary(spark, d):
    return rounded(stats.category_summary(inputs.events_gaps(spark, d), ["event_type", "user_id"]), 4)


def top_n_other(spark, d):
    p = table(spark, d, "part")
    label, order = kernels.top_labels(p, "p_name", 10)
    counts = p.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return kernels.label_table(spark, order, "label", "position").join(counts, "label")


# --- quality -----------------------------------------------------------------------------

def _repeated(spark, d):
    return profile_table("orders", inputs.orders_repeated(spark, d))


def quality_overview(spark, d):
    q = quality.overview(_repeated(spark, d))
    return rounded(q.withColumn("duplicate_examples", F.array_join(F.transform(
        "duplicate_examples", lambda r: r.cast("string")), ",")))


def quality_columns(spark, d):
    return rounded(joined(quality.per_column(inputs.orders_text(spark, d)), "invalid_examples"))


def quality_issues(spark, d):
    return quality.issues(inputs.orders_text(spark, d)).drop("seq")


def duplicate_rows(spark, d):
    return quality.duplicate_examples(inputs.orders_repeated(spark, d))


def repeated_ids(spark, d):
    copies = inputs.orders_repeated(spark, d).withColumnRenamed("o_orderkey", "order_id")
    return quality.issues(profile_table("orders", copies)).drop("seq")


def dedupe_rows(spark, d):
    return cleaned_rows(_repeated(spark, d), remove_duplicates=True)


# --- relationships -----------------------------------------------------------------------

def corr_pearson(spark, d):
    return relate.pearson(inputs.related(spark, d), RELATED).matrix()


def corr_pearson_gaps(spark, d):
    return relate.pearson(inputs.related(spark, d, gaps=True), RELATED).matrix()


def corr_pairs(spark, d):
    return rounded(relate.pearson(inputs.related(spark, d, gaps=True), RELATED).ranked())


def corr_spearman(spark, d):
    return relate.spearman(inputs.related(spark, d), RELATED).matrix()


def corr_spearman_gaps(spark, d):
    return relate.spearman(inputs.related(spark, d, gaps=True), RELATED).matrix()


def scatter_fit(spark, d):
    return rounded(relate.scatter_fit(inputs.related(spark, d), "qty", "net").drop("p_value"), 4)


def scatter_points(spark, d):
    return relate.scatter_points(
        table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"])


def scatter_all_colored(spark, d):
    """All points, as a scatter plot shows them while they are few."""
    points = relate.scatter_points(
        inputs.events_gaps(spark, d), "user_id", "value", ["event_id"], "event_type", limit=None)
    return points.groupBy("group").agg(
        F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("sum_x"), F.round(F.sum("y"), 2).alias("sum_y"))


def scatter_matrix_all(spark, d):
    cols = ["qty", "net", "falling"]
    rows = relate.scatter_matrix(inputs.related(spark, d, gaps=True), cols, ["l_orderkey", "l_linenumber"], limit=None)
    return rows.agg(F.count("*").alias("n"), *[F.round(F.sum(c), 1).alias(c) for c in cols])


def scatter_colored(spark, d):
    return relate.scatter_points(inputs.events_gaps(spark, d), "user_id", "value", ["event_id"], "event_type")


def scatter_matrix(spark, d):
    return relate.scatter_matrix(
        table(spark, d, "lineitem"), MEASURES[:3], ["l_orderkey", "l_linenumber"])


def _pivot(agg: str) -> Query:
    return lambda spark, d: relate.pivot(table(spark, d, "orders"), PRIORITY, None, PRICE, agg)


def pivot_2way(spark, d):
    return relate.pivot(table(spark, d, "orders"), PRIORITY, STATUS, PRICE, "mean")


def pivot_2way_median(spark, d):
    return relate.pivot(table(spark, d, "orders"), PRIORITY, STATUS, PRICE, "median")


def pivot_2way_other(spark, d):
    return relate.pivot(table(spark, d, "part"), "p_name", "p_brand", None, "count")


def pivot_missing_label(spark, d):
    ev = inputs.events_gaps(spark, d).withColumn(
        "value", F.when(F.col("event_type").isNotNull(), F.col("value")))
    return relate.pivot(ev, "event_type", None, "value", "sum")


def crosstab_counts(spark, d):
    return relate.crosstab(table(spark, d, "orders"), PRIORITY, STATUS).cells


def crosstab_other(spark, d):
    return relate.crosstab(table(spark, d, "part"), "p_name", "p_brand").cells


def crosstab_chi2(spark, d):
    return rounded(relate.crosstab(table(spark, d, "orders"), PRIORITY, STATUS).test(), 5)


def crosstab_chi2_other(spark, d):
    return rounded(relate.crosstab(table(spark, d, "part"), "p_name", "p_brand").test(), 5)


# --- time series -------------------------------------------------------------------------

def _series(freq: str, agg: str = "sum", digits: int = 5) -> Query:
    return lambda spark, d: rounded(
        timeseries(table(spark, d, "orders"), DATE, PRICE, agg, freq).points(), digits)


def _gappy(spark, d):
    ev = inputs.events_gaps(spark, d).where("ts is null or day(ts) % 2 = 0")
    return ev


def ts_gaps(spark, d):
    return rounded(timeseries(_gappy(spark, d), "ts", "value", "sum", "D").points(), 5)


def ts_gaps_count(spark, d):
    return rounded(timeseries(_gappy(spark, d), "ts", None, "sum", "D").points(), 6)


def ts_summary(spark, d):
    s = timeseries(_gappy(spark, d), "ts", "value", "sum", "D").summary()
    return rounded(s, 4)


def ts_trend(spark, d):
    s = timeseries(table(spark, d, "orders"), DATE, PRICE, "sum", "M").summary()
    return rounded(s.select(
        "trend", "trend_slope_per_period", "trend_change_pct_of_mean", "first_value", "last_value", "first_to_last_pct"), 2)


def ts_anomalies(spark, d):
    return rounded(timeseries(table(spark, d, "orders"), DATE, PRICE, "sum", "W").anomalies(), 2)


def ts_anomalies_daily(spark, d):
    return rounded(timeseries(table(spark, d, "events"), "ts", "value", "mean", "D").anomalies(), 5)


def ts_anomalies_spikes(spark, d):
    """Days of a noisy series of which two are far off."""
    spiked = table(spark, d, "events").withColumn(
        "value", F.when(F.dayofmonth("ts") == 9, F.col("value") * 40).when(F.dayofmonth("ts") == 17, -F.col("value") * 30).otherwise(F.col("value")))
    return rounded(timeseries(spiked, "ts", "value", "sum", "D").anomalies(), 4)


def ts_anomalies_flat(spark, d):
    """A series that never varies but on one day, so its median deviation is 0."""
    flat = table(spark, d, "events").withColumn("value", F.when(F.dayofmonth("ts") == 9, 7.0).otherwise(1.0))
    return rounded(timeseries(flat, "ts", "value", "max", "D").anomalies(), 4)


def ts_long_daily(spark, d):
    """More than 5000 days: order dates spread over forty years."""
    o = table(spark, d, "orders").withColumn("far", F.col(DATE) + F.make_dt_interval((F.col("o_orderkey") % 41 * 365).cast("int")))
    return rounded(timeseries(o, "far", PRICE, "sum", "D", max_periods=None).points(), 6)


def ts_season_month(spark, d):
    return rounded(timeseries(table(spark, d, "orders"), DATE, PRICE, "sum").season_month(), 5)


def ts_season_weekday(spark, d):
    return rounded(timeseries(table(spark, d, "orders"), DATE, PRICE, "count").season_weekday())


def ts_season_hour(spark, d):
    return rounded(timeseries(table(spark, d, "events"), "ts", "value", "mean").season_hour())


def ts_season_hour_median(spark, d):
    return rounded(timeseries(table(spark, d, "events"), "ts", "value", "median").season_hour())


# --- comparison --------------------------------------------------------------------------

def compare_schema(spark, d):
    return compare.schema_diff(*inputs.orders_split(spark, d))


def compare_numeric(spark, d):
    return rounded(compare.compare_numeric(*inputs.orders_split(spark, d)), 4)


def compare_categorical(spark, d):
    return rounded(joined(compare.compare_categorical(*inputs.orders_split(spark, d)), "new_in_b", "missing_in_b"))


def compare_labels(spark, d):
    a, b = (profile_table(n, t) for n, t in inputs.parts_split(spark, d))
    return compare.compare_labels(a, b)


def compare_overview(spark, d):
    return rounded(compare.compare_overview(*inputs.orders_split(spark, d)))


# --- report ------------------------------------------------------------------------------

def findings(spark, d):
    return build_report(inputs.orders_text(spark, d))["findings"]


def findings_orders(spark, d):
    return build_report(inputs.orders(spark, d))["findings"]


def findings_events(spark, d):
    ev = table(spark, d, "events").withColumn(ROW, F.col("event_id")).drop("props")
    return build_report(profile_table("events", ev))["findings"]


def report_statistics(spark, d):
    """The flagship: profile a table and report its numbers in one tidy table."""
    rep = build_report(inputs.orders(spark, d))
    return _described(rep["statistics"].drop("skew_label"))


def report_defaults(spark, d):
    return build_report(inputs.orders(spark, d))["defaults"]


def section_flags(spark, d):
    return build_report(inputs.orders(spark, d))["sections"]


def chart_plan(spark, d):
    return defaults.charts(inputs.orders(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        parquet_rows, csv_rows, csv_profile, csv_load_report, csv_cleaned, csv_odd_headers, csv_late_comma, csv_late_report, parquet_odd_names, preview50,
        schema_profile, schema_examples, type_counts, numeric_parse, date_parse, date_vote, identifier_flags,
        text_kinds, case_variants, abbreviations, sample_values,
        describe_lineitem, describe_events_gaps, quantiles_wide, hist_discrete, hist_binned, box_stats, box_outlier_points, box_outliers_all,
        outlier_table, outlier_extremes, value_counts, category_bars, category_summary, top_n_other,
        quality_overview, quality_columns, quality_issues, duplicate_rows, repeated_ids, dedupe_rows,
        corr_pearson, corr_pearson_gaps, corr_pairs, corr_spearman, corr_spearman_gaps,
        scatter_fit, scatter_points, scatter_colored, scatter_matrix, scatter_all_colored, scatter_matrix_all,
        pivot_2way, pivot_2way_median, pivot_2way_other, pivot_missing_label,
        crosstab_counts, crosstab_other, crosstab_chi2, crosstab_chi2_other,
        ts_gaps, ts_gaps_count, ts_summary, ts_trend, ts_anomalies, ts_anomalies_daily, ts_anomalies_spikes, ts_anomalies_flat, ts_long_daily,
        ts_season_month, ts_season_weekday, ts_season_hour, ts_season_hour_median,
        compare_schema, compare_numeric, compare_categorical, compare_labels, compare_overview,
        findings, findings_orders, findings_events, report_statistics, report_defaults, section_flags, chart_plan,
    )
}
QUERIES |= {f"pivot_{agg}": _pivot(agg) for agg in relate.AGGREGATES}
QUERIES |= {f"ts_{freq.lower()}": _series(freq) for freq in ("auto", "D", "W", "M", "Q", "Y")}
QUERIES |= {f"ts_m_{agg}": _series("M", agg, 7 if agg == "mean" else 5) for agg in ("mean", "median", "min", "max", "count")}
