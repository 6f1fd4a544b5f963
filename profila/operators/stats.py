"""Descriptive statistics, histograms, box plots, category summaries, outliers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profila.functions.labels import skew_label
from profila.operators.kernels import (
    drawing_order, first_rows, labelled, long_form, numbers, quantiles, settled, value_counts,
)

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)
TOP_CATEGORIES = 15
BOX_POINTS = 300


def skewness(v: str) -> Column:
    """Bias-corrected skewness; 0 for a constant column, null below three values."""
    n = F.count(v)
    return (
        F.when(n < 3, None).when(F.stddev_pop(v) == 0, 0.0)
        .otherwise(F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))
    )


def kurtosis(v: str) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column, null below four values."""
    n = F.count(v)
    return (
        F.when(n < 4, None).when(F.stddev_pop(v) == 0, 0.0)
        .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))
    )


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts, sums and central moments per column.

    The long form keeps the generated code as small as for one column; wide aggregates over
    many columns outgrow whole-stage code generation and run several times slower.
    """
    v = "value"
    return long_form(numbers(df, cols), cols).groupBy("column").agg(
        F.count(v).alias("count"), (F.count("*") - F.count(v)).alias("missing"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("variance"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"),
        skewness(v).alias("skewness"), kurtosis(v).alias("kurtosis"),
        F.count_if(F.col(v) == 0).alias("zeros"), F.count_if(F.col(v) < 0).alias("negatives"),
        F.bool_and(F.col(v) % 1 == 0).alias("whole"))


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All statistics of the numeric columns, one settled row each.

    The other operators of this module take it as ``profile`` instead of measuring again.
    """
    cells = long_form(numbers(df, cols), cols).where("value is not null")
    base = moments(df, cols)
    known = base.collect()
    spread = quantiles(cells, ["column"], "value", PROBS).select(
        "column", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p5", "q1", "median", "q3", "p95"))])
    shapes = (
        cells.groupBy("column", "value").agg(F.count("*").alias("n"))
        .groupBy("column").agg(
            F.count("*").alias("unique"),
            F.max(F.struct("n", (-F.col("value")).alias("neg"))).alias("top"))
    )
    mean, std = F.col("mean"), F.col("std")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return settled(
        df.sparkSession.createDataFrame(known, base.schema)
        .join(F.broadcast(shapes), "column", "left").join(F.broadcast(spread), "column", "left")
        .select(
            "column", "count", "missing", "mean", "median",
            F.when(F.col("top.n") > 1, -F.col("top.neg")).alias("mode"),
            F.coalesce("top.n", F.lit(0)).alias("mode_count"),
            "std", "variance", "min", "p5", "q1", "q3", "p95", "max",
            (F.col("q3") - F.col("q1")).alias("iqr"),
            (F.col("max") - F.col("min")).alias("range"),
            "skewness", "kurtosis", skew_label(F.col("skewness")).alias("skew_label"),
            F.when(mean != 0, std / F.abs(mean) * 100).alias("cv_pct"),
            "zeros", "negatives", F.coalesce("unique", F.lit(0)).alias("unique"), "sum",
            (F.col("q1") - reach).alias("lower_bound"), (F.col("q3") + reach).alias("upper_bound"), "whole",
        )
    )


def describe(df: DataFrame, cols: Sequence[str], profile: DataFrame | None = None) -> DataFrame:
    """One row of descriptive statistics per numeric column."""
    return (profile or numeric_profile(df, cols)).drop("lower_bound", "upper_bound", "whole")


# --- histograms --------------------------------------------------------------------------

def bin_count(n: int, low: float, high: float, q1: float, q3: float) -> int:
    """Freedman-Diaconis bins, Sturges without spread, between 10 and 60."""
    width = 2 * (q3 - q1) / n ** (1 / 3)
    bins = math.ceil((high - low) / width) if width > 0 else math.ceil(math.log2(n) + 1)
    return min(max(bins, 10), 60)


def histograms(df: DataFrame, cols: Sequence[str], profile: DataFrame | None = None) -> DataFrame:
    """(column, kind, bin, left, right, center, count), one row per bar.

    Few whole values give one bar each. Otherwise equal bins cover the range, the last one
    closed on the right; empty bins are kept.
    """
    spark = df.sparkSession
    known = [r for r in (profile or numeric_profile(df, cols)).collect() if r["count"]]
    discrete = [r["column"] for r in known if r["unique"] == 1 or (r["unique"] <= 25 and r["whole"])]
    plan = [(r["column"], r["min"], r["max"], bin_count(r["count"], r["min"], r["max"], r["q1"], r["q3"]))
            for r in known if r["column"] not in discrete]
    parts = []
    if discrete:
        bars = value_counts(numbers(df, discrete), discrete)
        at = F.row_number().over(W.partitionBy("column").orderBy("value")) - 1  # at most 25 per column
        parts.append(bars.select(
            "column", F.lit("discrete").alias("kind"), at.alias("bin"),
            F.col("value").alias("left"), F.col("value").alias("right"),
            F.col("value").alias("center"), F.col("n").alias("count")))
    if plan:
        binned = [p[0] for p in plan]
        cells = long_form(numbers(df, binned), binned).where("value is not null")
        parts.append(_binned(cells, spark.createDataFrame(plan, "column string, lo double, hi double, bins int")))
    if not parts:
        return spark.createDataFrame(
            [], "column string, kind string, bin int, left double, right double, center double, count long")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _binned(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    step = (F.col("hi") - F.col("lo")) / F.col("bins")

    def edge(i: Column) -> Column:
        return F.when(i >= F.col("bins"), F.col("hi")).otherwise(F.col("lo") + i * step)

    guess = F.least(F.floor((F.col("value") - F.col("lo")) / step).cast("int"), F.col("bins") - 1)
    near = cells.join(F.broadcast(bounds), "column").withColumn("_g", guess)
    # the edges decide where rounding put the guess one bin off
    exact = (
        F.when(F.col("value") < edge(F.col("_g")), F.col("_g") - 1)
        .when((F.col("value") >= edge(F.col("_g") + 1)) & (F.col("_g") < F.col("bins") - 1), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    )
    counted = near.groupBy("column", exact.alias("bin")).agg(F.count("*").alias("n"))
    spine = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    left, right = edge(F.col("bin")), edge(F.col("bin") + 1)
    return spine.join(counted, ["column", "bin"], "left").select(
        "column", F.lit("bins").alias("kind"), "bin", left.alias("left"), right.alias("right"),
        ((left + right) / 2).alias("center"), F.coalesce("n", F.lit(0)).alias("count"))


# --- fences, boxes, outliers -------------------------------------------------------------

def fences(df: DataFrame, cols: Sequence[str], profile: DataFrame | None = None) -> DataFrame:
    """Per column: n, mean, std, quartiles and the 1.5 IQR fences. As small as the column list."""
    if profile is not None:
        return profile.select(
            "column", F.col("count").alias("n"), "mean", "std", "q1", "median", "q3",
            F.col("lower_bound").alias("lo"), F.col("upper_bound").alias("hi")).where("n > 0")
    cells = long_form(numbers(df, cols), cols).where("value is not null")
    base = cells.groupBy("column").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    known = base.collect()
    q = quantiles(cells, ["column"], "value", (0.25, 0.5, 0.75)).select(
        "column", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return settled(
        df.sparkSession.createDataFrame(known, base.schema).select("column", "n", "mean", "std")
        .join(F.broadcast(q), "column")
        .withColumns({"lo": F.col("q1") - reach, "hi": F.col("q3") + reach}))


def _flagged(df: DataFrame, cols: Sequence[str], bounds: DataFrame, *keep: str) -> DataFrame:
    """Present cells with their fences and whether either rule calls them outliers."""
    v = F.col("value")
    far = F.coalesce(
        (F.col("std") > 0) & (F.abs(v - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)) > 3), F.lit(False))
    cells = long_form(numbers(df, cols, *keep), cols, *keep).where("value is not null")
    return cells.join(F.broadcast(bounds), "column").withColumns(
        {"by_iqr": (v < F.col("lo")) | (v > F.col("hi")), "by_z": far})


def spread_table(df: DataFrame, cols: Sequence[str], profile: DataFrame | None = None) -> DataFrame:
    """Box-plot figures and outlier counts of every column from one pass over the cells."""
    n = F.count("*")
    iqr, z = F.count_if("by_iqr"), F.count_if("by_z")
    inside = F.when(~F.col("by_iqr"), F.col("value"))
    return _flagged(df, cols, fences(df, cols, profile)).groupBy("column").agg(
        n.alias("count"), *[F.first(c).alias(c) for c in ("q1", "median", "q3", "mean", "lo", "hi")],
        F.coalesce(F.min(inside), F.first("q1")).alias("lowerfence"),
        F.coalesce(F.max(inside), F.first("q3")).alias("upperfence"),
        iqr.alias("iqr_count"), (iqr / n * 100).alias("iqr_pct"),
        z.alias("z_count"), (z / n * 100).alias("z_pct"),
        F.count_if(F.col("by_iqr") & F.col("by_z")).alias("both_count"))


def box_stats(df: DataFrame, cols: Sequence[str], spread: DataFrame | None = None) -> DataFrame:
    """Quartiles, mean, whiskers (extreme values inside the fences) and the outlier count."""
    return (spread or spread_table(df, cols)).select(
        "column", "q1", "median", "q3", "mean", "lowerfence", "upperfence",
        F.col("iqr_count").alias("outlier_count"))


def outlier_table(df: DataFrame, cols: Sequence[str], spread: DataFrame | None = None) -> DataFrame:
    """Counts and shares of values outside the fences, beyond 3 standard deviations, and both."""
    return (spread or spread_table(df, cols)).where(F.col("count") >= 4).select(
        "column", "count", F.col("lo").alias("lower_bound"), F.col("hi").alias("upper_bound"),
        "iqr_count", "iqr_pct", "z_count", "z_pct", "both_count")


def outlier_extremes(
    df: DataFrame, cols: Sequence[str], row: str, n: int = 5, profile: DataFrame | None = None,
) -> DataFrame:
    """The flagged values farthest from the median of their column, with row numbers."""
    bounds = fences(df, cols, profile).where("n >= 4")
    flagged = _flagged(df, cols, bounds, row).where(F.col("by_iqr") | F.col("by_z"))
    ranked = first_rows(
        flagged, n, ["column"], [F.abs(F.col("value") - F.col("median")).desc(), F.col(row)])
    return ranked.select("column", F.col("_nth").alias("position"), F.col(row).alias("row"), "value")


def box_points(
    df: DataFrame, cols: Sequence[str], row: str, limit: int | None = BOX_POINTS, profile: DataFrame | None = None,
) -> DataFrame:
    """Outliers to draw per column: all, or of more than ``limit`` the 5 lowest, the 5 highest and a fixed sample.

    (column, row, value, n, shown, sampled); n counts the outliers, shown those returned.
    """
    out = _flagged(df, cols, fences(df, cols, profile), row).where("by_iqr").select("column", row, "value")
    totals = out.groupBy("column").agg(F.count("*").alias("n"))
    if limit is None:
        return out.join(F.broadcast(totals), "column").withColumns({"shown": F.col("n"), "sampled": F.lit(False)})
    low, high = [F.col("value"), F.col(row)], [F.desc("value"), F.col(row)]
    ends = first_rows(out, 5, ["column"], low).unionByName(first_rows(out, 5, ["column"], high)).drop("_nth").distinct()
    rest = out.join(F.broadcast(ends.select("column", row)), ["column", row], "left_anti")
    drawn = first_rows(rest, limit - 10, ["column"], [drawing_order([row]), F.col(row)]).drop("_nth")
    return ends.unionByName(drawn).join(F.broadcast(totals), "column").withColumns(
        {"shown": F.least("n", F.lit(limit)), "sampled": F.col("n") > limit})


# --- categories --------------------------------------------------------------------------

def label_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, label, n) over the present values."""
    texts = df.select(*[labelled(df, c, keep_missing=False).alias(c) for c in cols])
    return value_counts(texts, cols).withColumnRenamed("value", "label")


def category_bars(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The 15 most frequent labels per column and one bar for the others."""
    counts = label_counts(df, cols)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("levels"))
    top = first_rows(counts, TOP_CATEGORIES, ["column"], [F.desc("n"), F.col("label")])
    shown = top.join(F.broadcast(totals), "column").select(
        "column", F.col("_nth").alias("position"), "label", F.col("n").alias("count"), "total", "levels")
    rest = shown.groupBy("column").agg(
        F.first("total").alias("total"), F.first("levels").alias("levels"), F.sum("count").alias("in_top"),
    ).where("total > in_top").select(
        "column", F.lit(TOP_CATEGORIES + 1).alias("position"),
        F.concat(F.lit("Other ("), (F.col("levels") - TOP_CATEGORIES).cast("string"), F.lit(" more)")).alias("label"),
        (F.col("total") - F.col("in_top")).alias("count"), "total", "levels")
    return shown.unionByName(rest).select(
        "column", "position", "label", "count", (F.col("count") / F.col("total") * 100).alias("percent"))


def category_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Totals, levels, most and least frequent label, dominance and pie flags per column."""
    missing = long_form(
        df.select(*[labelled(df, c, keep_missing=False).alias(c) for c in cols]), cols,
    ).groupBy("column").agg((F.count("*") - F.count("value")).alias("missing"))
    # order (n, label): the mode takes the smallest label among ties, the rarest the largest
    per_column = label_counts(df, cols).groupBy("column").agg(
        F.sum("n").alias("total"), F.count("*").alias("levels"),
        F.min(F.struct((-F.col("n")).alias("neg"), "label")).alias("top"),
        F.max(F.struct((-F.col("n")).alias("neg"), "label")).alias("last"))
    share = -F.col("top.neg") / F.col("total")
    levels = F.coalesce("levels", F.lit(0))
    return missing.join(F.broadcast(per_column), "column", "left").select(
        "column", F.coalesce("total", F.lit(0)).alias("total"), "missing", levels.alias("unique"),
        F.col("top.label").alias("mode"), (share * 100).alias("mode_pct"),
        F.col("last.label").alias("rarest"), (-F.col("last.neg")).alias("rarest_count"),
        ((levels > 1) & (share > 0.8)).alias("imbalanced"),
        levels.between(2, 8).alias("allow_pie"))
