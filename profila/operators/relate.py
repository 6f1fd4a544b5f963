"""Correlation, scatter fits, pivots and cross-tabs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from profila.functions.text import quoted
from profila.functions.labels import association, strength
from profila.functions.tails import chi2_p, pearson_p
from profila.operators.kernels import (
    label_table, labelled, long_form, number, numbers, quantiles, rank_table, sample_rows, top_labels,
)
from profila.session import staging_path

PAIRS_PER_PASS = 60
MIN_PAIR_ROWS = 3
SCATTER_POINTS = 4000
MATRIX_ROWS = 1500
PIVOT_ROWS, PIVOT_COLUMNS = 20, 10
CROSS_ROWS, CROSS_COLUMNS = 15, 12
AGGREGATES = ("mean", "sum", "median", "min", "max", "count")
SCATTER_COLORS = 10


# --- correlation -------------------------------------------------------------------------

@dataclass
class Correlation:
    """Pairwise coefficients of the eligible columns; ``pairs`` is lazy and tiny."""

    method: str
    columns: list[str]
    truncated: bool
    pairs: DataFrame  # i, j (positions), a, b, r, n with i < j

    def matrix(self) -> DataFrame:
        """(a, b, r) for every ordered pair, 4 digits; the diagonal is 1."""
        spark = self.pairs.sparkSession
        r = F.bround("r", 4).alias("r")
        a, b = F.col("a"), F.col("b")
        both = F.array(F.struct(a.alias("a"), b.alias("b"), r), F.struct(b.alias("a"), a.alias("b"), r))
        diagonal = spark.createDataFrame([(c, c, 1.0) for c in self.columns], "a string, b string, r double")
        return self.pairs.select(F.inline(both)).unionByName(diagonal)

    def ranked(self, limit: int | None = None) -> DataFrame:
        """Strongest pairs first, all of them unless limited."""
        found = self.pairs.where("r is not null").select(
            "a", "b", "r", "n", strength(F.col("r")).alias("strength"), "i", "j").orderBy(F.desc(F.abs("r")), "i", "j")
        return (found if limit is None else found.limit(limit)).drop("i", "j")


def eligible(
    df: DataFrame, cols: Sequence[str], profile: DataFrame | None = None, most: int | None = None,
) -> tuple[list[str], dict[str, int], bool]:
    """Columns with at least 3 values that vary, in the given order; the ``most`` complete ones if that is set.

    Also the missing cells of each, and whether columns were left out.
    """
    if not cols:
        return [], {}, False
    place = F.array_position(F.array(*map(F.lit, cols)), F.col("column"))
    if profile is None:
        cells = long_form(numbers(df, cols), cols).groupBy("column")
        profile = cells.agg(F.count("value").alias("count"), (F.count("*") - F.count("value")).alias("missing"),
                            F.min("value").alias("min"), F.max("value").alias("max"))
    # not by the deviation: merged over many tasks, that of equal values is not always 0
    varying = profile.where((F.col("count") >= MIN_PAIR_ROWS) & (F.col("min") < F.col("max"))).select(
        "column", "missing", place.alias("place"), F.row_number().over(W.orderBy("missing", place)).alias("nth"))
    found = sorted(varying.collect(), key=lambda r: r["place"])
    kept = [r for r in found if most is None or r["nth"] <= most]
    return [r["column"] for r in kept], {r["column"]: r["missing"] for r in kept}, len(kept) < len(found)


def _clipped(r):
    """Keep rounding errors inside [-1, 1]; null stays null (least and greatest would skip it)."""
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _coefficient(x: str, y: str, gaps: bool):
    """Pearson's r over complete pairs; undefined instead of an error without variation."""
    n = F.count(F.when(F.col(x).isNotNull(), F.col(y)))
    if gaps:
        px, py = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
        r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(px) * F.stddev_samp(py))
    else:
        r = F.corr(x, y)
    return F.when(n >= MIN_PAIR_ROWS, _clipped(r)), n


def _pair_table(df: DataFrame, cols: Sequence[str], sides) -> DataFrame:
    """One row per pair. ``sides(i, j)`` gives the two columns to correlate and whether
    either has gaps. Pairs are aggregated in groups that stay within generated-code limits."""
    pairs = list(itertools.combinations(range(len(cols)), 2))
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[start:start + PAIRS_PER_PASS]
        named = df.select(*[c.alias(f"{side}{k}") for k, (i, j) in enumerate(part) for side, c in zip("xy", sides(i, j)[:2])])
        structs = []
        for k, (i, j) in enumerate(part):
            r, n = _coefficient(f"x{k}", f"y{k}", sides(i, j)[2])
            structs.append(F.struct(
                F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("a"),
                F.lit(cols[j]).alias("b"), r.alias("r"), n.alias("n")))
        parts.append(named.agg(F.array(*structs).alias("p")).select(F.inline("p")))
    return reduce(DataFrame.unionByName, parts)


def pearson(
    df: DataFrame, cols: Sequence[str], profile: DataFrame | None = None, most: int | None = None,
) -> Correlation | None:
    """Linear correlation over pairwise complete rows, of all varying columns or the ``most`` complete ones."""
    usable, gaps, truncated = eligible(df, cols, profile, most)
    if len(usable) < 2:
        return None
    pairs = _pair_table(numbers(df, usable), usable, lambda i, j: (
        F.col(quoted(usable[i])), F.col(quoted(usable[j])), bool(gaps[usable[i]] or gaps[usable[j]])))
    return Correlation("pearson", usable, truncated, pairs)


def spearman(
    df: DataFrame, cols: Sequence[str], profile: DataFrame | None = None, most: int | None = None, row: str | None = None,
) -> Correlation | None:
    """Rank correlation; ranks are average ranks among the complete rows of each pair.

    ``row`` names a column that is unique per row, if there is one.
    """
    usable, gaps, truncated = eligible(df, cols, profile, most)
    if len(usable) < 2:
        return None
    pairs = _rank_pairs(numbers(df, usable, *[row] if row else []), usable, [c for c in usable if gaps[c]], row)
    return Correlation("spearman", usable, truncated, pairs)


def _rank_pairs(rows: DataFrame, cols: Sequence[str], gappy: Sequence[str], row: str | None = None, varying: bool = True) -> DataFrame:
    """Rank correlation per pair; ``varying`` promises that no column is constant over the rows of a pair without gaps."""
    ranks = rank_table(rows, cols, gappy, row)
    table = ranks.rows
    if len(cols) * (len(cols) - 1) // 2 > PAIRS_PER_PASS:  # several passes over what is costly to build
        path = staging_path(rows.sparkSession, "ranked")
        table.write.parquet(path)
        table = rows.sparkSession.read.parquet(path)
    return _pair_table(table, cols, lambda i, j: (
        ranks.rank(i, j), ranks.rank(j, i), not varying or cols[i] in gappy or cols[j] in gappy))


# --- scatter -----------------------------------------------------------------------------

def scatter_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, both coefficients, r squared, least-squares line, trend ends, p-value, strength."""
    both = numbers(df, [x, y]).toDF("x", "y").dropna()
    fit = both.agg(
        F.count("*").alias("n"),
        F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("r"),
        F.stddev_samp("y").alias("sd_y"),
        F.regr_slope("y", "x").alias("k"), F.regr_intercept("y", "x").alias("c"),
        F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    if fit["n"] < 3:
        raise ValueError("Fewer than 3 rows have values in both columns.")
    rho = _rank_pairs(both, ["x", "y"], [], varying=False).first()["r"]
    flat = fit["r"] is None
    r = None if flat else max(-1.0, min(1.0, fit["r"]))
    k, c = (None, None) if flat else (fit["k"], fit["c"])
    one = df.sparkSession.createDataFrame(
        [(x, y, fit["n"], r, rho, k, c, fit["x0"], fit["x1"], pearson_p(r, fit["n"]))],
        "x string, y string, n long, r double, rho double, k double, c double, "
        "trend_x0 double, trend_x1 double, p_value double")
    at = lambda v: F.col("k") * F.col(v) + F.col("c")
    return one.select(
        "x", "y", "n", F.bround("r", 4).alias("pearson"),
        F.bround(_clipped(F.col("rho")), 4).alias("spearman"),
        F.bround(F.col("r") * F.col("r"), 4).alias("r_squared"),
        F.bround("k", 6).alias("slope"), F.bround("c", 6).alias("intercept"), "p_value",
        strength(F.col("r")).alias("strength"),
        *[F.when(F.col("k").isNotNull(), F.col(v)).alias(v) for v in ("trend_x0", "trend_x1")],
        at("trend_x0").alias("trend_y0"), at("trend_x1").alias("trend_y1"))


def scatter_points(
    df: DataFrame, x: str, y: str, keys: Sequence[str], color: str | None = None,
    limit: int | None = SCATTER_POINTS,
) -> DataFrame:
    """(group, x, y, n, shown, sampled) for at most ``limit`` of the n points, drawn by row-key hash.

    With a colour column the shown points are grouped by their ten most frequent labels.
    """
    if x == y:
        raise ValueError("Choose two different columns for X and Y.")
    extra = [labelled(df, color).alias("_color")] if color else []
    both = df.select(*[F.col(quoted(k)).alias(f"_key{i}") for i, k in enumerate(keys)],
                     number(df, x).alias("x"), number(df, y).alias("y"), *extra
                     ).where("x is not null and y is not null")
    total = both.count()
    if total < 3:
        raise ValueError("Fewer than 3 rows have values in both columns.")
    limit = total if limit is None else limit
    shown = sample_rows(both, limit, total, [f"_key{i}" for i in range(len(keys))])
    group = top_labels(shown, "_color", SCATTER_COLORS)[0] if color else F.lit("Rows")
    return shown.select(group.alias("group"), "x", "y", *_extent(total, limit))


def _extent(total: int, limit: int) -> list:
    """How many rows there are, how many are shown, and whether that is a sample."""
    return [F.lit(total).cast("long").alias("n"), F.lit(min(total, limit)).cast("long").alias("shown"),
            F.lit(total > limit).alias("sampled")]


def scatter_matrix(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], limit: int | None = MATRIX_ROWS,
) -> DataFrame:
    """Rows complete in 2 to 6 columns, at most ``limit`` of them, with n, shown and sampled."""
    if not 2 <= len(cols) <= 6:
        raise ValueError("Select between 2 and 6 numeric columns.")
    rows = df.select(*[F.col(quoted(k)).alias(f"_key{i}") for i, k in enumerate(keys)],
                     *[number(df, c).alias(c) for c in cols]).where(
        reduce(lambda a, b: a & b, [F.col(quoted(c)).isNotNull() for c in cols]))
    total = rows.count()
    if total < 3:
        raise ValueError("Fewer than 3 rows have values in all selected columns.")
    limit = total if limit is None else limit
    return sample_rows(rows, limit, total, [f"_key{i}" for i in range(len(keys))]).select(*map(quoted, cols), *_extent(total, limit))


# --- pivot -------------------------------------------------------------------------------

def pivot(
    df: DataFrame, rows: str, cols: str | None = None, values: str | None = None, agg: str = "mean",
) -> DataFrame:
    """Tidy pivot: (row, row_position[, col, col_position], value, count) for every cell.

    Rare labels go to Other; absent cells have a null value and count 0.
    """
    if agg not in AGGREGATES:
        raise ValueError("Unknown aggregation.")
    if cols == rows:
        raise ValueError("Choose different columns for rows and columns.")
    spark = df.sparkSession
    r_label, r_order = top_labels(df, rows, PIVOT_ROWS)
    grid = label_table(spark, r_order, "row", "row_position")
    keys, picked = ["row"], [r_label.alias("row")]
    if cols:
        c_label, c_order = top_labels(df, cols, PIVOT_COLUMNS)
        keys.append("col")
        picked.append(c_label.alias("col"))
        # at most 21 x 11 cells, listed on the driver
        grid = spark.createDataFrame(
            [(r, i, c, j) for i, r in enumerate(r_order) for j, c in enumerate(c_order)],
            "row string, row_position int, col string, col_position int")
    if values and agg != "count":
        cells = df.select(*picked, number(df, values).alias("v"))
        n = F.count("v").alias("n")
        if agg == "median":
            medians = quantiles(cells, keys, "v", (0.5,)).select(*keys, F.get("q", F.lit(0)).alias("m"))
            table = cells.groupBy(*keys).agg(n).join(F.broadcast(medians), keys, "left")
        else:
            # the sum of a group without values is 0, every other aggregate is null
            form = {"mean": F.avg("v"), "sum": F.coalesce(F.sum("v"), F.lit(0.0)),
                    "min": F.min("v"), "max": F.max("v")}[agg]
            table = cells.groupBy(*keys).agg(n, form.alias("m"))
    else:
        table = df.select(*picked).groupBy(*keys).agg(F.count("*").alias("n")).withColumn(
            "m", F.col("n").cast("double"))
    return grid.join(table, keys, "left").select(
        *grid.columns, F.bround("m", 4).alias("value"), F.coalesce("n", F.lit(0)).alias("count"))


# --- cross-tab ---------------------------------------------------------------------------

@dataclass
class CrossTab:
    """Counts of two label columns over rows complete in both."""

    a: str
    b: str
    cells: DataFrame  # a, a_position, b, b_position, count, row_total, col_total, row_pct

    def test(self) -> DataFrame:
        """One row: n, chi-square, degrees of freedom, p-value, Cramér's V, verdicts."""
        expected = F.col("row_total") * F.col("col_total") / F.col("n")
        total = F.sum("count").over(W.partitionBy())
        cells = self.cells.withColumn("n", total).withColumn("e", expected)
        s = cells.agg(
            F.max("n").alias("n"),
            F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"),
            F.sum(F.when(F.col("e") > 0, F.pow(F.col("count") - F.col("e"), F.lit(2)) / F.col("e"))).alias("chi2"),
            F.avg((F.col("e") < 5).cast("double")).alias("low")).first()
        tested = s["r"] >= 2 and s["c"] >= 2
        chi2 = s["chi2"] if tested else None
        dof = (s["r"] - 1) * (s["c"] - 1) if tested else None
        v = math.sqrt(chi2 / (s["n"] * (min(s["r"], s["c"]) - 1))) if tested else None
        p = chi2_p(chi2, dof) if tested else None
        low = s["low"] * 100 if tested else None
        one = self.cells.sparkSession.createDataFrame(
            [(self.a, self.b, s["n"], chi2, dof, p, v, low)],
            "a string, b string, n long, chi2 double, dof int, p_value double, cramers_v double, low_expected_pct double")
        # fixed values: verdict texts
        related = F.concat(F.lit("p < 0.05: the distribution of "), F.col("b"), F.lit(" differs across "),
                           F.col("a"), F.lit(" groups more than chance alone would explain."))
        unrelated = F.concat(F.lit("p ≥ 0.05: no evidence that "), F.col("a"), F.lit(" and "), F.col("b"),
                             F.lit(" are related in this data."))
        return one.select(
            "*", association(F.col("cramers_v")).alias("association"),
            F.when(F.col("p_value") < 0.05, related).when(F.col("p_value") >= 0.05, unrelated).alias("verdict"),
            (F.col("low_expected_pct") > 20).alias("low_expected_warning"))


def crosstab(df: DataFrame, a: str, b: str) -> CrossTab:
    """Counts, totals and row percentages; top 15 by 12 labels plus Other, zero-filled."""
    if a == b:
        raise ValueError("Choose two different columns.")
    spark = df.sparkSession
    both = df.select(labelled(df, a, False).alias("la"), labelled(df, b, False).alias("lb")).dropna()
    a_label, a_order = top_labels(both, "la", CROSS_ROWS)
    b_label, b_order = top_labels(both, "lb", CROSS_COLUMNS)
    if not a_order:
        raise ValueError("No rows have values in both columns.")
    grid = spark.createDataFrame(
        [(x, i, y, j) for i, x in enumerate(a_order) for j, y in enumerate(b_order)],
        "a string, a_position int, b string, b_position int")
    counted = both.groupBy(a_label.alias("a"), b_label.alias("b")).agg(F.count("*").alias("n"))
    count = F.coalesce("n", F.lit(0))
    cells = grid.join(counted, ["a", "b"], "left").select(
        "a", "a_position", "b", "b_position", count.alias("count"),
        F.sum(count).over(W.partitionBy("a")).alias("row_total"),
        F.sum(count).over(W.partitionBy("b")).alias("col_total"))
    pct = F.bround(F.col("count") / F.greatest(F.col("row_total"), F.lit(1)) * 100, 2)
    return CrossTab(a, b, cells.withColumn("row_pct", pct))
