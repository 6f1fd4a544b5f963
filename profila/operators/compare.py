"""Side-by-side comparison of two datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profila.model import CATEGORICAL, NUMERIC, Dataset
from profila.operators.kernels import first_rows
from profila.operators.quality import duplicate_count
from profila.operators.stats import category_summary, describe, label_counts

SHOWN_LABELS = 8


def schema_diff(a: Dataset, b: Dataset) -> DataFrame:
    """(name, status, type_a, type_b): common, only_a, only_b or type_mismatch."""
    left = a.schema_table().select("name", F.col("type").alias("type_a"))
    right = b.schema_table().select("name", F.col("type").alias("type_b"))
    status = (
        F.when(F.col("type_b").isNull(), "only_a").when(F.col("type_a").isNull(), "only_b")
        .when(F.col("type_a") != F.col("type_b"), "type_mismatch").otherwise("common"))
    return left.join(right, "name", "full").select("name", status.alias("status"), "type_a", "type_b")


def shared(a: Dataset, b: Dataset, kind: str) -> list[str]:
    other = {c.name: c.type for c in b.columns}
    return [c.name for c in a.columns if c.type == kind and other.get(c.name) == kind]


def compare_numeric(a: Dataset, b: Dataset) -> DataFrame:
    """Mean, median, deviation and missing share on both sides, and the change of the mean."""
    cols = shared(a, b, NUMERIC)

    def side(ds: Dataset, s: str) -> DataFrame:
        missing = ds.spark.createDataFrame(
            [(c.name, c.missing_pct) for c in ds.columns], f"column string, missing_pct_{s} double")
        stats = describe(ds.table, cols).select(
            "column", *[F.col(m).alias(f"{m}_{s}") for m in ("mean", "median", "std")])
        return stats.join(F.broadcast(missing), "column")

    if not cols:
        return a.spark.createDataFrame(
            [], "column string, mean_a double, median_a double, std_a double, missing_pct_a double, "
            "mean_b double, median_b double, std_b double, missing_pct_b double, mean_change_pct double")
    both = side(a, "a").join(side(b, "b"), "column")
    change = F.when(F.col("mean_a") != 0, (F.col("mean_b") - F.col("mean_a")) / F.abs("mean_a") * 100)
    return both.withColumn("mean_change_pct", change)


def compare_categorical(a: Dataset, b: Dataset) -> DataFrame:
    """Levels and mode on both sides, labels that appear or vanish: their number and 8
    to show; ``compare_labels`` has all."""
    cols = shared(a, b, CATEGORICAL)
    if not cols:
        return a.spark.createDataFrame(
            [], "column string, unique_a long, top_a string, top_a_pct double, unique_b long, top_b string, "
            "top_b_pct double, new_count long, new_in_b array<string>, missing_count long, missing_in_b array<string>")

    def side(ds: Dataset, s: str) -> DataFrame:
        return category_summary(ds.table, cols).select(
            "column", F.col("unique").alias(f"unique_{s}"), F.col("mode").alias(f"top_{s}"),
            F.col("mode_pct").alias(f"top_{s}_pct"))

    met = _one_sided(a, b, cols)
    counts = met.groupBy("column").agg(
        F.count_if(F.col("lo") == "b").alias("new_count"), F.count_if(F.col("lo") == "a").alias("missing_count"))
    shown = first_rows(met, SHOWN_LABELS, ["column", "lo"], [F.col("label")]).groupBy("column").agg(
        F.sort_array(F.collect_list(F.when(F.col("lo") == "b", F.col("label")))).alias("new_in_b"),
        F.sort_array(F.collect_list(F.when(F.col("lo") == "a", F.col("label")))).alias("missing_in_b"))
    none = F.array().cast("array<string>")
    return (
        side(a, "a").join(side(b, "b"), "column").join(counts, "column", "left").join(shown, "column", "left")
        .select("column", "unique_a", "top_a", "top_a_pct", "unique_b", "top_b", "top_b_pct",
                F.coalesce("new_count", F.lit(0)).alias("new_count"), F.coalesce("new_in_b", none).alias("new_in_b"),
                F.coalesce("missing_count", F.lit(0)).alias("missing_count"),
                F.coalesce("missing_in_b", none).alias("missing_in_b")))


def compare_labels(a: Dataset, b: Dataset) -> DataFrame:
    """(column, label, side): every label of a shared category that only one side has, a row each."""
    cols = shared(a, b, CATEGORICAL)
    if not cols:
        return a.spark.createDataFrame([], "column string, label string, side string")
    return _one_sided(a, b, cols).select("column", "label", F.col("lo").alias("side"))


def _one_sided(a: Dataset, b: Dataset, cols: list[str]) -> DataFrame:
    """Labels of both sides meet once in a shuffle of distinct labels."""
    return (
        label_counts(a.table, cols).select("column", "label", F.lit("a").alias("side"))
        .unionByName(label_counts(b.table, cols).select("column", "label", F.lit("b").alias("side")))
        .groupBy("column", "label").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        .where("lo = hi"))


def compare_overview(a: Dataset, b: Dataset) -> DataFrame:
    """Size, missing share and duplicate rows of both sides."""
    def side(s: str, ds: Dataset):
        cells = ds.rows * len(ds.columns)
        missing = sum(c.missing for c in ds.columns)
        return (s, ds.name, ds.rows, len(ds.columns), missing / cells * 100 if cells else 0.0,
                duplicate_count(ds.compared))
    return a.spark.createDataFrame(
        [side("a", a), side("b", b)],
        "side string, name string, rows long, columns int, missing_pct double, duplicates long")
