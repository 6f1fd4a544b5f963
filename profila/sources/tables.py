"""Typed sources: Parquet files and existing DataFrames."""

from __future__ import annotations

import itertools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profila.functions.text import quoted
from profila.model import ROW, Dataset
from profila.operators.infer import infer
from profila.session import broadcast_rows, use_utc


def profile_table(name: str, df: DataFrame, row: str | None = None) -> Dataset:
    """Dataset from a DataFrame that has row numbers (``row`` names them, default ``_row``)."""
    use_utc(df.sparkSession)
    if row and row != ROW:
        df = df.withColumn(ROW, F.col(row).cast("long"))
    return Dataset.split(name, *infer(df))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with ``_row``, their 1-based position over the files in path order.

    Positions come from the reader's row index plus the sizes of the files before; no sort.
    """
    rows = use_utc(spark).read.parquet(path)
    located = rows.select("*", F.col("_metadata.file_path").alias("_file"),
                          F.col("_metadata.row_index").alias("_at"))
    files = located.groupBy("_file").agg(F.count("*").alias("n"))
    return place_rows(located, files, ["_file"], F.col("_at") + 1).select(ROW, *map(quoted, rows.columns))


def place_rows(located: DataFrame, blocks: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Add ``_row``: the place inside a file block plus the sizes of the blocks before.

    ``blocks`` has one row per block (keys, n, ...). Up to the broadcast bound the starts
    are summed on the driver; beyond it Spark joins them like any table.
    """
    spark = located.sparkSession
    bound = broadcast_rows(spark)
    known = blocks.limit(bound + 1).collect()
    if len(known) <= bound:
        known.sort(key=lambda r: tuple(r[k] for k in keys))
        starts = itertools.accumulate((r["n"] for r in known), initial=0)
        schema = T.StructType([*blocks.schema.fields, T.StructField("_before", T.LongType())])
        table = F.broadcast(spark.createDataFrame([(*r, s) for r, s in zip(known, starts)], schema))
    else:
        table = blocks.withColumn("_before", F.sum("n").over(W.orderBy(*keys)) - F.col("n"))
    return located.join(table.drop("n"), keys).withColumn(ROW, F.col("_before") + inside)


def load_parquet(spark: SparkSession, path: str, name: str | None = None) -> Dataset:
    """Dataset of a Parquet file or folder."""
    return profile_table(name or os.path.basename(path.rstrip("/")), read_parquet(spark, path))
