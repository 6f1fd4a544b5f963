"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profila.session import checkpointed, staging_path

__all__ = ["checkpointed", "dropped", "let", "settled", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, so later steps survive lost executors.

    ``by`` splits the files by a column with few values, so that readers of one value skip the rest.
    """
    path = staging_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``settled`` returned and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, whatever ``use`` makes of it."""
    return F.transform(F.array(value), use)[0]
