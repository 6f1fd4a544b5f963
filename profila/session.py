"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Largest table the library broadcasts itself, in rows of a few fixed-width fields.
BROADCAST_ROWS = 1_000_000
# Most bytes of a file that one task reads: a task's distinct values are held until they are shuffled.
SPLIT_BYTES = 16 << 20


def setting(spark: SparkSession, name: str, default: int) -> int:
    """Integer setting ``spark.profila.<name>``."""
    return int(spark.conf.get(f"spark.profila.{name}", str(default)))


def broadcast_rows(spark: SparkSession) -> int:
    return setting(spark, "broadcastRows", BROADCAST_ROWS)


def use_utc(spark: SparkSession) -> SparkSession:
    """Date parsing and truncation assume UTC, so zoned stamps land on naive UTC values.

    Column names may differ by case alone, so they are told apart by it. Reads are split finer than by default.
    """
    most, name = setting(spark, "splitBytes", SPLIT_BYTES), "spark.sql.files.maxPartitionBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))
    for name, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.caseSensitive", "true")):
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local-mode session without that setting (tests) gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    folder = tempfile.mkdtemp(prefix="profila-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name for a written table below the shared folder."""
    return os.path.join(shared_folder(spark), "profila", f"{name}-{uuid.uuid4().hex}")


def together(spark: SparkSession, *tasks: Callable[[], object]) -> list:
    """Results of independent tasks, submitted to Spark at the same time.

    Small jobs then share the cluster instead of waiting for each other's last task.
    """
    if len(tasks) < 2:
        return [t() for t in tasks]
    run = inheritable_thread_target(spark)(lambda t: t())
    with ThreadPoolExecutor(min(8, len(tasks))) as pool:
        return list(pool.map(run, tasks))
