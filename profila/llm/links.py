"""Connected components of a table of links, on Spark.

Every vertex repeatedly points all its larger neighbours, then all its smaller ones, at the smallest
vertex it knows; the links become stars within few rounds. A vertex with many links is one row per
link throughout: minima are combined before the shuffle, and written out so that joins with them can
be split where a key is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profila.llm.common import checkpointed


def _star(links: DataFrame) -> DataFrame:
    """One round over links (a, b) with a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    links = checkpointed(large.where("a <> b").distinct())
    least = checkpointed(links.groupBy("a").agg(F.min("b").alias("m")))
    small = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``pairs`` (a, b) but the smallest of each component.

    Null ends and links of a vertex with itself are ignored; repeated pairs count once.
    """
    links = checkpointed(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(links)
    while mark[0]:
        links = _star(links)
        mark, before = _mark(links), mark
        if mark == before:
            break
    return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
