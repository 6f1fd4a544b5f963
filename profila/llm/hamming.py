"""Exact nearest binary codes by incremental multi-index hashing.

A code of 64 bits has four segments of 16. In round r every open query looks up, segment by segment,
the values at distance r of its own; codes met are verified on all bits. After round r every code
within 4 r + 3 has been met, so a query whose k-th best distance is at most that is finished.

Only distinct codes are indexed, each with its ``k + 1`` smallest ids: more can never be answers.

Defined cases: null ids and null codes take no part; equal distances go to the smaller id; a query
is not its own answer; rows repeating an id count once; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profila.llm.common import checkpointed, settled

SEGMENTS, BITS = 4, 16


def sign_code(vector: Column) -> Column:
    """64 bits: which of the first 64 components are positive; null for null or shorter vectors."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(
        F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) >= 64, code)


def _segments(code: Column) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(code, BITS * i).bitwiseAND(0xFFFF).cast("int").alias("value"))
        for i in range(SEGMENTS)])


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, distance. Both tables have vec_id and code (long)."""
    codes, queries = (d.select("vec_id", "code").where("vec_id is not null and code is not null").distinct() for d in (codes, queries))
    order = Window.partitionBy("code").orderBy("vec_id")
    held = settled(codes.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).drop("at"), "codes-held")
    index = settled(
        held.groupBy("code").agg(F.min("vec_id").alias("least"))
        .select("code", "least", F.explode(_segments(F.col("code"))).alias("s")).select("code", "least", "s.*"),
        "codes-index")
    total = index.count() // SEGMENTS
    asked = checkpointed(queries.select(F.col("code").alias("asked")).distinct())
    found, open_codes = None, asked
    best = Window.partitionBy("asked").orderBy("distance", "least")
    for radius in range(BITS + 1):
        flips = F.array(*[F.lit(sum(1 << b for b in c)) for c in combinations(range(BITS), radius)])
        probes = open_codes.select("asked", F.explode(_segments(F.col("asked"))).alias("s")).select(
            "asked", "s.segment", F.explode(F.transform(flips, lambda f: F.col("s.value").bitwiseXOR(f))).alias("value"))
        met = probes.join(index, ["segment", "value"]).select("asked", "code", "least").distinct().withColumn(
            "distance", F.bit_count(F.col("asked").bitwiseXOR(F.col("code"))))
        # Codes rank by distance and smallest id; k + 1 hold k answers even if a query is among them.
        pool = met if found is None else found.unionByName(met).distinct()
        found = checkpointed(pool.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).drop("at"))
        reach = SEGMENTS * radius + SEGMENTS - 1
        done = found.groupBy("asked").agg(F.sum((F.col("distance") <= reach).cast("int")).alias("n")).where(
            F.col("n") >= min(k + 1, total))
        open_codes = checkpointed(open_codes.join(done, "asked", "left_anti"))
        if open_codes.isEmpty():
            break
    rank = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("asked")).join(found, "asked")
        .drop("least").join(held, "code").where("vec_id <> query_id").select("query_id", "vec_id", "distance").distinct()
        .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "distance"))
