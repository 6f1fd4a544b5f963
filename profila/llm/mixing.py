"""Mix sources to target weights by fitting a subset sum of document lengths.

Every source gets a target in words. Whole rounds of a source are taken while they fit; what is
left of the target is filled exactly where possible: the documents are counted by length, each
length first gives its proportional share, long documents then close most of the gap, and a
bounded knapsack over the remaining counts fills the rest. Which documents of a length are taken
follows a seeded hash.

Defined cases: null text or text of white space only has size 0 and nothing is taken; null sources
are one source, sorted last; rows with equal ids are separate documents; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profila.llm.common import settled

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20_240_611
# Words the knapsack may have to fill; everything above is closed by long documents first.
KNAPSACK_WORDS = 65_536
WORD = r"[^\x20\x09-\x0D]+"
# Hash ranges per length: the unit in which documents of one length are ranked.
RANGE_BITS = 10


def water_fill(totals: Sequence[int], weights: Sequence[int], limit: int = MAX_REPEATS) -> list[Fraction]:
    """Shares of ``sum(totals)`` by weight, none above ``limit`` times its total; excess is shared again."""
    shares: list[Fraction] = [Fraction(0)] * len(totals)
    left, free = Fraction(sum(totals)), list(range(len(totals)))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > limit * totals[i]]
        if not over:
            for i in free:
                shares[i] = left * weights[i] / weight
            break
        for i in over:
            shares[i] = Fraction(limit * totals[i])
        left -= sum(shares[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return shares


def _knapsack(items: Iterable[tuple[int, int]], room: int) -> dict[int, int]:
    """Counts per length whose total is the largest reachable one up to ``room``.

    Sums that can be reached are the set bits of an integer; counts are split into powers of two.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in items:
        part = 1
        while count > 0 and not reach >> room & 1:
            part = min(part, count)
            if length * part > room:
                break
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            count, part = count - part, part * 2
    at, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + part
            at -= length * part
    return taken


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int, room: int = KNAPSACK_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come closest to ``budget``."""
    length, count = np.asarray(lengths, dtype=object), np.asarray(counts, dtype=object)
    words = int(sum(length * count)) if len(length) else 0
    if budget <= 0 or not words:
        return [0] * len(length)
    take = [int(c) * budget // words for c in count] if budget < words else [int(c) for c in count]
    gap = budget - sum(n * t for n, t in zip(length, take))
    order = sorted(range(len(length)), key=lambda i: -length[i])
    for i in order:
        if gap > room:
            more = min(count[i] - take[i], (gap - room) // length[i] + 1, gap // length[i])
            take[i], gap = take[i] + more, gap - more * length[i]
    where = {int(length[i]): i for i in order}
    left = [(int(length[i]), int(count[i] - take[i])) for i in reversed(order)]
    for n, extra in _knapsack(left, int(min(gap, room))).items():
        take[where[n]] += extra
        gap -= n * extra
    if gap > 0:
        nearest = next((i for i in reversed(order) if take[i] < count[i]), None)
        if nearest is not None and length[nearest] - gap < gap:
            take[nearest] += 1
    return [int(t) for t in take]


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target (of its source) and copies taken.

    ``weights`` repeat over the sources in code point order, null last. One row per source reaches
    the driver, nothing else.
    """
    spark = docs.sparkSession
    sizes = settled(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("words")).collect()
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    totals = [int(r["words"]) for r in sources]
    targets = water_fill(totals, [weights[i % len(weights)] for i in range(len(totals))], max_repeats)
    plan = []
    for i, (row, total, target) in enumerate(zip(sources, totals, targets)):
        rounds = min(max_repeats, int(target // total)) if total else 0
        plan.append((i, row["source"], total, float(target), rounds, round(target - rounds * total)))
    goals = spark.createDataFrame(plan, "number int, source string, source_size long, target double, rounds int, rest long")
    sizes = sizes.join(goals.withColumnRenamed("source", "goal"), F.col("source").eqNullSafe(F.col("goal"))).drop("goal")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        return group[["number", "size"]].assign(
            wanted=fit_lengths(group["size"].tolist(), group["count"].tolist(), int(group["rest"].iloc[0])))

    ranged = sizes.where("size > 0").withColumn("part", F.shiftrightunsigned("place", 64 - RANGE_BITS).cast("int"))
    wanted = (
        ranged.groupBy("number", "size").agg(F.count("*").alias("count"), F.first("rest").alias("rest"))
        .groupBy("number").applyInPandas(fit, "number int, size long, wanted long"))
    before = Window.partitionBy("number", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        ranged.groupBy("number", "size", "part").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(wanted, ["number", "size"])
        .select("number", "size", "part", F.greatest(F.col("wanted") - F.col("before"), F.lit(0)).alias("quota")))
    rank = F.row_number().over(Window.partitionBy("number", "size", "part").orderBy("place", "doc_id"))
    chosen = (
        ranged.join(quota, ["number", "size", "part"])
        .withColumn("copies", F.col("rounds") + (rank <= F.col("quota")).cast("int")))
    columns = ["doc_id", "size", "source", "source_size", "target", "copies"]
    return chosen.select(columns).unionByName(sizes.where("size = 0").withColumn("copies", F.lit(0)).select(columns))


def mixed_rows(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows meet their counts by id and a hash of text and source; rows equal in all of these share the
    largest count among them.
    """
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.xxhash64(id_col, text_col, source_col))
    keyed = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    taken = settled(
        mix(keyed, weights, max_repeats, seed).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
        .select(F.col("doc_id").alias("key"), "copies"), "mix-taken")
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    return (
        docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(taken, "key")
        .select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*columns))
