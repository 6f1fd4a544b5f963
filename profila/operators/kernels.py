"""Building blocks shared by the operators.

All of them keep per-task state bounded whatever the size or skew of the input: rows are
reduced by partial aggregation before they move, and anything that grows with the data
stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profila.functions.labels import OTHER, label, value_text
from profila.functions.text import finite, quoted
from profila.session import staging_path

SKETCH = 10_000              # a quantile of the sketch is off by one in so many ranks at most
REACHES = (3 / SKETCH, 0.03)  # half widths of the spans around wanted ranks, as shares of a group
CELLS = 1 << 20              # cells that meet their rows in one task


def number(df: DataFrame, name: str) -> Column:
    """A column as double without NaN or infinities."""
    c = F.col(quoted(name)).cast("double")
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return finite(c) if floating else c


def numbers(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """Only the wanted columns, as clean doubles (prunes the scan)."""
    return df.select(*keep, *[number(df, c).alias(c) for c in cols])


def long_form(df: DataFrame, cols: Sequence[str], *keep: str) -> DataFrame:
    """(keep..., column, value), one row per cell, nulls included."""
    return df.unpivot([quoted(k) for k in keep], [quoted(c) for c in cols], "column", "value")


def settled(df: DataFrame) -> DataFrame:
    """A bounded metric table computed once; later reads scan its few rows, not the data."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


# --- quantiles ---------------------------------------------------------------------------

def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation: keys, n, q (array).

    The groups themselves are few (columns, labels, periods); their sizes are unbounded. The first scan
    makes one mergeable sketch per group, whose quantiles are off by one rank in ``SKETCH`` at most. Values
    around each wanted rank, as far as that error reaches, form a span. The second scan counts the rows
    between the spans and the equal values within them, which gives the ranks exactly. Both are map-side
    aggregates, whatever the values; what meets per group is a few ten-thousandths of its distinct values.
    """
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    probes = sorted({min(1.0, max(0.0, p + side * reach)) for p in probs for reach in REACHES for side in (-1, 1)})
    sketches = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
        F.percentile_approx("_v", probes, SKETCH).alias("at")).collect()
    groups = {tuple(g[k] for k in keys): g for g in sketches}
    spans = {key: _spans(g, dict(zip(probes, g["at"])), probs) for key, g in groups.items()}
    found = _selected(rows, keys, spans, groups, probs) if groups else {}
    missed = {key for key in groups if None in found[key]}
    if missed:  # the sketch was off by more than it promises: count all values of those groups
        whole = {key: [(groups[key]["lo"], groups[key]["hi"])] for key in missed}
        found |= _selected(rows, keys, whole, {key: groups[key] for key in missed}, probs)
    out = []
    for key, g in groups.items():
        q = []
        for i, p in enumerate(probs):
            at = p * (g["n"] - 1)
            low, high = found[key][2 * i], found[key][2 * i + 1]
            q.append(low + (high - low) * (at - int(at)))
        out.append((*key, g["n"], q))
    return spark.createDataFrame(out, T.StructType([
        *[rows.schema[k] for k in keys],
        T.StructField("n", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType()))]))


def _spans(group, at: dict[float, float], probs: Sequence[float]) -> list[tuple[float, float]]:
    """Disjoint value spans that hold the wanted ranks: the narrowest reach that covers error and rounding."""
    reach = next((r for r in REACHES if r * group["n"] >= 3 + group["n"] / SKETCH), None)
    if reach is None:
        return [(group["lo"], group["hi"])]
    out: list[tuple[float, float]] = []
    for p in sorted(probs):
        low = at[max(0.0, p - reach)] if p > reach else group["lo"]
        high = at[min(1.0, p + reach)] if p + reach < 1 else group["hi"]
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _selected(rows, keys, spans, groups, probs) -> dict[tuple, list[float | None]]:
    """Per group the values at the ranks below and above each wanted place; None for a rank outside the spans."""
    most = max(map(len, spans.values()))
    bounds = [(*key, groups[key]["n"], *[x for span in [*held, *[(None, None)] * (most - len(held))] for x in span])
              for key, held in spans.items()]
    names = [f"_{end}{i}" for i in range(most) for end in ("lo", "hi")]
    table = rows.sparkSession.createDataFrame(bounds, T.StructType([
        *[T.StructField(f"_key{i}", rows.schema[k].dataType) for i, k in enumerate(keys)], T.StructField("_n", T.LongType()),
        *[T.StructField(n, T.DoubleType()) for n in names]]))
    same = reduce(lambda a, b: a & b, [F.col(quoted(k)).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    near = rows.join(F.broadcast(table), same)
    v = F.col("_v")
    begun = sum((F.coalesce(v >= F.col(f"_lo{i}"), F.lit(False)).cast("int") for i in range(most)), F.lit(0))
    inside = reduce(lambda a, b: a | b, [F.coalesce(v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.lit(False)) for i in range(most)])
    counted = near.groupBy(*keys, "_n", begun.alias("_cell"), F.when(inside, v).alias("_value")).agg(F.count("*").alias("_rows"))
    order = W.partitionBy(*keys).orderBy("_cell", F.col("_value").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.sum("_rows").over(order))
    ranks = [F.least(F.floor(F.lit(p) * (F.col("_n") - 1)) + up, F.col("_n") - 1) for p in probs for up in (0, 1)]
    picked = placed.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_upto") > rank, F.struct("_upto", "_value")))["_value"].alias(f"_q{i}")
        for i, rank in enumerate(ranks)])
    return {tuple(r[k] for k in keys): [r[f"_q{i}"] for i in range(len(ranks))] for r in picked.collect()}


# --- value counts and labels -------------------------------------------------------------

def value_counts(df: DataFrame, cols: Sequence[str], *, first: str | None = None) -> DataFrame:
    """(column, value, n[, first]) over the non-null cells; equal cells meet map-side first."""
    aggs = [F.count("*").alias("n")] + ([F.min(first).alias("first")] if first else [])
    cells = long_form(df, cols, *([first] if first else []))
    return cells.where(F.col("value").isNotNull()).groupBy("column", "value").agg(*aggs)


def labelled(df: DataFrame, name: str, keep_missing: bool = True) -> Column:
    c, dtype = F.col(quoted(name)), df.schema[name].dataType
    return label(c, dtype) if keep_missing else value_text(c, dtype)


def top_labels(df: DataFrame, name: str, n: int, keep_missing: bool = True) -> tuple[Column, list[str]]:
    """Label expression with rare values merged into Other, and the labels in order.

    At most n + 1 rows reach the driver; membership becomes an IN list, not a join.
    """
    text = labelled(df, name, keep_missing)
    counts = df.select(text.alias("label")).where("label is not null").groupBy("label").count()
    head = [r["label"] for r in counts.orderBy(F.desc("count"), "label").limit(n + 1).collect()]
    if len(head) <= n:
        return text, head
    top = head[:n]
    # a value that is itself called Other shares the bucket, which comes last
    order = [t for t in top if t != OTHER] + [OTHER]
    return F.when(text.isNull(), None).when(text.isin(top), text).otherwise(OTHER), order


def label_table(spark, labels: Sequence[str], name: str, position: str) -> DataFrame:
    """The few labels with their display positions."""
    return spark.createDataFrame(
        [(lab, i) for i, lab in enumerate(labels)],
        T.StructType([T.StructField(name, T.StringType()), T.StructField(position, T.IntegerType())]))


# --- ranks -------------------------------------------------------------------------------

def running_totals(values: DataFrame, group: str, value: str, counts: Sequence[str]) -> DataFrame:
    """Add ``upto_<count>``: the running sum of each count over the distinct values of each group, in value order.

    ``values`` are range-partitioned by (group, value), all groups together. They are written, so that partition
    membership is fixed. Sums inside a partition are shifted by those of the partitions before.
    """
    path = staging_path(values.sparkSession, "ranks")
    values.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = values.sparkSession.read.parquet(path)
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    shifts = parts.groupBy(group, "_part").agg(*[F.sum(c).alias(f"in_{c}") for c in counts]).select(
        group, "_part", *[F.coalesce(F.sum(f"in_{c}").over(before), F.lit(0)).alias(f"shift_{c}") for c in counts])
    inside = W.partitionBy(group, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return parts.join(F.broadcast(shifts), [group, "_part"]).select(
        *values.columns,
        *[(F.sum(c).over(inside) + F.col(f"shift_{c}")).alias(f"upto_{c}") for c in counts])


@dataclass
class RankTable:
    """Per row the average ranks of its values; ``rank(i, j)`` is column i's rank among the rows where j is present."""

    rows: DataFrame
    slots: dict[int, int]  # place of a partner's ranks; partners without gaps have place 0

    def rank(self, i: int, j: int) -> Column:
        return F.get(f"r{i}", F.lit(self.slots.get(j, 0))) if self.slots else F.col(f"r{i}")


def rank_table(df: DataFrame, cols: Sequence[str], gappy: Sequence[str], row: str | None = None) -> RankTable:
    """Ranks of all columns, next to every partner.

    ``gappy`` names the columns with missing values. A row's bitmask of those, as a string, is a dimension of
    one histogram (column, value, mask, count) for all columns; a value's rank next to a partner counts the
    masks that hold the partner. Ranks meet the cells in one join and the cells their row in one shuffle,
    whatever the number of columns. That shuffle comes before the aggregate, in tasks of about ``CELLS`` cells:
    no two cells of a row meet earlier in a way that would save rows, so a partial aggregate would only hold
    all rows of its task. ``row`` names a column that is unique per row; without one the rows are
    written first, so that numbers given to them hold.
    """
    spark = df.sparkSession
    rows = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(cols)],
                     (F.col(quoted(row)) if row else F.monotonically_increasing_id()).alias("id"))
    if row is None:
        path = staging_path(spark, "rank-rows")
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
    slots = {cols.index(c): k + 1 for k, c in enumerate(gappy)}
    present = [F.when(F.col(f"c{i}").isNull(), "0").otherwise("1") for i in slots]
    mask = [F.concat(*present).alias("mask")] if present else []
    cells = rows.select("id", *mask, F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("value")) for i in range(len(cols))])).alias("cell")).select(
        "id", *["mask"][: len(mask)], "cell.c", "cell.value").where("value is not null")
    names = [f"n{k}" for k in range(len(slots) + 1)]
    seen = cells.groupBy("c", "value", *["mask"][: len(mask)]).agg(F.count("*").alias("n0"))
    if slots:
        # the range partitioning keeps equal values together, so this aggregate needs no shuffle of its own
        seen = seen.repartitionByRange("c", "value").groupBy("c", "value").agg(F.sum("n0").alias("n0"), *[
            F.sum(F.when(F.substring("mask", k, 1) == "1", F.col("n0")).otherwise(0)).alias(f"n{k}") for k in slots.values()])
    else:
        seen = seen.repartitionByRange("c", "value")
    ranks = [F.col(f"upto_{n}") - (F.col(n) - 1) / 2 for n in names]
    looked_up = running_totals(seen, "c", "value", names).select(
        "c", "value", (F.array(*ranks) if slots else ranks[0]).alias("r"))
    tasks = max(1, -(-rows.count() * len(cols) // CELLS))
    return RankTable(cells.join(looked_up, ["c", "value"]).repartition(tasks, "id").groupBy("id").agg(*[
        F.max(F.when(F.col("c") == i, F.col("r"))).alias(f"r{i}") for i in range(len(cols))]), slots)


# --- samples -----------------------------------------------------------------------------

def drawing_order(keys: Sequence[str | Column], seed: int = 42) -> Column:
    """The hash by which rows are drawn: hexadecimal MD5 of seed and keys, joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(quoted(k)) if isinstance(k, str) else k).cast("string") for k in keys]))


def sample_rows(df: DataFrame, n: int, total: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, total) rows, always the same ones: the bottom n by ``drawing_order``.

    A hash threshold sized for n rows runs in the scan, so only about n rows meet in the final top-n; it is
    raised until it lets enough rows through.
    """
    if total <= n:
        return df
    hashed = df.withColumn("_hash", drawing_order(keys, seed))
    share = (n + 10 * n ** 0.5 + 100) / total
    kept = hashed
    while share < 1.0:
        kept = hashed.where(F.col("_hash") < f"{int(share * 16 ** 15):015x}")
        if kept.count() >= n:
            break
        share, kept = share * 4, hashed
    return kept.orderBy("_hash", *[F.col(quoted(k)) for k in keys]).limit(n).drop("_hash")


def first_rows(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First n rows per group; Spark drops the surplus before and after the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n)
