"""Column types and profiles from a table of strings or typed columns.

Strings are reduced to distinct values with counts and first rows in one shuffle; every
check on them (parse shares, date votes, examples, spellings) runs on that table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profila.functions.text import quoted
from profila.functions import text
from profila.functions.labels import value_text
from profila.model import CATEGORICAL, DATETIME, EXACT, IDENTIFIER, NUMERIC, ROW, TEXT, Column
from profila.operators.kernels import first_rows, number, numbers, value_counts
from profila.session import staging_path, together

NUMERIC_SHARE = 0.95
DATE_SHARE = 0.9
EXAMPLES = 5
EXACT_LIMIT = 1 << 53  # whole numbers below it have doubles of their own
EXACT_DIGITS = 15      # so have decimals of so many digits

# --- fixed values: notes -----------------------------------------------------------------
NOTE_SYMBOLS = "Currency or % symbols were removed to read the numbers."
NOTE_ID = "Looks like an ID or row number, so it is excluded from statistics and correlations."
NOTE_DISCRETE = "Whole numbers with few distinct values; also usable as a grouping column."
NOTE_AMBIGUOUS = "Day and month order is ambiguous in this column; it was read as day/month/year."
NOTE_TEXT_ID = "Every value is (almost) unique, so it is treated as an identifier."
NOTE_TEXT = "Too many distinct values to chart as categories; treated as free text."
NOTE_MIXED = "{:.0f}% of values are numbers but others are not, so the column was kept as text."
# -----------------------------------------------------------------------------------------

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_id_name(name: str) -> bool:
    return re.search(text.ID_NAME, name) is not None


def infer(
    raw: DataFrame, decimal_comma: bool = False, trimmed: dict[str, int] | None = None,
) -> tuple[DataFrame, list[Column], int]:
    """Whole table (doubles, naive timestamps, strings, ``_row``, then columns without a profile and exact values),
    column records, row count."""
    fields = [f for f in raw.schema.fields if f.name != ROW]
    native = {f.name: NUMERIC for f in fields if isinstance(f.dataType, T.NumericType)}
    native |= {f.name: DATETIME for f in fields if isinstance(f.dataType, _DATES)}
    strings = [f.name for f in fields
               if f.name not in native and isinstance(f.dataType, (T.StringType, T.BooleanType))]
    raw = raw.select(ROW, *[
        F.col(quoted(f.name)).cast("string").alias(f.name) if f.name in strings else F.col(quoted(f.name))
        for f in fields])
    others = [f.name for f in fields if f.name not in native and f.name not in strings]  # these have no profile
    fields = [f for f in fields if f.name in native or f.name in strings]
    rows = raw.count()

    columns = {f.name: Column(f.name, i) for i, f in enumerate(fields)}
    formats: dict[str, str] = {}
    if strings:
        distinct = value_counts(raw.select(ROW, *[quoted(c) for c in strings]), strings, first=ROW)
        distinct = distinct.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            formats = _profile_strings(distinct, [columns[c] for c in strings], decimal_comma)
        finally:
            distinct.unpersist()
    for name, kind in native.items():
        columns[name].type = kind

    shown = {c.name: _typed(raw, c, F.col(quoted(c.name)), formats, decimal_comma, c.name in native) for c in columns.values()}
    exact = [(c.name, _exact(raw, c.name, shown[c.name])) for c in columns.values() if c.type == NUMERIC]
    whole_table = raw.select(
        ROW, *[value.alias(name) for name, value in shown.items()], *[quoted(o) for o in others],
        *[value.alias(EXACT + name) for name, value in exact if value is not None])
    if any(columns[name].type in (NUMERIC, DATETIME) for name in strings):
        # text is read as numbers and dates once; all that follows is columnar
        path = staging_path(raw.sparkSession, "typed")
        whole_table.write.parquet(path)
        whole_table = raw.sparkSession.read.schema(whole_table.schema).parquet(path)
    typed = whole_table.select(ROW, *[quoted(name) for name in shown])
    together(
        raw.sparkSession,
        lambda: _profile_numbers(typed, [c for c in columns.values() if c.type == NUMERIC], native),
        lambda: _profile_dates(typed, [c for c in columns.values() if c.type == DATETIME], native))
    for c in columns.values():
        c.missing = rows - c.non_null
        c.missing_pct = c.missing / rows * 100 if rows else 0.0
        c.whitespace_fixed = (trimmed or {}).get(c.name, 0)
    return whole_table, list(columns.values()), rows


def _exact(raw: DataFrame, name: str, double: SparkColumn) -> SparkColumn | None:
    """The source value where other values may share its double, else null; None if that can't be."""
    c, dtype = F.col(quoted(name)), raw.schema[name].dataType
    if isinstance(dtype, T.LongType):
        return F.when((c >= EXACT_LIMIT) | (c <= -EXACT_LIMIT), c)
    if isinstance(dtype, T.DecimalType) and dtype.precision > EXACT_DIGITS:
        return F.when(~F.coalesce(c.cast("double").try_cast(dtype) == c, F.lit(False)), c)
    if isinstance(dtype, T.StringType):
        return F.when((F.length(c) > EXACT_DIGITS) & double.isNotNull() & (
            F.length(F.regexp_replace(c, "[^0-9]", "")) > EXACT_DIGITS), c)
    return None


def _typed(raw, c: Column, cell: SparkColumn, formats, decimal_comma, native: bool) -> SparkColumn:
    if c.type == NUMERIC:
        return number(raw, c.name) if native else text.to_number(cell, decimal_comma)
    if c.type == DATETIME:
        return cell.cast("timestamp_ntz") if native else text.to_date(cell, formats[c.name])
    return cell


# --- strings -----------------------------------------------------------------------------

def string_metrics(distinct: DataFrame, decimal_comma: bool = False) -> DataFrame:
    """Per column: value, distinct and number counts, digit and blank shares, length quantiles."""
    v, n = F.col("value"), F.col("n")

    def rows_where(cond: SparkColumn) -> SparkColumn:
        return F.sum(F.when(cond, n).otherwise(0))

    # distinct lengths grow at most with the square root of the column's size
    lengths = F.percentile(F.length(v), F.array(F.lit(0.05), F.lit(0.95)), n)
    return distinct.groupBy("column").agg(
        F.sum("n").alias("non_null"), F.count("*").alias("unique"),
        rows_where(text.to_number(v, decimal_comma).isNotNull()).alias("numbers"),
        F.bool_or(text.has_currency(v)).alias("currency"),
        rows_where(v.rlike(r"\d")).alias("with_digit"),
        rows_where(v.contains(" ")).alias("with_space"),
        F.sum(F.length(v) * n).alias("length_sum"),
        F.get(lengths, F.lit(0)).alias("length_q05"), F.get(lengths, F.lit(1)).alias("length_q95"))


def date_votes(distinct: DataFrame) -> DataFrame:
    """Per column: the share of values each date format reads, in vote order, then the
    permissive reader's share (last)."""
    v, n = F.col("value"), F.col("n")
    reads = [text.to_date(v, shown) for shown, _ in text.DATE_FORMATS] + [text.any_date(v)]
    shares = [F.sum(F.when(r.isNotNull(), n).otherwise(0)) / F.sum("n") for r in reads]
    return distinct.groupBy("column").agg(F.array(*shares).alias("shares"))


def choose_format(shares: Sequence[float]) -> tuple[str | None, bool]:
    """The winning date format and whether day and month could be swapped."""
    names = [shown for shown, _ in text.DATE_FORMATS]
    score = dict(zip(names, shares))
    best = max(names, key=lambda f: score[f])  # the earlier format wins ties
    if score[best] >= DATE_SHARE:
        swapped = any(
            best in pair and score[pair[0]] >= DATE_SHARE and score[pair[1]] >= DATE_SHARE
            for pair in text.AMBIGUOUS_FORMATS.items())
        return best, swapped
    return (text.AUTO_DETECTED if shares[len(names)] >= DATE_SHARE else None), False


def _profile_strings(distinct: DataFrame, columns: list[Column], decimal_comma: bool) -> dict[str, str]:
    """Settle the type of string columns; returns the format of each date column."""
    metrics = {r["column"]: r for r in string_metrics(distinct, decimal_comma).collect()}
    seen = [c for c in columns if c.name in metrics]
    share = {c.name: metrics[c.name]["numbers"] / metrics[c.name]["non_null"] for c in seen}
    dateable = [
        c.name for c in seen for m in [metrics[c.name]]
        if share[c.name] < NUMERIC_SHARE and m["with_digit"] / m["non_null"] >= DATE_SHARE
        and m["length_q95"] <= 40 and m["length_q05"] >= 4
    ]
    votes = {}
    if dateable:
        votes = {r["column"]: choose_format(r["shares"])
                 for r in date_votes(distinct.where(F.col("column").isin(dateable))).collect()}
    formats = {name: fmt for name, (fmt, _) in votes.items() if fmt}
    for c in seen:
        m = metrics[c.name]
        c.non_null, c.unique = m["non_null"], m["unique"]
        c.unique_pct = c.unique / c.non_null * 100
        if share[c.name] >= NUMERIC_SHARE:
            c.type = NUMERIC
            if m["currency"]:
                c.notes.append(NOTE_SYMBOLS)
        elif c.name in formats:
            c.type, c.dtype_label, c.date_format = DATETIME, "Date/time", formats[c.name]
            if votes[c.name][1]:
                c.notes.append(NOTE_AMBIGUOUS)
        else:
            _name_text_type(c, m)
            if share[c.name] >= 0.5 and c.type in (CATEGORICAL, TEXT):
                c.notes.append(NOTE_MIXED.format(share[c.name] * 100))
    together(
        distinct.sparkSession,
        lambda: _add_samples(distinct, seen), lambda: _add_invalid(distinct, seen, formats, decimal_comma),
        lambda: _add_spellings(distinct, {c.name: c for c in seen if c.type == CATEGORICAL}))
    return formats


def _name_text_type(c: Column, m) -> None:
    ratio = c.unique / c.non_null
    short = m["length_sum"] / c.non_null < 40 and m["with_space"] / c.non_null < 0.2
    if c.non_null > 20 and ratio > 0.95 and (is_id_name(c.name) or short):
        c.type, c.dtype_label = IDENTIFIER, "Text ID"
        c.notes.append(NOTE_TEXT_ID)
    elif c.unique > 50 and ratio > 0.5:
        c.type, c.dtype_label = TEXT, "Free text"
        c.notes.append(NOTE_TEXT)
    else:
        c.type, c.dtype_label = CATEGORICAL, "Category"


def first_values(distinct: DataFrame, n: int = EXAMPLES) -> DataFrame:
    """The first n distinct values of each column in row order (ties: value order)."""
    return first_rows(distinct, n, ["column"], [F.col("first"), F.col("value")])


def unreadable(distinct: DataFrame, numeric: Sequence[str], formats: dict[str, str], decimal_comma: bool) -> DataFrame:
    """Distinct values that the type of their column cannot read."""
    v, column = F.col("value"), F.col("column")
    bad = F.when(column.isin(list(numeric)), text.to_number(v, decimal_comma).isNull())
    for name, fmt in formats.items():
        bad = bad.when(column == name, text.to_date(v, fmt).isNull())
    return distinct.where(F.coalesce(bad, F.lit(False)))


def _add_samples(distinct, columns: list[Column]) -> None:
    by_name = {c.name: c for c in columns}
    for r in first_values(distinct).orderBy("column", "_nth").collect():
        by_name[r["column"]].samples.append(r["value"])


def _add_invalid(distinct, columns: list[Column], formats, decimal_comma) -> None:
    by_name = {c.name: c for c in columns}
    numeric = [c.name for c in columns if c.type == NUMERIC]
    if not numeric and not formats:
        return
    bad = unreadable(distinct, numeric, formats, decimal_comma)
    counts, shown = together(
        distinct.sparkSession,
        lambda: bad.groupBy("column").agg(F.sum("n").alias("n")).collect(),
        lambda: first_values(bad).orderBy("column", "_nth").collect())
    for r in counts:
        by_name[r["column"]].invalid = r["n"]
    for r in shown:
        by_name[r["column"]].invalid_examples.append(r["value"])


def _numbered(groups: DataFrame, order: Sequence[SparkColumn], limit: int | None) -> DataFrame:
    return first_rows(groups, limit or (1 << 31) - 1, ["column"], order).withColumnRenamed("_nth", "position")


def case_variants(distinct: DataFrame, limit: int | None = None) -> DataFrame:
    """Spellings that differ only in capitals: (column, position, spellings), all of them unless limited."""
    groups = distinct.groupBy("column", F.lower("value").alias("folded")).agg(
        F.count("*").alias("k"), F.sort_array(F.collect_list("value")).alias("spellings"),
        F.min("first").alias("first")).where("k > 1")
    return _numbered(groups, [F.col("first"), F.col("folded")], limit).select("column", "position", "spellings")


def abbreviations(distinct: DataFrame, limit: int | None = None) -> DataFrame:
    """One- or two-letter values that begin exactly one longer value of the column: an equality join on the prefix.

    Longer values are counted per prefix before they meet, so a common first letter is no hot key.
    """
    size, folded = F.length("value"), F.lower("value")
    short = distinct.where(size.between(1, 2)).select(
        "column", folded.alias("prefix"), F.col("value").alias("short"), "first")
    longer = distinct.where(size > 2).select(
        "column", F.col("value").alias("long"),
        F.explode(F.array(F.substring(folded, 1, 1), F.substring(folded, 1, 2))).alias("prefix"))
    single = longer.groupBy("column", "prefix").agg(F.count("*").alias("k"), F.first("long").alias("long")).where("k = 1")
    return _numbered(short.join(single, ["column", "prefix"]), [F.col("first"), F.col("short")], limit).select(
        "column", "position", "short", "long")


def _add_spellings(distinct, by_name: dict[str, Column]) -> None:
    if not by_name:
        return
    cats = distinct.where(F.col("column").isin(list(by_name)))
    variants, short = together(
        distinct.sparkSession,
        lambda: case_variants(cats).orderBy("column", "position").collect(),
        lambda: abbreviations(cats).orderBy("column", "position").collect())
    for r in variants:
        by_name[r["column"]].case_variants.append(list(r["spellings"]))
    for r in short:
        by_name[r["column"]].abbreviations.append([r["short"], r["long"]])


# --- numbers and dates -------------------------------------------------------------------

def number_metrics(distinct: DataFrame) -> DataFrame:
    """Per column: valid and distinct counts, whole-number test, range, distance to the row number."""
    v = F.col("value")
    return distinct.groupBy("column").agg(
        F.sum("n").alias("valid"), F.count("*").alias("unique"),
        F.bool_and(v % 1 == 0).alias("whole"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.min(v - F.col("first")).alias("shift_lo"), F.max(v - F.col("first")).alias("shift_hi"))


def in_row_order(distinct: DataFrame) -> DataFrame:
    """Per column of consecutive distinct whole numbers: does v + 1 always come after v?

    Every value meets its successor by equality, so no global order is needed.
    """
    at = distinct.select("column", F.col("value").alias("k"), F.col("first").alias("own"),
                         F.lit(None).cast("long").alias("previous"))
    after = distinct.select("column", (F.col("value") + 1).alias("k"), F.lit(None).cast("long").alias("own"),
                            F.col("first").alias("previous"))
    met = at.unionByName(after).groupBy("column", "k").agg(F.max("own").alias("own"), F.max("previous").alias("previous"))
    return met.groupBy("column").agg(
        F.bool_and(F.coalesce(F.col("own") > F.col("previous"), F.lit(True))).alias("ordered"))


def _profile_numbers(typed: DataFrame, columns: list[Column], native) -> None:
    if not columns:
        return
    names = [c.name for c in columns]
    distinct = value_counts(numbers(typed, names, ROW), names, first=ROW).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        metrics = {r["column"]: r for r in number_metrics(distinct).collect()}
        consecutive = {
            n for n, m in metrics.items()
            if m["whole"] and m["valid"] > 10 and m["unique"] == m["valid"] and m["hi"] - m["lo"] == m["valid"] - 1
        }
        counting = {n for n in consecutive if metrics[n]["shift_lo"] == metrics[n]["shift_hi"]}
        unclear = consecutive - counting
        if unclear:
            ordered = in_row_order(distinct.where(F.col("column").isin(sorted(unclear)))).where("ordered")
            counting |= {r["column"] for r in ordered.collect()}
        _add_native_samples(distinct, columns, native, T.DoubleType())
    finally:
        distinct.unpersist()
    for c in columns:
        m = metrics.get(c.name)
        whole = bool(m and m["whole"])
        c.dtype_label = "Integer" if whole else "Decimal"
        if m is None:
            continue
        valid, c.unique = m["valid"], m["unique"]
        c.unique_pct = c.unique / valid * 100
        if c.name in native:
            c.non_null = valid
        if (is_id_name(c.name) and c.unique / valid > 0.9) or c.name in counting:
            c.type = IDENTIFIER
            c.notes.append(NOTE_ID)
        elif whole and 2 <= c.unique <= 10 and valid >= 20:
            c.discrete = True
            c.notes.append(NOTE_DISCRETE)


def _profile_dates(typed: DataFrame, columns: list[Column], native) -> None:
    if not columns:
        return
    names = [c.name for c in columns]
    distinct = value_counts(typed.select(ROW, *[quoted(n) for n in names]), names, first=ROW)
    metrics = {r["column"]: r for r in distinct.groupBy("column").agg(
        F.sum("n").alias("valid"), F.count("*").alias("unique"),
        F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    _add_native_samples(distinct, columns, native, T.TimestampNTZType())
    for c in columns:
        c.dtype_label = "Date/time"
        m = metrics.get(c.name)
        if m is None:
            continue
        if c.name in native:
            c.non_null = m["valid"]
        c.unique, c.min_date, c.max_date = m["unique"], m["lo"], m["hi"]
        c.unique_pct = c.unique / max(c.non_null, 1) * 100


def _add_native_samples(distinct, columns, native, dtype) -> None:
    by_name = {c.name: c for c in columns if c.name in native}
    if by_name:
        shown = first_values(distinct.where(F.col("column").isin(list(by_name))))
        for r in shown.orderBy("column", "_nth").select("column", value_text(F.col("value"), dtype).alias("s")).collect():
            by_name[r["column"]].samples.append(r["s"])
