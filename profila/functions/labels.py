"""Column expressions that put values into words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: shown words -----------------------------------------------------------
MISSING = "(missing)"
OTHER = "Other"
# -----------------------------------------------------------------------------------------


def label(c: Column, dtype: T.DataType) -> Column:
    """Readable string of a value: whole numbers lose their decimals, null is named."""
    return F.coalesce(value_text(c, dtype), F.lit(MISSING))


def value_text(c: Column, dtype: T.DataType) -> Column:
    """As ``label`` but null stays null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        whole = c.try_cast("decimal(38,0)")
        plain = F.regexp_replace(c.try_cast("decimal(38,10)").cast("string"), "0+$", "")
        return (
            F.when(c == F.floor(c), F.coalesce(whole.cast("string"), c.cast("string")))
            .when(F.abs(c) >= 1e7, F.coalesce(plain, c.cast("string")))
            .otherwise(c.cast("string"))
        )
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """Preview cell: dates without a time of day lose it."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        timed = (F.hour(c) != 0) | (F.minute(c) != 0)
        return F.when(timed, F.date_format(c, "yyyy-MM-dd HH:mm")).otherwise(
            F.date_format(c, "yyyy-MM-dd"))
    return value_text(c, dtype)


def skew_label(skew: Column) -> Column:
    side = F.when(skew > 0, "right").otherwise("left")
    size = F.abs(skew)
    return (
        F.when(skew.isNull(), "not enough data")
        .when(size < 0.5, "approximately symmetric")
        .when(size < 1, F.concat(F.lit("moderately "), side, F.lit("-skewed")))
        .otherwise(F.concat(F.lit("highly "), side, F.lit("-skewed")))
    )


def strength(r: Column) -> Column:
    """Words for a correlation coefficient."""
    sign = F.when(r > 0, "positive").otherwise("negative")
    size = F.abs(r)
    return (
        F.when(r.isNull(), "undefined")
        .when(size >= 0.7, F.concat(F.lit("strong "), sign))
        .when(size >= 0.4, F.concat(F.lit("moderate "), sign))
        .when(size >= 0.2, F.concat(F.lit("weak "), sign))
        .otherwise("very weak / none")
    )


def association(v: Column) -> Column:
    """Words for Cramér's V."""
    return (
        F.when(v.isNull(), None).when(v < 0.1, "negligible").when(v < 0.3, "weak")
        .when(v < 0.5, "moderate").otherwise("strong")
    )
