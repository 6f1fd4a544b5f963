"""Interactive analyses of a dataset: the arguments are checked before a plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from profila.model import DATETIME, NUMERIC, ROW, Dataset
from profila.operators import relate
from profila.operators.timeseries import TimeSeries
from profila.operators.timeseries import timeseries as prepare


def scatter(ds: Dataset, x: str, y: str, color: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(fit, points) of two numeric columns, the points by colour group."""
    ds.require(x, "the X axis", NUMERIC)
    ds.require(y, "the Y axis", NUMERIC)
    if color:
        ds.require(color, "a colour group", grouping=True)
    points = relate.scatter_points(ds.table, x, y, [ROW], color)
    return relate.scatter_fit(ds.table, x, y), points


def scatter_matrix(ds: Dataset, columns: Sequence[str]) -> DataFrame:
    """Sampled complete rows of 2 to 6 numeric columns."""
    for c in columns:
        ds.require(c, "a scatter-matrix column", NUMERIC)
    return relate.scatter_matrix(ds.table, columns, [ROW])


def pivot(
    ds: Dataset, rows: str, cols: str | None = None, values: str | None = None, agg: str = "mean",
) -> DataFrame:
    """Aggregate of a numeric column by one or two grouping columns; rows are counted without one."""
    ds.require(rows, "pivot rows", grouping=True)
    if cols:
        ds.require(cols, "pivot columns", grouping=True)
    if values:
        ds.require(values, "pivot values", NUMERIC)
    return relate.pivot(ds.table, rows, cols, values, agg)


def crosstab(ds: Dataset, a: str, b: str) -> relate.CrossTab:
    """Counts and chi-square test of two grouping columns."""
    ds.require(a, "a cross-tab row", grouping=True)
    ds.require(b, "a cross-tab column", grouping=True)
    return relate.crosstab(ds.table, a, b)


def timeseries(
    ds: Dataset, date: str, value: str | None = None, agg: str = "sum", freq: str = "auto",
) -> TimeSeries:
    """Series of a numeric column, or of the row count, over a date column."""
    ds.require(date, "a date column", DATETIME)
    if value:
        ds.require(value, "a time-series value", NUMERIC)
    return prepare(ds.table, date, value, agg, freq)
