"""Cleaned output: CSV sink and preview."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profila.functions.text import quoted
from profila.functions.labels import cell_text, value_text
from profila.model import DATETIME, EXACT, NUMERIC, ROW, Dataset
from profila.operators.quality import dedupe

PREVIEW_ROWS = 50


def cleaned_rows(ds: Dataset, remove_duplicates: bool = False) -> DataFrame:
    """The typed table and the columns without a profile in source order, without repeated rows if wanted."""
    rows = _whole_rows(ds, remove_duplicates)
    return rows.select(*[quoted(c) for c in [*ds.table.columns, *ds.unprofiled]])


def _whole_rows(ds: Dataset, remove_duplicates: bool) -> DataFrame:
    return (dedupe(ds.compared) if remove_duplicates else ds.compared).orderBy(ROW)


def _other_text(c: Column, dtype: T.DataType) -> Column:
    """Cells of columns without a profile: nested ones as JSON, binary ones as base 64."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return F.base64(c) if isinstance(dtype, T.BinaryType) else c.cast("string")


def write_cleaned_csv(ds: Dataset, folder: str, remove_duplicates: bool = False) -> str:
    """Write ``<stem>_cleaned.csv`` (a Spark folder of UTF-8 files with byte-order mark)."""
    target = os.path.join(folder, f"{os.path.splitext(ds.name)[0]}_cleaned.csv")
    dates = ds.names(DATETIME)
    timed: dict[str, bool] = {}
    if dates:
        whole = [F.bool_and(F.col(quoted(d)) == F.date_trunc("day", F.col(quoted(d)))).alias(d) for d in dates]
        timed = {d: flag is False for d, flag in ds.table.agg(*whole).first().asDict().items()}

    def cell(name: str, kind: str) -> Column:
        c = F.col(quoted(name))
        if kind == DATETIME:
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss" if timed[name] else "yyyy-MM-dd")
        text = value_text(c, ds.table.schema[name].dataType)
        if EXACT + name in ds.compared.columns:
            source = F.col(quoted(EXACT + name)).cast("string")
            text = F.when(source.rlike(r"^-?\d+(\.\d+)?$"), source).otherwise(text)
        if kind == NUMERIC or ds.table.schema[name].dataType.typeName() == "double":
            return F.when(text.rlike(r"^-?\d+$"), F.concat(text, F.lit(".0"))).otherwise(text)
        return text

    cells = [(c.name, cell(c.name, c.type)) for c in ds.columns]
    cells += [(o, _other_text(F.col(quoted(o)), ds.compared.schema[o].dataType)) for o in ds.unprofiled]
    out = _whole_rows(ds, remove_duplicates).select(*[
        text.alias(("﻿" if i == 0 else "") + name) for i, (name, text) in enumerate(cells)])
    out.write.option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(target)
    return target


def preview(ds: Dataset, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as display strings; missing cells stay null."""
    head = ds.table.orderBy(ROW).limit(n)
    return head.select(ROW, *[
        cell_text(F.col(quoted(c.name)), ds.table.schema[c.name].dataType).alias(c.name) for c in ds.columns])
