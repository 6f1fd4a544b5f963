"""What the operators pass around: column records and datasets."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from profila.functions.text import quoted

ROW = "_row"  # 1-based row number in source order; carried along, never analysed
EXACT = "_exact:"  # prefix of the source values of numbers that a double cannot tell apart

NUMERIC, DATETIME, CATEGORICAL, TEXT, IDENTIFIER = (
    "numeric", "datetime", "categorical", "text", "identifier",
)
TYPES = (NUMERIC, CATEGORICAL, DATETIME, TEXT, IDENTIFIER)


@dataclass
class Column:
    """Profile of one column; the schema of a dataset is a list of these."""

    name: str
    position: int
    type: str = CATEGORICAL
    dtype_label: str = "Category"
    non_null: int = 0
    missing: int = 0
    missing_pct: float = 0.0
    invalid: int = 0
    invalid_examples: list[str] = field(default_factory=list)
    discrete: bool = False
    unique: int = 0
    unique_pct: float = 0.0
    samples: list[str] = field(default_factory=list)
    date_format: str | None = None
    min_date: dt.datetime | None = None
    max_date: dt.datetime | None = None
    case_variants: list[list[str]] = field(default_factory=list)
    abbreviations: list[list[str]] = field(default_factory=list)
    whitespace_fixed: int = 0
    notes: list[str] = field(default_factory=list)

    @property
    def groupable(self) -> bool:
        return self.type == CATEGORICAL or (self.type == NUMERIC and self.discrete)


_STRINGS = T.ArrayType(T.StringType())
COLUMN_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("dtype_label", T.StringType()),
    T.StructField("non_null", T.LongType()),
    T.StructField("missing", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()),
    T.StructField("invalid", T.LongType()),
    T.StructField("invalid_examples", _STRINGS),
    T.StructField("discrete", T.BooleanType()),
    T.StructField("unique", T.LongType()),
    T.StructField("unique_pct", T.DoubleType()),
    T.StructField("samples", _STRINGS),
    T.StructField("date_format", T.StringType()),
    T.StructField("min_date", T.TimestampNTZType()),
    T.StructField("max_date", T.TimestampNTZType()),
    T.StructField("case_variants", T.ArrayType(_STRINGS)),
    T.StructField("abbreviations", T.ArrayType(_STRINGS)),
    T.StructField("whitespace_fixed", T.LongType()),
    T.StructField("notes", _STRINGS),
])


@dataclass
class Dataset:
    """A typed table with its column records.

    ``table`` holds doubles, naive timestamps and strings plus ``_row``. ``whole``, if given, also
    holds the columns without a profile and the exact values of numbers that may share a double;
    rows are compared there.
    """

    name: str
    table: DataFrame
    columns: list[Column]
    rows: int
    load_report: DataFrame | None = None
    whole: DataFrame | None = None

    @classmethod
    def split(cls, name: str, whole: DataFrame, columns: list[Column], rows: int, load_report: DataFrame | None = None):
        """From a whole table: ``table`` is its profiled part."""
        table = whole.select(ROW, *[quoted(c.name) for c in columns])
        return cls(name, table, columns, rows, load_report, whole)

    @property
    def compared(self) -> DataFrame:
        """Where equal rows are equal in the source."""
        return self.table if self.whole is None else self.whole

    @property
    def unprofiled(self) -> list[str]:
        """Nested, binary and other columns that only ``whole`` holds."""
        known = {ROW, *self.table.columns}
        return [c for c in self.compared.columns if c not in known and not c.startswith(EXACT)]

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    def schema_table(self) -> DataFrame:
        """One row per column."""
        return self.spark.createDataFrame([asdict(c) for c in self.columns], COLUMN_SCHEMA)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise ValueError(f"Column '{name}' does not exist in this dataset.")

    def names(self, *types: str) -> list[str]:
        return [c.name for c in self.columns if not types or c.type in types]

    def grouping(self) -> list[str]:
        return [c.name for c in self.columns if c.groupable]

    def require(self, name: str, role: str, *types: str, grouping: bool = False) -> str:
        """Check that a column exists and may play the role."""
        c = self.column(name)
        if c.type not in types and not (grouping and c.groupable):
            raise ValueError(f"'{name}' cannot be used as {role}.")
        return name
