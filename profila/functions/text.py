"""Column expressions that read numbers and dates out of strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: markers, symbols and formats -----------------------------------------
# What a CSV reader takes as missing by default.
READER_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Further markers, reported to the user.
REPORTED_MARKERS = [
    "#DIV/0!", "#N/A", "#REF!", "#VALUE!", "-", "--", "<NA>", "?", "MISSING", "Missing", "N/A",
    "NA", "NULL", "NaN", "Nil", "None", "missing", "n/a", "na", "nan", "nil", "none", "null",
]
CURRENCY = "₹$€£¥%"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DECIMAL_COMMA = r"^-?\d+,\d+$"
ID_NAME = (
    r"(?i)((^|[_\s\-.])(id|uuid|guid|code|key|no|num|number)$"
    r"|^(id|uuid)([_\s\-.]|$)"
    r"|^(s\.?\s?no|sr\.?\s?no|serial))"
)
# Date formats in vote order (earlier wins ties, so day-first wins), as (shown name, pattern).
DATE_FORMATS = [
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"),
    ("%Y-%m-%d %H:%M", "yyyy-M-d H:m"),
    ("%Y-%m-%dT%H:%M:%S", "yyyy-M-d'T'H:m:s"),
    ("%Y-%m-%dT%H:%M", "yyyy-M-d'T'H:m"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%d-%m-%Y", "d-M-yyyy"),
    ("%m-%d-%Y", "M-d-yyyy"),
    ("%d.%m.%Y", "d.M.yyyy"),
    ("%Y/%m/%d", "yyyy/M/d"),
    ("%d/%m/%Y %H:%M", "d/M/yyyy H:m"),
    ("%m/%d/%Y %H:%M", "M/d/yyyy H:m"),
    ("%d/%m/%Y %H:%M:%S", "d/M/yyyy H:m:s"),
    ("%m/%d/%Y %H:%M:%S", "M/d/yyyy H:m:s"),
    ("%d-%m-%Y %H:%M", "d-M-yyyy H:m"),
    ("%d-%m-%Y %H:%M:%S", "d-M-yyyy H:m:s"),
    ("%d-%b-%Y", "d-MMM-yyyy"),
    ("%d %b %Y", "d MMM yyyy"),
    ("%b %d, %Y", "MMM d, yyyy"),
    ("%d %B %Y", "d MMMM yyyy"),
    ("%B %d, %Y", "MMMM d, yyyy"),
    ("%b %d %Y", "MMM d yyyy"),
    ("%Y-%m", "yyyy-M"),
    ("%b-%Y", "MMM-yyyy"),
    ("%b %Y", "MMM yyyy"),
    ("%B %Y", "MMMM yyyy"),
]
# Day-first format -> month-first twin.
AMBIGUOUS_FORMATS = {
    "%d/%m/%Y": "%m/%d/%Y",
    "%d-%m-%Y": "%m-%d-%Y",
    "%d/%m/%Y %H:%M": "%m/%d/%Y %H:%M",
    "%d/%m/%Y %H:%M:%S": "%m/%d/%Y %H:%M:%S",
}
AUTO_DETECTED = "auto-detected"
# -----------------------------------------------------------------------------------------

PATTERNS = dict(DATE_FORMATS)
_STAMP = r"^\d{4}-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|UTC|[+-]\d{2}(:?\d{2})?)?)?)?$"


def quoted(name: str) -> str:
    """A column name as Spark reads it, whatever dots, blanks or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def strip_blanks(c: Column) -> Column:
    """Trim every Unicode blank, not only the space character."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_missing_marker(c: Column) -> Column:
    return c.isin(sorted(set(READER_MARKERS) | set(REPORTED_MARKERS)))


def has_currency(c: Column) -> Column:
    return c.rlike(f"[{CURRENCY}]")


def to_number(c: Column, decimal_comma: bool = False) -> Column:
    """Number written with symbols, separators or accounting brackets; null if it is none."""
    bare = F.regexp_replace(c, rf"(?U)[\s{CURRENCY}]", "")
    if decimal_comma:
        bare = F.translate(F.translate(bare, ".", ""), ",", ".")
    else:
        bare = F.translate(bare, ",", "")
    bare = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    read = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    if decimal_comma:
        return finite(read)
    # most numbers are written plainly and need no replacement
    return finite(F.when(c.rlike(NUMBER), c.try_cast("double")).otherwise(read))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def _shape(pattern: str) -> str:
    """Regular expression of the strings a date pattern can read."""
    sizes = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "'T'": "T"}
    parts = re.split(r"(yyyy|MMMM|MMM|'T'|[MdHms])", pattern)
    return "^" + "".join(
        sizes.get(p, r"\d{1,2}") if i % 2 else re.escape(p) for i, p in enumerate(parts)) + "$"


def _read_date(c: Column, pattern: str) -> Column:
    # a failed parse costs an exception inside Spark; the shape test spares nearly all of them
    return F.when(c.rlike(_shape(pattern)), F.try_to_timestamp(c, F.lit(pattern)))


def to_date(c: Column, shown_format: str) -> Column:
    """Naive UTC timestamp read with one of the listed formats or the permissive reader."""
    if shown_format == AUTO_DETECTED:
        return any_date(c)
    return _read_date(c, PATTERNS[shown_format]).cast("timestamp_ntz")


def any_date(c: Column) -> Column:
    """Permissive reader: ISO stamps with or without zone, then the listed formats."""
    compact = F.regexp_replace(c, r"^(.*[0-9])\s*([+-]\d{2})(\d{2})$", "$1$2:$3")
    iso = F.when(c.rlike(_STAMP), compact.try_cast("timestamp"))
    listed = [_read_date(c, p) for _, p in DATE_FORMATS[5:]]
    return F.coalesce(iso, *listed).cast("timestamp_ntz")
