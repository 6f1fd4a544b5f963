"""The registered queries as SQL over the same tables, for an independent check."""

from __future__ import annotations

import itertools

from profila.functions.text import DATE_FORMATS
from profila.plans.inputs import COPY_SHIFT, RELATED

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# --- derived inputs ----------------------------------------------------------------------

EVENTS_GAPS = """
SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN ts END AS ts,
  CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events"""

_REL = """l_quantity AS qty, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net,
  -l_quantity * l_quantity AS falling, l_tax AS tax, 1.0::DOUBLE AS fixed"""
RELATED_SQL = f"SELECT l_orderkey, l_linenumber, {_REL} FROM lineitem"
RELATED_GAPS = f"""
SELECT CASE WHEN k % 7 <> 0 THEN qty END AS qty, price, CASE WHEN k % 5 <> 0 THEN net END AS net,
  CASE WHEN k % 3 <> 0 THEN falling END AS falling, tax, fixed
FROM (SELECT l_orderkey + l_linenumber AS k, {_REL} FROM lineitem)"""

ORDERS_REPEATED = f"""
SELECT o_orderkey AS _row, * FROM orders
UNION ALL SELECT o_orderkey + {COPY_SHIFT} AS _row, * FROM orders WHERE o_orderkey % 100 = 0"""
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

ORDERS_AS_TEXT = """
SELECT o_orderkey AS _row, o_orderkey::VARCHAR AS order_id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'absent' ELSE '$' || format('{:,.2f}', o_totalprice) END AS price,
  CASE WHEN o_orderkey % 10 = 0 THEN 'absent' ELSE format('{:,.2f}', o_totalprice) END AS mixed_price,
  strftime(o_orderdate, '%d/%m/%Y') AS day,
  strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS zoned,
  CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS status,
  'ref-' || o_orderkey::VARCHAR AS ref
FROM orders"""
TEXT_COLUMNS = ["order_id", "price", "mixed_price", "day", "zoned", "priority", "status", "ref"]

SEGMENTS = """
SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 11 = 0 THEN lower(c_mktsegment)
  WHEN o_orderkey % 13 = 0 THEN substr(c_mktsegment, 1, 1) ELSE c_mktsegment END AS segment
FROM orders JOIN customer ON o_custkey = c_custkey"""

EARLY = "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'"
LATE = """
SELECT o_orderkey, 'c' || o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice, o_orderdate AS ordered,
  CASE WHEN o_orderpriority = '5-LOW' THEN '6-NONE' ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"""

CSV_ROWS = """
SELECT o_orderkey::DOUBLE AS "order id", CASE WHEN o_orderkey % 50 <> 0 THEN round(o_totalprice, 2) END AS price,
  date_trunc('day', o_orderdate)::TIMESTAMP AS day, o_orderpriority AS priority,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderstatus END AS status
FROM orders WHERE o_orderkey % 40 <> 7"""


def union(parts) -> str:
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


# --- profiles ----------------------------------------------------------------------------

def _number_of(column: str) -> str:
    bare = f"replace(replace({column}, '$', ''), ',', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST({bare} AS DOUBLE) END"


def _text_metrics(source: str, columns: list[str]) -> str:
    """One row per text column with the counts that the type rules need."""
    return union(f"""
SELECT {i} AS pos, '{c}' AS name, count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS strings,
  count({_number_of(c)}) AS numbers, count(DISTINCT {_number_of(c)}) AS distinct_numbers,
  bool_and(({_number_of(c)}) % 1 = 0) AS whole,
  count(try_strptime({c}, '%d/%m/%Y')) AS dates, count(DISTINCT try_strptime({c}, '%d/%m/%Y')) AS distinct_dates,
  min(try_strptime({c}, '%d/%m/%Y')) AS d0, max(try_strptime({c}, '%d/%m/%Y')) AS d1,
  count(try_strptime({c}, '%Y-%m-%dT%H:%M:%SZ')) AS zoned, min(try_strptime({c}, '%Y-%m-%dT%H:%M:%SZ')) AS z0,
  max(try_strptime({c}, '%Y-%m-%dT%H:%M:%SZ')) AS z1, count(DISTINCT try_strptime({c}, '%Y-%m-%dT%H:%M:%SZ')) AS distinct_zoned,
  avg(length({c})) AS len, avg(contains({c}, ' ')::INT) AS spaced,
  regexp_matches('{c}', '(?i)(^|[_\\s.-])(id|uuid|guid|code|key|no|num|number)$') AS id_name
FROM src""" for i, c in enumerate(columns)).join([f"WITH src AS ({source}), m AS (", ")"])


def _typed_metrics(source: str, columns: list[str]) -> str:
    return _text_metrics(source, columns) + """, k AS (
SELECT *, CASE
  WHEN numbers >= 0.95 * non_null THEN CASE
    WHEN id_name AND distinct_numbers > 0.9 * numbers THEN 'identifier' ELSE 'numeric' END
  WHEN dates >= 0.9 * non_null OR zoned >= 0.9 * non_null THEN 'datetime'
  WHEN non_null > 20 AND strings > 0.95 * non_null AND (id_name OR (len < 40 AND spaced < 0.2)) THEN 'identifier'
  WHEN strings > 50 AND strings > 0.5 * non_null THEN 'text' ELSE 'categorical' END AS type,
  numbers >= 0.95 * non_null AS is_number, dates >= 0.9 * non_null AS is_day FROM m)"""


SCHEMA_PROFILE = _typed_metrics(ORDERS_AS_TEXT, TEXT_COLUMNS) + """
SELECT name, type,
  CASE WHEN is_number THEN CASE WHEN whole THEN 'Integer' ELSE 'Decimal' END
    WHEN type = 'datetime' THEN 'Date/time' WHEN type = 'identifier' THEN 'Text ID'
    WHEN type = 'text' THEN 'Free text' ELSE 'Category' END AS dtype_label,
  non_null::BIGINT AS non_null, (rows - non_null)::BIGINT AS missing,
  round((rows - non_null) / rows * 100, 6) AS missing_pct,
  (CASE WHEN is_number THEN non_null - numbers WHEN is_day THEN non_null - dates ELSE 0 END)::BIGINT AS invalid,
  (type = 'numeric' AND whole AND distinct_numbers BETWEEN 2 AND 10 AND numbers >= 20) AS discrete,
  (CASE WHEN is_number THEN distinct_numbers WHEN is_day THEN distinct_dates
    WHEN type = 'datetime' THEN distinct_zoned ELSE strings END)::BIGINT AS "unique",
  round(CASE WHEN is_number THEN distinct_numbers / numbers WHEN is_day THEN distinct_dates / non_null
    WHEN type = 'datetime' THEN distinct_zoned / non_null ELSE strings / non_null END * 100, 6) AS unique_pct,
  CASE WHEN is_day THEN '%d/%m/%Y' WHEN type = 'datetime' THEN 'auto-detected' END AS date_format,
  CASE WHEN is_day THEN d0 WHEN type = 'datetime' THEN z0 END AS min_date,
  CASE WHEN is_day THEN d1 WHEN type = 'datetime' THEN z1 END AS max_date
FROM k"""

TYPE_COUNTS = _typed_metrics(ORDERS_AS_TEXT, TEXT_COLUMNS) + """
SELECT t.type, count(k.name)::INT AS columns
FROM (VALUES ('numeric'), ('categorical'), ('datetime'), ('text'), ('identifier')) t(type)
LEFT JOIN k ON k.type = t.type GROUP BY t.type"""


def _first_five(column: str, where: str) -> str:
    return (f"(SELECT string_agg(v, ' | ' ORDER BY r, v) FROM (SELECT {column} AS v, min(_row) AS r FROM src "
            f"WHERE {column} IS NOT NULL AND {where} GROUP BY 1 ORDER BY r, v LIMIT 5))")


def _schema_examples() -> str:
    notes = {
        "order_id": "Looks like an ID or row number, so it is excluded from statistics and correlations.",
        "price": "Currency or % symbols were removed to read the numbers.",
        "mixed_price": "Too many distinct values to chart as categories; treated as free text. | "
                       "90% of values are numbers but others are not, so the column was kept as text.",
        "ref": "Every value is (almost) unique, so it is treated as an identifier.",
    }
    bad = {"order_id": _number_of("order_id") + " IS NULL", "price": _number_of("price") + " IS NULL",
           "day": "try_strptime(day, '%d/%m/%Y') IS NULL"}
    return f"WITH src AS ({ORDERS_AS_TEXT}) " + union(
        f"SELECT '{c}' AS name, {_first_five(c, 'true')} AS samples, "
        f"coalesce({_first_five(c, bad.get(c, 'false'))}, '') AS invalid_examples, '{notes.get(c, '')}' AS notes"
        for c in TEXT_COLUMNS)


NUMERIC_PARSE = f"SELECT _row, {', '.join(f'{_number_of(c)} AS {c}' for c in ('order_id', 'price', 'mixed_price', 'day'))} FROM ({ORDERS_AS_TEXT})"

DATE_PARSE = f"""
SELECT _row, strptime(day, '%d/%m/%Y') AS day, strptime(zoned, '%Y-%m-%dT%H:%M:%SZ') AS zoned FROM ({ORDERS_AS_TEXT})"""


def _date_vote() -> str:
    src = """WITH src AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS day_first,
  strftime(o_orderdate, '%Y-%m-%d %H:%M') AS stamp, strftime(o_orderdate, '%-d %B %Y') AS words FROM orders) """
    return src + union(
        f"SELECT '{c}' AS \"column\", '{shown}' AS fmt, round(count(try_strptime({c}, '{shown}')) / count(*), 6) AS share FROM src"
        for c in ("day_first", "stamp", "words") for shown, _ in DATE_FORMATS)


def _identifier_flags() -> str:
    def number(name: str, source: str, counting: bool) -> str:
        named = f"regexp_matches('{name}', '(?i)(^|[_ .-])(id|uuid|guid|code|key|no|num|number)$')"
        return f"""
SELECT '{name}' AS name, CASE WHEN ident THEN 'identifier' ELSE 'numeric' END AS type,
  CASE WHEN whole THEN 'Integer' ELSE 'Decimal' END AS dtype_label,
  (NOT ident AND whole AND u BETWEEN 2 AND 10 AND n >= 20) AS discrete, u::BIGINT AS "unique", n::BIGINT AS non_null
FROM (SELECT count(DISTINCT v) AS u, count(v) AS n, bool_and(v % 1 = 0) AS whole,
  ({named} AND count(DISTINCT v) > 0.9 * count(v)) OR {'bool_and(coalesce(step, 1) = 1) AND count(v) > 10' if counting else 'false'} AS ident
  FROM (SELECT v, v - lag(v) OVER (ORDER BY r) AS step FROM ({source})))"""

    def words(name: str, table: str) -> str:
        return f"""
SELECT '{name}', CASE WHEN n > 20 AND u > 0.95 * n AND len < 40 AND spaced < 0.2 THEN 'identifier'
  WHEN u > 50 AND u > 0.5 * n THEN 'text' ELSE 'categorical' END AS kind,
  CASE kind WHEN 'identifier' THEN 'Text ID' WHEN 'text' THEN 'Free text' ELSE 'Category' END, false, u::BIGINT, n::BIGINT
FROM (SELECT count(DISTINCT {name}) AS u, count({name}) AS n, avg(length({name})) AS len,
  avg(contains({name}, ' ')::INT) AS spaced FROM {table})"""

    def of(expr: str, key: str, table: str) -> str:
        return f"SELECT ({expr})::DOUBLE AS v, {key} AS r FROM {table}"

    return union([
        number("c_custkey", of("c_custkey", "c_custkey", "customer"), True), words("c_name", "customer"),
        number("c_nationkey", of("c_nationkey", "c_custkey", "customer"), True),
        number("c_acctbal", of("c_acctbal", "c_custkey", "customer"), True), words("c_mktsegment", "customer"),
        number("place", of("c_custkey", "c_custkey", "customer"), True),
        number("p_partkey", of("p_partkey", "p_partkey", "part"), True),
        number("p_size", of("p_size", "p_partkey", "part"), True),
        number("backwards", of("-p_partkey", "p_partkey", "part"), True),
        number("weekday", of("p_partkey % 7", "p_partkey", "part"), True)])


def _text_kinds() -> str:
    def one(name: str, expr: str, table: str) -> str:
        named = "true" if name.endswith("code") else "false"
        return f"""
SELECT '{name}' AS name, CASE WHEN n > 20 AND u > 0.95 * n AND ({named} OR (len < 40 AND spaced < 0.2)) THEN 'identifier'
  WHEN u > 50 AND u > 0.5 * n THEN 'text' ELSE 'categorical' END AS type,
  CASE type WHEN 'identifier' THEN 'Text ID' WHEN 'text' THEN 'Free text' ELSE 'Category' END AS dtype_label,
  u::BIGINT AS "unique", round(u / n * 100, 6) AS unique_pct
FROM (SELECT count(DISTINCT v) AS u, count(v) AS n, avg(length(v)) AS len, avg(contains(v, ' ')::INT) AS spaced
  FROM (SELECT {expr} AS v FROM {table}))"""
    return union([one("text", "text", "documents"), one("lang", "lang", "documents"), one("source", "source", "documents"),
                  one("p_name", "p_name", "part"), one("p_brand", "p_brand", "part"),
                  one("part_code", "'P' || p_partkey::VARCHAR", "part")])


CASE_VARIANTS = f"""
SELECT 'segment' AS "column", (row_number() OVER (ORDER BY r, folded))::INT AS position, spellings
FROM (SELECT lower(v) AS folded, string_agg(v, ' | ' ORDER BY v) AS spellings, min(r) AS r, count(*) AS k
  FROM (SELECT segment AS v, min(_row) AS r FROM ({SEGMENTS}) GROUP BY 1) GROUP BY 1)
WHERE k > 1"""

_SHORTENED = """
SELECT 'segment' AS c, CASE WHEN o_orderkey % 13 = 0 THEN substr(c_mktsegment, 1, 1)
  WHEN o_orderkey % 17 = 0 THEN lower(substr(c_mktsegment, 1, 2)) ELSE c_mktsegment END AS v, o_orderkey AS r
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'p_name', CASE WHEN p_partkey % 9 = 0 THEN substr(p_name, 1, 1) ELSE p_name END, p_partkey FROM part"""
ABBREVIATIONS = f"""
WITH u AS (SELECT c, v, min(r) AS r FROM ({_SHORTENED}) GROUP BY 1, 2)
SELECT c AS "column", (row_number() OVER (PARTITION BY c ORDER BY r, short))::INT AS position, short, long
FROM (SELECT s.c, s.v AS short, s.r, min(l.v) AS long, count(*) AS k FROM u s JOIN u l
  ON s.c = l.c AND length(s.v) BETWEEN 1 AND 2 AND length(l.v) > 2 AND starts_with(lower(l.v), lower(s.v)) GROUP BY ALL)
WHERE k = 1"""

SAMPLE_VALUES = union(
    f"""SELECT '{c}' AS "column", (row_number() OVER (ORDER BY r, v))::INT AS position, v AS value
FROM (SELECT {c} AS v, min(o_orderkey) AS r FROM orders GROUP BY 1) QUALIFY position <= 5"""
    for c in ("o_orderstatus", "o_orderpriority"))


def _csv_profile() -> str:
    rows = "(SELECT count(*) FROM src)"
    typed = {
        "order id": ("identifier", "Integer", None), "price": ("numeric", "Decimal", None),
        "day": ("datetime", "Date/time", "%Y-%m-%d"), "priority": ("categorical", "Category", None),
        "status": ("categorical", "Category", None),
    }
    trims = "(SELECT count(*) FROM orders WHERE o_orderkey % 40 <> 7 AND o_orderkey % 6 = 0)"
    return f"WITH src AS ({CSV_ROWS}) " + union(
        f"""SELECT '{c}' AS name, '{kind}' AS type, '{label}' AS dtype_label, count("{c}")::BIGINT AS non_null,
  ({rows} - count("{c}"))::BIGINT AS missing, 0::BIGINT AS invalid, count(DISTINCT "{c}")::BIGINT AS "unique",
  {f"'{fmt}'" if fmt else 'NULL'} AS date_format, ({trims if c == 'priority' else 0})::BIGINT AS whitespace_fixed FROM src"""
        for c, (kind, label, fmt) in typed.items())


CSV_LOAD_REPORT = """
SELECT 'UTF-8' AS encoding, 'semicolon' AS delimiter, count(*)::BIGINT AS rows_read,
  count(*) FILTER (o_orderkey % 40 <> 7)::BIGINT AS rows, 5::INT AS columns, 0::BIGINT AS skipped_rows,
  count(*) FILTER (o_orderkey % 40 = 7)::BIGINT AS empty_rows_removed, 'nothing' AS empty_columns_removed,
  false AS header_generated,
  (count(*) FILTER (o_orderkey % 40 = 7))::VARCHAR || ' completely empty row(s) were removed. | 1 completely empty column(s) were removed: nothing. | Leading/trailing spaces were trimmed in 1 column(s).' AS notes
FROM orders"""

CSV_ODD_HEADERS = union(
    f"""SELECT {sql_name} AS name, {"'identifier'" if i == 0 else "'numeric'"} AS type, count(*)::BIGINT AS non_null, count(*)::BIGINT AS "count",
  round(avg(v), 4) AS mean, max(v) AS max FROM (SELECT {"o_orderkey::DOUBLE" if i == 0 else f"(o_totalprice::DECIMAL(12,2) * {i})::DOUBLE"} AS v FROM orders)"""
    for i, sql_name in enumerate(("'S.No'", "'price.usd'", "'a'", "'a.1'", "'A'", "'b`t'", "'column_7'", "'x y'")))
CSV_LATE_COMMA = """
SELECT o_orderkey::DOUBLE AS key, CASE WHEN o_orderkey % 100 = 0 THEN o_orderkey + 0.5 ELSE o_orderkey END::DOUBLE AS val,
  CASE WHEN o_orderkey <= 300 THEN 'a,b,c,' || o_orderkey::VARCHAR ELSE 'none so far' END AS note FROM orders"""
CSV_LATE_REPORT = """
SELECT 'UTF-8' AS encoding, 'semicolon' AS delimiter, count(*)::BIGINT AS rows_read, count(*)::BIGINT AS rows, 3::INT AS columns,
  0::BIGINT AS skipped_rows, 0::BIGINT AS empty_rows_removed, '' AS empty_columns_removed, false AS header_generated,
  'Commas were read as decimal separators (e.g. 3,5 = 3.5).' AS notes FROM orders"""
PARQUET_ODD_NAMES = union([
    """SELECT a, b, round(CASE WHEN a = 'o.key' AND b = '`price`' THEN r WHEN a = 'o.key' THEN -r ELSE -1.0 END, 6) AS r, n
FROM (SELECT corr(x, y) AS r, count(*)::BIGINT AS n FROM (
    SELECT rank() OVER (ORDER BY o_orderkey) + (count(*) OVER (PARTITION BY o_orderkey) - 1) / 2 AS x,
      rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS y FROM orders)),
  (VALUES ('o.key', '`price`'), ('o.key', 'PRICE'), ('`price`', 'PRICE')) t(a, b)""",
    "SELECT 'Status.', o_orderstatus, NULL, count(*)::BIGINT FROM orders GROUP BY 2",
    "SELECT 'status.', o_orderpriority, NULL, count(*)::BIGINT FROM orders GROUP BY 2"])

CSV_CLEANED = """
SELECT o_orderkey::VARCHAR || '.0' AS o_orderkey, o_custkey::VARCHAR || '.0' AS o_custkey, o_orderstatus,
  CASE WHEN o_totalprice % 1 = 0 THEN o_totalprice::BIGINT::VARCHAR || '.0' ELSE o_totalprice::VARCHAR END AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""

PREVIEW = """
SELECT o_orderkey AS _row, o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
  CASE WHEN o_totalprice % 1 = 0 THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END AS o_totalprice,
  CASE WHEN hour(o_orderdate) <> 0 OR minute(o_orderdate) <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M')
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate, o_orderpriority
FROM orders o ORDER BY o.o_orderkey LIMIT 50"""

# --- statistics --------------------------------------------------------------------------


def describe(source: str, columns: list[str], words: bool = True) -> str:
    q = ", ".join(f"round(quantile_cont(v, {p}), 4) AS {n}" for p, n in
                  ((0.05, "p5"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.95, "p95")))
    side = "CASE WHEN skewness > 0 THEN 'right' ELSE 'left' END"
    label = (f", CASE WHEN skewness IS NULL THEN 'not enough data' WHEN abs(skewness) < 0.5 THEN 'approximately symmetric' "
             f"WHEN abs(skewness) < 1 THEN 'moderately ' || {side} || '-skewed' ELSE 'highly ' || {side} || '-skewed' END AS skew_label"
             if words else "")
    return f"WITH src AS ({source}) " + union(f"""
SELECT *{label} FROM (
SELECT '{c}' AS "column", count(v)::BIGINT AS "count", (count(*) - count(v))::BIGINT AS missing,
  round(avg(v), 4) AS mean, {q}, any_value(m.mode) AS mode, any_value(m.k)::BIGINT AS mode_count,
  round(stddev_samp(v), 4) AS std, round(var_samp(v), 0) AS variance, round(min(v), 6) AS "min", round(max(v), 6) AS "max",
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr, round(max(v) - min(v), 4) AS "range",
  round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis,
  round(stddev_samp(v) / abs(avg(v)) * 100, 6) AS cv_pct,
  count(*) FILTER (v = 0)::BIGINT AS zeros, count(*) FILTER (v < 0)::BIGINT AS negatives,
  count(DISTINCT v)::BIGINT AS "unique", round(sum(v), 2) AS "sum"
FROM (SELECT {c}::DOUBLE AS v FROM src),
  (SELECT CASE WHEN k > 1 THEN v END AS mode, k FROM (SELECT {c}::DOUBLE AS v, count(*) AS k FROM src
    WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 1)) m)""" for c in columns)


HIST_DISCRETE = """
SELECT 'l_linenumber' AS "column", 'discrete' AS kind, (row_number() OVER (ORDER BY v) - 1)::INT AS bin,
  v AS "left", v AS "right", v AS center, n::BIGINT AS "count"
FROM (SELECT l_linenumber::DOUBLE AS v, count(*) AS n FROM lineitem GROUP BY 1)"""

HIST_BINNED = union(f"""
WITH t AS (SELECT {c} AS v FROM lineitem),
s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM t),
p AS (SELECT *, greatest(10, least(60, CASE WHEN q3 > q1 THEN ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1.0 / 3)))
  ELSE ceil(log2(n) + 1) END))::INT AS k FROM s),
e AS (SELECT i, lo + i * ((hi - lo) / k) AS l, CASE WHEN i + 1 = k THEN hi ELSE lo + (i + 1) * ((hi - lo) / k) END AS r,
  i + 1 = k AS closed FROM p, range(0, 60) g(i) WHERE i < k)
SELECT '{c}' AS "column", 'bins' AS kind, i::INT AS bin, round(l, 4) AS "left", round(r, 4) AS "right",
  round((l + r) / 2, 4) AS center, count(v)::BIGINT AS "count"
FROM e LEFT JOIN t ON v >= l AND (v < r OR (closed AND v <= r)) GROUP BY i, l, r""" for c in ("l_extendedprice", "l_quantity"))


def _fences(c: str) -> str:
    return f"""
t AS (SELECT event_id, {c}::DOUBLE AS v FROM events WHERE {c} IS NOT NULL),
s AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3, avg(v) AS mean,
  stddev_samp(v) AS sd FROM t),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s),
x AS (SELECT *, v < lo OR v > hi AS iqr, sd > 0 AND abs(v - mean) / sd > 3 AS z FROM t, f)"""


BOX_STATS = union(f"""WITH {_fences(c)}
SELECT '{c}' AS "column", round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3,
  round(any_value(mean), 4) AS mean, round(min(v) FILTER (NOT iqr), 4) AS lowerfence,
  round(max(v) FILTER (NOT iqr), 4) AS upperfence, count(*) FILTER (iqr)::BIGINT AS outlier_count FROM x""" for c in ("value", "user_id"))

OUTLIER_TABLE = union(f"""WITH {_fences(c)}
SELECT '{c}' AS "column", count(*)::BIGINT AS "count", round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound,
  count(*) FILTER (iqr)::BIGINT AS iqr_count, round(count(*) FILTER (iqr) / count(*) * 100, 4) AS iqr_pct,
  count(*) FILTER (z)::BIGINT AS z_count, round(count(*) FILTER (z) / count(*) * 100, 4) AS z_pct,
  count(*) FILTER (iqr AND z)::BIGINT AS both_count FROM x""" for c in ("value", "user_id"))

OUTLIER_EXTREMES = f"""WITH {_fences('value')}
SELECT 'value' AS "column", (row_number() OVER (ORDER BY abs(v - med) DESC, event_id))::INT AS position, event_id AS "row", v AS value
FROM x WHERE iqr OR z QUALIFY position <= 5"""

_PART_LABELS = union(f"""SELECT '{c}' AS "column", {c}::VARCHAR AS label, count(*) AS n FROM part GROUP BY 2"""
                     for c in ("p_name", "p_brand", "p_size"))
VALUE_COUNTS = f'SELECT "column", label, n::BIGINT AS n FROM ({_PART_LABELS})'

CATEGORY_BARS = f"""
WITH c AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, count(*) OVER (PARTITION BY "column") AS levels,
  row_number() OVER (PARTITION BY "column" ORDER BY n DESC, label) AS nth FROM ({_PART_LABELS}))
SELECT "column", least(nth, 16)::INT AS position, CASE WHEN nth <= 15 THEN label ELSE 'Other (' || (levels - 15)::VARCHAR || ' more)' END AS label,
  sum(n)::BIGINT AS "count", round(sum(n) / total * 100, 4) AS percent
FROM c GROUP BY 1, 2, 3, total"""

CATEGORY_SUMMARY = f"WITH src AS ({EVENTS_GAPS}) " + union(f"""
SELECT '{c}' AS "column", sum(n)::BIGINT AS total, (SELECT count(*) - count({c}) FROM src)::BIGINT AS missing,
  count(*)::BIGINT AS "unique", first(label ORDER BY n DESC, label) AS mode, round(max(n) / sum(n) * 100, 4) AS mode_pct,
  first(label ORDER BY n, label DESC) AS rarest, min(n)::BIGINT AS rarest_count,
  (count(*) > 1 AND max(n) / sum(n) > 0.8) AS imbalanced, (count(*) BETWEEN 2 AND 8) AS allow_pie
FROM (SELECT {c}::VARCHAR AS label, count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY 1)""" for c in ("event_type", "user_id"))

TOP_N_OTHER = """
WITH c AS (SELECT p_name AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS nth FROM part GROUP BY 1)
SELECT CASE WHEN nth <= 10 THEN label ELSE 'Other' END AS label, (least(nth, 11) - 1)::INT AS position, sum(n)::BIGINT AS n
FROM c GROUP BY 1, 2"""

# --- quality -----------------------------------------------------------------------------

_ALL = ", ".join(ORDER_COLUMNS)
_MARKED = f"SELECT *, row_number() OVER (PARTITION BY {_ALL} ORDER BY _row) > 1 AS again FROM ({ORDERS_REPEATED})"

QUALITY_OVERVIEW = f"""
WITH m AS ({_MARKED})
SELECT count(*)::BIGINT AS rows, 6::INT AS columns, (count(*) * 6)::BIGINT AS total_cells, 0::BIGINT AS missing_cells,
  0.0::DOUBLE AS missing_pct, 100.0::DOUBLE AS completeness_pct, 'ok' AS verdict, 0::INT AS columns_with_missing,
  count(*) FILTER (again)::BIGINT AS duplicate_rows, round(count(*) FILTER (again) / count(*) * 100, 6) AS duplicate_pct,
  (SELECT string_agg(_row::VARCHAR, ',' ORDER BY _row) FROM (SELECT _row FROM m WHERE again ORDER BY _row LIMIT 10)) AS duplicate_examples,
  0::BIGINT AS invalid_cells FROM m"""

DUPLICATE_ROWS = f"SELECT _row FROM ({_MARKED}) WHERE again ORDER BY _row LIMIT 10"
DEDUPE_ROWS = f"""
SELECT _row, o_orderkey::DOUBLE AS o_orderkey, o_custkey::DOUBLE AS o_custkey, o_orderstatus, o_totalprice,
  o_orderdate::TIMESTAMP AS o_orderdate, o_orderpriority FROM ({_MARKED}) WHERE NOT again"""
REPEATED_IDS = f"""
SELECT 'warning' AS level, 'order_id' AS "column",
  (count(*) - count(DISTINCT o_orderkey))::VARCHAR || ' repeated value(s) in an ID column; IDs are usually unique.' AS text
FROM ({ORDERS_REPEATED})"""

QUALITY_COLUMNS = f"""
SELECT p.position::INT AS position, s.name, s.type, s.missing, s.missing_pct, s.invalid,
  CASE s.name WHEN 'price' THEN 'absent' ELSE '' END AS invalid_examples
FROM ({SCHEMA_PROFILE}) s JOIN (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(TEXT_COLUMNS))}) p(name, position) ON p.name = s.name"""

QUALITY_ISSUES = f"""
WITH src AS ({ORDERS_AS_TEXT})
SELECT 'warning' AS level, 'price' AS "column",
  count(*)::VARCHAR || ' value(s) could not be read as numbers (e.g. "absent"). They are treated as missing.' AS text
FROM src WHERE price = 'absent'
UNION ALL
SELECT 'warning', 'priority', 'Same value written with different capitalisation: ' || string_agg('"' || v || '"', ', ' ORDER BY v) || '.'
FROM (SELECT DISTINCT priority AS v FROM src) GROUP BY lower(v) HAVING count(*) > 1"""

# --- relationships -----------------------------------------------------------------------

_VARYING = [c for c in RELATED if c != "fixed"]
_PAIRS = list(itertools.combinations(_VARYING, 2))


def _matrix(pairs_sql: str) -> str:
    return f"""
WITH p AS ({pairs_sql})
SELECT a, b, round_even(r, 4) AS r FROM p UNION ALL SELECT b, a, round_even(r, 4) FROM p
UNION ALL SELECT unnest({_VARYING}), unnest({_VARYING}), 1.0::DOUBLE"""


def _pearson(source: str) -> str:
    return union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM ({source}) "
                 f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS)


def _spearman(source: str) -> str:
    def rank(c: str) -> str:
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return union(f"SELECT '{a}' AS a, '{b}' AS b, corr(x, y) AS r FROM (SELECT {rank(a)} AS x, {rank(b)} AS y "
                 f"FROM ({source}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in _PAIRS)


_STRENGTH = """CASE WHEN abs(r) >= 0.7 THEN 'strong ' || d WHEN abs(r) >= 0.4 THEN 'moderate ' || d
  WHEN abs(r) >= 0.2 THEN 'weak ' || d ELSE 'very weak / none' END"""
CORR_PAIRS = f"""
SELECT a, b, round(r, 6) AS r, n::BIGINT AS n, {_STRENGTH} AS strength
FROM (SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS d FROM ({_pearson(RELATED_GAPS)}))
ORDER BY abs(r) DESC LIMIT 30"""

SCATTER_FIT = f"""
SELECT 'qty' AS x, 'net' AS y, n::BIGINT AS n, round_even(r, 4) AS pearson, round_even(rho, 4) AS spearman,
  round_even(r * r, 4) AS r_squared, round(k, 4) AS slope, round(c, 4) AS intercept, {_STRENGTH} AS strength,
  x0 AS trend_x0, x1 AS trend_x1, round(k * x0 + c, 4) AS trend_y0, round(k * x1 + c, 4) AS trend_y1
FROM (SELECT count(*) AS n, corr(qty, net) AS r, corr(rx, ry) AS rho, regr_slope(net, qty) AS k,
    regr_intercept(net, qty) AS c, min(qty) AS x0, max(qty) AS x1,
    CASE WHEN corr(qty, net) > 0 THEN 'positive' ELSE 'negative' END AS d
  FROM (SELECT *, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 AS rx,
    rank() OVER (ORDER BY net) + (count(*) OVER (PARTITION BY net) - 1) / 2.0 AS ry FROM ({RELATED_SQL})))"""

AGG = {"mean": "avg(v)", "sum": "sum(v)", "median": "quantile_cont(v, 0.5)", "min": "min(v)", "max": "max(v)",
       "count": "count(*)::DOUBLE"}


def _labels(source: str, columns: dict[str, int]) -> str:
    """CTEs: src, and per column c the table t_c (v, label, position) of top labels and Other."""
    parts = [f"src AS ({source})"]
    for c, n in columns.items():
        parts.append(f"""t_{c} AS (SELECT v, CASE WHEN nth <= {n} THEN v ELSE 'Other' END AS label, (least(nth, {n} + 1) - 1)::INT AS position
  FROM (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) AS nth FROM src GROUP BY 1))""")
        parts.append(f"l_{c} AS (SELECT DISTINCT label, position FROM t_{c})")
    return "WITH " + ", ".join(parts)


def _pivot1(source: str, agg: str) -> str:
    n = "count(*)" if agg == "count" else "count(v)"
    value = "coalesce(sum(s.v), 0)" if agg == "sum" else AGG[agg].replace("v", "s.v") if agg != "count" else AGG[agg]
    value = {"mean": "avg(s.v)", "median": "quantile_cont(s.v, 0.5)"}.get(agg, value)
    return f"""{_labels(source, {"r": 20})}
SELECT t_r.label AS "row", t_r.position AS row_position, round_even({value}, 4) AS value, {n.replace('(v', '(s.v')}::BIGINT AS "count"
FROM src s JOIN t_r ON s.r = t_r.v GROUP BY 1, 2"""


def _pivot2(source: str, value: str, count: str) -> str:
    return f"""{_labels(source, {"r": 20, "c": 10})},
g AS (SELECT t_r.label AS rl, t_c.label AS cl, {value} AS m, {count} AS n FROM src s JOIN t_r ON s.r = t_r.v JOIN t_c ON s.c = t_c.v GROUP BY 1, 2)
SELECT l_r.label AS "row", l_r.position AS row_position, l_c.label AS col, l_c.position AS col_position,
  round_even(m, 4) AS value, coalesce(n, 0)::BIGINT AS "count"
FROM l_r CROSS JOIN l_c LEFT JOIN g ON rl = l_r.label AND cl = l_c.label"""


_ORDERS_RC = "SELECT o_orderpriority AS r, o_orderstatus AS c, o_totalprice AS v FROM orders"
_PART_RC = "SELECT p_name AS r, p_brand AS c FROM part"


def _cells(source: str) -> str:
    return f"""{_labels(source, {"r": 15, "c": 12})},
g AS (SELECT t_r.label AS rl, t_c.label AS cl, count(*) AS n FROM src s JOIN t_r ON s.r = t_r.v JOIN t_c ON s.c = t_c.v GROUP BY 1, 2),
x AS (SELECT l_r.label AS a, l_r.position AS a_position, l_c.label AS b, l_c.position AS b_position, coalesce(n, 0) AS n
  FROM l_r CROSS JOIN l_c LEFT JOIN g ON rl = l_r.label AND cl = l_c.label),
cells AS (SELECT *, sum(n) OVER (PARTITION BY a) AS rt, sum(n) OVER (PARTITION BY b) AS ct, sum(n) OVER () AS total FROM x)"""


def _crosstab(source: str) -> str:
    return _cells(source) + """
SELECT a, a_position, b, b_position, n::BIGINT AS "count", rt::BIGINT AS row_total, ct::BIGINT AS col_total,
  round_even(n / greatest(rt, 1) * 100, 2) AS row_pct FROM cells"""


def _chi2(source: str, a: str, b: str) -> str:
    """The degrees of freedom of both inputs are even, so the tail is a finite sum."""
    return _cells(source) + f""",
s AS (SELECT max(total) AS n, sum(CASE WHEN rt * ct > 0 THEN pow(n - rt * ct / total, 2) / (rt * ct / total) END) AS chi2,
  (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS k,
  avg((rt * ct / total < 5)::INT) * 100 AS low FROM cells),
p AS (SELECT *, sqrt(chi2 / (n * k)) AS v,
  (SELECT sum(exp(i * ln(chi2 / 2) - lgamma(i + 1) - chi2 / 2)) FROM range(0, 200) g(i) WHERE i < dof / 2) AS p FROM s)
SELECT '{a}' AS a, '{b}' AS b, n::BIGINT AS n, round(chi2, 5) AS chi2, dof::INT AS dof, round(p, 5) AS p_value,
  round(v, 5) AS cramers_v, round(low, 5) AS low_expected_pct,
  CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'weak' WHEN v < 0.5 THEN 'moderate' ELSE 'strong' END AS association,
  CASE WHEN p < 0.05 THEN 'p < 0.05: the distribution of {b} differs across {a} groups more than chance alone would explain.'
    ELSE 'p ≥ 0.05: no evidence that {a} and {b} are related in this data.' END AS verdict,
  low > 20 AS low_expected_warning FROM p"""


# --- time series -------------------------------------------------------------------------

UNITS = {"D": ("day", "1 DAY", 7), "W": ("week", "7 DAY", 4), "M": ("month", "1 MONTH", 3),
         "Q": ("quarter", "3 MONTH", 4), "Y": ("year", "1 YEAR", 3)}
_ORDERS_DV = "SELECT o_orderdate AS d, o_totalprice AS v FROM orders"
_EVENTS_DV = "SELECT ts AS d, value AS v FROM events"
_GAPPY = f"SELECT ts AS d, value AS v FROM ({EVENTS_GAPS}) WHERE ts IS NULL OR day(ts) % 2 = 0"
_GAPPY_ALL = f"SELECT ts AS d, 1.0 AS v FROM ({EVENTS_GAPS}) WHERE ts IS NULL OR day(ts) % 2 = 0"


def _periods(source: str, freq: str, agg: str) -> str:
    """CTEs ending in s (period, value, n): every period, empty ones included."""
    unit, step, _ = UNITS[freq]
    value = "coalesce(value, 0)" if agg == "count" else "value"
    return f"""src AS ({source}),
g AS (SELECT date_trunc('{unit}', d)::DATE AS period, {AGG[agg]} AS value, count(*) AS n FROM src WHERE d IS NOT NULL AND v IS NOT NULL GROUP BY 1),
sp AS (SELECT unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL {step}))::DATE AS period FROM g),
s AS (SELECT period, {value} AS value, coalesce(n, 0) AS n FROM sp LEFT JOIN g USING (period))"""


def _points(source: str, freq: str, agg: str, digits: int = 5) -> str:
    w = UNITS[freq][2] - 1
    return f"""WITH {_periods(source, freq, agg)}
SELECT period, round(value, {digits}) AS value,
  round(avg(value) OVER (ORDER BY period ROWS BETWEEN {w} PRECEDING AND CURRENT ROW), {digits}) AS ma, n::BIGINT AS "count" FROM s"""


def _trend() -> str:
    """Columns of the trend from the present periods ``v``."""
    return """
t AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS nth FROM s WHERE value IS NOT NULL),
k AS (SELECT regr_slope(value, nth) AS slope, count(*) AS n, avg(value) AS mean, first(value ORDER BY period) AS fv,
  last(value ORDER BY period) AS lv, first(period ORDER BY value DESC, period) AS peak, max(value) AS pv,
  first(period ORDER BY value, period) AS low, min(value) AS lov FROM t),
z AS (SELECT *, slope * (n - 1) / abs(mean) * 100 AS rel FROM k)"""


_TREND_COLUMNS = """CASE WHEN abs(rel) < 5 THEN 'roughly flat' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend,
  round(slope, {0}) AS trend_slope_per_period, round(rel, {0}) AS trend_change_pct_of_mean, round(fv, {0}) AS first_value,
  round(lv, {0}) AS last_value, round((lv - fv) / abs(fv) * 100, {0}) AS first_to_last_pct"""

TS_TREND = f"WITH {_periods(_ORDERS_DV, 'M', 'sum')}, {_trend()} SELECT {_TREND_COLUMNS.format(2)} FROM z"
TS_SUMMARY = f"""WITH {_periods(_GAPPY, 'D', 'sum')}, {_trend()},
u AS (SELECT min(d) AS d0, max(d) AS d1, count(*) AS used FROM src WHERE d IS NOT NULL AND v IS NOT NULL)
SELECT (SELECT count(*) FROM s)::BIGINT AS periods, z.n::BIGINT AS periods_with_data,
  (SELECT count(*) FROM s WHERE n = 0)::BIGINT AS empty_periods, d0 AS "start", d1 AS "end",
  floor(epoch(d1 - d0) / 86400)::INT AS span_days, used::BIGINT AS records_used,
  (SELECT count(*) FROM src WHERE d IS NULL)::BIGINT AS missing_dates,
  (SELECT count(*) FROM src WHERE d IS NOT NULL AND v IS NULL)::BIGINT AS missing_values,
  peak AS peak_period, round(pv, 4) AS peak_value, low AS low_period, round(lov, 4) AS low_value, round(mean, 4) AS average,
  {_TREND_COLUMNS.format(4)} FROM z, u"""


def _anomalies(source: str, freq: str, agg: str, digits: int) -> str:
    w = UNITS[freq][2]
    return f"""WITH {_periods(source, freq, agg)},
b AS (SELECT period, value, count(*) OVER () AS total, CASE WHEN count(*) OVER w >= 3 THEN median(value) OVER w END AS expected
  FROM s WHERE value IS NOT NULL WINDOW w AS (ORDER BY period ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING)),
r AS (SELECT *, value - expected AS res FROM b WHERE total >= 8),
m AS (SELECT *, res - (SELECT median(res) FROM r) AS off FROM r),
q AS (SELECT (SELECT median(abs(off)) FROM m) AS mad, (SELECT avg(res) FROM r) AS mean, (SELECT stddev_samp(res) FROM r) AS sd)
SELECT period, round(value, {digits}) AS value, round(expected, {digits}) AS expected, CASE WHEN res > 0 THEN 'above' ELSE 'below' END AS direction
FROM m, q WHERE CASE WHEN mad > 0 THEN abs(0.6745 * off / mad) > 3.5 WHEN sd > 0 THEN abs((res - mean) / sd) > 3 ELSE false END
ORDER BY period"""


_SPIKES = """SELECT ts AS d, CASE WHEN day(ts) = 9 THEN value * 40 WHEN day(ts) = 17 THEN -value * 30 ELSE value END AS v FROM events"""
_FLAT = "SELECT ts AS d, CASE WHEN day(ts) = 9 THEN 7.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM events"
_FAR = "SELECT o_orderdate + (o_orderkey % 41 * 365)::INT * INTERVAL 1 DAY AS d, o_totalprice AS v FROM orders"


def _season(body: str, label: str, digits: int = 6) -> str:
    return f"""{body}
SELECT position::INT AS position, {label} AS label, round(value, {digits}) AS value,
  position = first_value(position) OVER (ORDER BY value DESC, position) AS peak FROM z"""


_MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"
_DAYS = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']"
TS_SEASON_MONTH = _season(
    f"WITH {_periods(_ORDERS_DV, 'M', 'sum')}, z AS (SELECT month(period) - 1 AS position, avg(value) AS value FROM s GROUP BY 1)",
    f"{_MONTHS}[position + 1]", 5)
TS_SEASON_WEEKDAY = _season(
    f"WITH {_periods(_ORDERS_DV, 'D', 'count')}, z AS (SELECT isodow(period) - 1 AS position, avg(value) AS value FROM s GROUP BY 1)",
    f"{_DAYS}[position + 1]")


def _season_hour(agg: str) -> str:
    return _season(f"WITH z AS (SELECT hour(d) AS position, {AGG[agg]} AS value FROM ({_EVENTS_DV}) GROUP BY 1)",
                   "lpad(position::VARCHAR, 2, '0') || ':00'")


# --- comparison and report ---------------------------------------------------------------

def _compare_schema() -> str:
    """Types recomputed from the data; only the listed columns can differ between the sides."""
    def kind(c: str, source: str, text: bool) -> str:
        if text:
            return (f"(SELECT CASE WHEN count(*) > 20 AND count(DISTINCT {c}) > 0.95 * count(*) THEN 'identifier' "
                    f"WHEN count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) > 0.5 * count(*) THEN 'text' "
                    f"ELSE 'categorical' END FROM ({source}))")
        named = "true" if c.endswith("_key") else "false"
        return f"(SELECT CASE WHEN {named} AND count(DISTINCT {c}) > 0.9 * count(*) THEN 'identifier' ELSE 'numeric' END FROM ({source}))"
    rows = [
        ("o_orderkey", None, None), ("o_custkey", kind("o_custkey", EARLY, False), kind("o_custkey", LATE, True)),
        ("o_orderstatus", kind("o_orderstatus", EARLY, True), kind("o_orderstatus", LATE, True)),
        ("o_totalprice", "'numeric'", "'numeric'"), ("o_orderdate", "'datetime'", "NULL"), ("ordered", "NULL", "'datetime'"),
        ("o_orderpriority", kind("o_orderpriority", EARLY, True), kind("o_orderpriority", LATE, True))]
    body = union(f"SELECT '{n}' AS name, {a or _KEY_KIND} AS type_a, {b or _KEY_KIND} AS type_b" for n, a, b in rows)
    return f"""SELECT name, CASE WHEN type_b IS NULL THEN 'only_a' WHEN type_a IS NULL THEN 'only_b'
  WHEN type_a <> type_b THEN 'type_mismatch' ELSE 'common' END AS status, type_a, type_b FROM ({body})"""


# "o_orderkey" has no separator before "key", so only consecutive numbers would make it an identifier
_KEY_KIND = "'numeric'"

COMPARE_NUMERIC = union(f"""
SELECT '{c}' AS "column", round(a.mean, 4) AS mean_a, round(a.med, 4) AS median_a, round(a.sd, 4) AS std_a, 0.0::DOUBLE AS missing_pct_a,
  round(b.mean, 4) AS mean_b, round(b.med, 4) AS median_b, round(b.sd, 4) AS std_b, 0.0::DOUBLE AS missing_pct_b,
  round((b.mean - a.mean) / abs(a.mean) * 100, 4) AS mean_change_pct
FROM (SELECT avg({c}) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS med, stddev_samp({c}) AS sd FROM ({EARLY})) a,
  (SELECT avg({c}) AS mean, quantile_cont({c}::DOUBLE, 0.5) AS med, stddev_samp({c}) AS sd FROM ({LATE})) b"""
    for c in ("o_orderkey", "o_totalprice"))


def _compare_categorical(c: str) -> str:
    def side(source: str) -> str:
        return (f"(SELECT count(*) AS u, first(v ORDER BY n DESC, v) AS top, max(n) / sum(n) * 100 AS pct "
                f"FROM (SELECT {c} AS v, count(*) AS n FROM ({source}) GROUP BY 1))")

    def gone(x: str, y: str) -> str:
        return f"(SELECT DISTINCT {c} AS v FROM ({x}) EXCEPT SELECT DISTINCT {c} FROM ({y}))"
    new, old = gone(LATE, EARLY), gone(EARLY, LATE)
    return f"""
SELECT '{c}' AS "column", a.u::BIGINT AS unique_a, a.top AS top_a, round(a.pct, 6) AS top_a_pct,
  b.u::BIGINT AS unique_b, b.top AS top_b, round(b.pct, 6) AS top_b_pct,
  (SELECT count(*) FROM {new})::BIGINT AS new_count,
  coalesce((SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT v FROM {new} ORDER BY v LIMIT 8)), '') AS new_in_b,
  (SELECT count(*) FROM {old})::BIGINT AS missing_count,
  coalesce((SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT v FROM {old} ORDER BY v LIMIT 8)), '') AS missing_in_b
FROM {side(EARLY)} a, {side(LATE)} b"""


_BRANDS = """SELECT p_size <= 25 AS low, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_size <= 25 THEN 'small ' || p_brand
  ELSE 'large ' || p_brand END AS label FROM part"""
COMPARE_LABELS = f"""
SELECT 'brand' AS "column", label, CASE WHEN bool_and(low) THEN 'a' ELSE 'b' END AS side
FROM ({_BRANDS}) GROUP BY label HAVING bool_and(low) OR NOT bool_or(low)"""

COMPARE_OVERVIEW = union(f"""
SELECT '{s}' AS side, '{name}' AS name, count(*)::BIGINT AS rows, 6::INT AS columns, 0.0::DOUBLE AS missing_pct,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({src}))))::BIGINT AS duplicates FROM ({src})"""
    for s, name, src in (("a", "early", EARLY), ("b", "late", LATE)))

REPORT_DEFAULTS = """
SELECT analysis, argument, value FROM (VALUES
  ('timeseries', 'date', 'o_orderdate'), ('timeseries', 'value', 'o_totalprice'), ('timeseries', 'agg', 'sum'),
  ('pivot', 'rows', 'o_orderstatus'), ('pivot', 'values', 'o_custkey'), ('pivot', 'agg', 'mean'),
  ('crosstab', 'a', 'o_orderstatus'), ('crosstab', 'b', 'o_orderpriority'),
  ('scatter_matrix', 'column_1', 'o_custkey'), ('scatter_matrix', 'column_2', 'o_totalprice')) t(analysis, argument, value)"""

BOX_OUTLIERS = f"""WITH {_fences('value')}
SELECT 'value' AS "column", event_id, v AS value FROM x WHERE iqr"""

QUANTILES_WIDE = """
SELECT event_type, count(*)::BIGINT AS n, """ + ", ".join(
    f"round(ln(quantile_cont(v, {p})), 6) AS {c}" for p, c in ((0.01, "p1"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.99, "p99"))) + """
FROM (SELECT event_type, exp((event_id * 7919 % 7001) / 10.0) * 1e-290 AS v FROM events) GROUP BY event_type"""


def _drawn(source: str, keys: list[str], limit: int, shown: str) -> str:
    """The bottom rows of ``source`` by the hash of their keys, with the extent of the sample."""
    told = " || '|' || ".join(f"{k}::VARCHAR" for k in keys)
    return f"""
WITH src AS ({source}), size AS (SELECT count(*)::BIGINT AS n FROM src)
SELECT {shown}, n, least(n, {limit})::BIGINT AS shown, n > {limit} AS sampled
FROM (SELECT * FROM src ORDER BY md5('42|' || {told}), {", ".join(keys)} LIMIT {limit}), size"""


_LINE_KEYS = ["l_orderkey", "l_linenumber"]
SCATTER_POINTS = _drawn(
    "SELECT * FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL", _LINE_KEYS, 4000,
    """'Rows' AS "group", l_quantity AS x, l_extendedprice AS y""")
SCATTER_COLORED = _drawn(
    f"SELECT * FROM ({EVENTS_GAPS}) WHERE user_id IS NOT NULL AND value IS NOT NULL", ["event_id"], 4000,
    """coalesce(event_type, '(missing)') AS "group", user_id::DOUBLE AS x, value AS y""")
SCATTER_MATRIX = _drawn("SELECT * FROM lineitem", _LINE_KEYS, 1500, ", ".join(MEASURES[:3]))
BOX_POINTS = f"""WITH {_fences('value')},
o AS (SELECT event_id, v FROM x WHERE iqr), size AS (SELECT count(*)::BIGINT AS n FROM o),
e AS ((SELECT * FROM o ORDER BY v, event_id LIMIT 5) UNION (SELECT * FROM o ORDER BY v DESC, event_id LIMIT 5)),
r AS (SELECT * FROM o WHERE event_id NOT IN (SELECT event_id FROM e) ORDER BY md5('42|' || event_id::VARCHAR), event_id LIMIT 290)
SELECT 'value' AS "column", event_id, v AS value, n, least(n, 300)::BIGINT AS shown, n > 300 AS sampled
FROM (SELECT * FROM e UNION ALL SELECT * FROM r), size"""

SCATTER_ALL = f"""
SELECT coalesce(event_type, '(missing)') AS "group", count(*)::BIGINT AS n, round(sum(user_id)::DOUBLE, 2) AS sum_x, round(sum(value), 2) AS sum_y
FROM ({EVENTS_GAPS}) WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1"""
MATRIX_ALL = f"""
SELECT count(*)::BIGINT AS n, round(sum(qty), 1) AS qty, round(sum(net), 1) AS net, round(sum(falling), 1) AS falling
FROM ({RELATED_GAPS}) WHERE qty IS NOT NULL AND net IS NOT NULL AND falling IS NOT NULL"""

SECTION_FLAGS = """
SELECT section, available FROM (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders),
  (VALUES ('statistics', true), ('distributions', true), ('categories', s > 0), ('correlation', true),
    ('multivariate', true), ('crosstab', s > 0 AND p > 0), ('timeseries', true), ('outliers', true)) t(section, available)"""

CHART_PLAN = """
SELECT c AS "column", k AS chart FROM (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders),
  (VALUES ('o_custkey', 'histogram', 0), ('o_custkey', 'box', 0), ('o_totalprice', 'histogram', 0), ('o_totalprice', 'box', 0),
    ('o_orderstatus', 'bar', 0), ('o_orderpriority', 'bar', 0), ('o_orderstatus', 'pie', s), ('o_orderpriority', 'pie', p),
    ('o_orderdate', 'line', 0), ('o_custkey', 'heatmap', 0), ('o_totalprice', 'heatmap', 0)) t(c, k, levels)
WHERE k <> 'pie' OR levels BETWEEN 2 AND 8"""


def _findings_orders() -> str:
    """The sentences about orders: no gaps, no copies, weak correlation, a monthly series."""
    odd = _anomalies(_ORDERS_DV, "M", "sum", 2)
    short = "CASE WHEN abs({0}) >= 1000 THEN format('{{:,.0f}}', {0}) ELSE format('{{:,.2f}}', {0}) END"
    series = f"""(WITH {_periods(_ORDERS_DV, 'M', 'sum')}, {_trend()},
m AS (SELECT month(period) AS position, avg(value) AS value FROM s GROUP BY 1 ORDER BY value DESC, position LIMIT 1),
a AS (SELECT count(*) AS odd FROM ({odd}))
SELECT 'Monthly total of o_totalprice over o_orderdate is ' ||
  CASE WHEN abs(rel) < 5 THEN 'roughly flat' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END ||
  ' from ' || (SELECT strftime(min(d), '%Y-%m-%d') || ' to ' || strftime(max(d), '%Y-%m-%d') FROM src) ||
  '. The highest period begins ' || strftime(peak, '%Y-%m-%d') || ' (' || {short.format('pv')} || ').' ||
  ' On average, ' || {_MONTHS}[m.position] || ' is the highest calendar month.' ||
  CASE WHEN odd > 0 THEN ' ' || odd::VARCHAR || ' period(s) stand out from the surrounding trend.' ELSE '' END FROM z, m, a)"""
    pair = """(SELECT 'No strong linear relationships were found; the largest is o_custkey and o_totalprice (r = ' ||
  format('{:.3f}', corr(o_custkey, o_totalprice)) || ').' FROM orders)"""
    overview = """(SELECT format('{:,}', count(*)) || ' rows and 6 columns were analysed: 2 numeric, 2 categorical, 1 date/time, 1 ID.' FROM orders)"""
    rows = [
        ("Overview", "info", overview), ("Data quality", "good", "'No missing values were found.'"),
        ("Data quality", "good", "'No duplicate rows were found.'"), ("Relationships", "info", pair),
        ("Outliers", "good", "'No values fall outside the IQR fences in any numeric column.'"),
        ("Time series", "info", series),
        ("Columns", "info", "'Treated as identifiers and left out of statistics: o_orderkey.'")]
    return union(f"SELECT {i}::INT AS seq, '{area}' AS area, '{level}' AS level, {text} AS text"
                 for i, (area, level, text) in enumerate(rows, 1))


PARQUET_ROWS = """
SELECT (file_row_number + 1)::BIGINT AS _row, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
FROM (SELECT *, row_number() OVER () - 1 AS file_row_number FROM orders)"""

ORACLES: dict[str, str] = {
    "parquet_rows": PARQUET_ROWS, "csv_rows": CSV_ROWS, "csv_profile": _csv_profile(), "csv_load_report": CSV_LOAD_REPORT,
    "csv_cleaned": CSV_CLEANED, "preview50": PREVIEW,
    "schema_profile": SCHEMA_PROFILE, "schema_examples": _schema_examples(), "type_counts": TYPE_COUNTS,
    "numeric_parse": NUMERIC_PARSE, "date_parse": DATE_PARSE, "date_vote": _date_vote(),
    "identifier_flags": _identifier_flags(), "text_kinds": _text_kinds(), "case_variants": CASE_VARIANTS,
    "abbreviations": ABBREVIATIONS, "sample_values": SAMPLE_VALUES,
    "describe_lineitem": describe("SELECT * FROM lineitem", MEASURES),
    "describe_events_gaps": describe(EVENTS_GAPS, ["value", "user_id"]),
    "report_statistics": describe("SELECT * FROM orders", ["o_custkey", "o_totalprice"], words=False),
    "hist_discrete": HIST_DISCRETE, "hist_binned": HIST_BINNED, "box_stats": BOX_STATS,
    "outlier_table": OUTLIER_TABLE, "outlier_extremes": OUTLIER_EXTREMES, "value_counts": VALUE_COUNTS,
    "category_bars": CATEGORY_BARS, "category_summary": CATEGORY_SUMMARY, "top_n_other": TOP_N_OTHER,
    "quality_overview": QUALITY_OVERVIEW, "quality_columns": QUALITY_COLUMNS, "quality_issues": QUALITY_ISSUES,
    "duplicate_rows": DUPLICATE_ROWS, "repeated_ids": REPEATED_IDS, "dedupe_rows": DEDUPE_ROWS,
    "corr_pearson": _matrix(_pearson(RELATED_SQL)), "corr_pearson_gaps": _matrix(_pearson(RELATED_GAPS)),
    "corr_spearman": _matrix(_spearman(RELATED_SQL)), "corr_spearman_gaps": _matrix(_spearman(RELATED_GAPS)),
    "corr_pairs": CORR_PAIRS, "scatter_fit": SCATTER_FIT,
    "pivot_2way": _pivot2(_ORDERS_RC, "avg(s.v)", "count(s.v)"),
    "pivot_2way_median": _pivot2(_ORDERS_RC, "quantile_cont(s.v, 0.5)", "count(s.v)"),
    "pivot_2way_other": _pivot2(_PART_RC, "count(*)::DOUBLE", "count(*)"),
    "pivot_missing_label": _pivot1(
        f"SELECT coalesce(event_type, '(missing)') AS r, CASE WHEN event_type IS NOT NULL THEN value END AS v FROM ({EVENTS_GAPS})", "sum"),
    "crosstab_counts": _crosstab(_ORDERS_RC), "crosstab_other": _crosstab(_PART_RC),
    "crosstab_chi2": _chi2(_ORDERS_RC, "o_orderpriority", "o_orderstatus"),
    "crosstab_chi2_other": _chi2(_PART_RC, "p_name", "p_brand"),
    "ts_gaps": _points(_GAPPY, "D", "sum"), "ts_gaps_count": _points(_GAPPY_ALL, "D", "count", 6),
    "ts_summary": TS_SUMMARY, "ts_trend": TS_TREND,
    "ts_anomalies": _anomalies(_ORDERS_DV, "W", "sum", 2), "ts_anomalies_daily": _anomalies(_EVENTS_DV, "D", "mean", 5),
    "ts_season_month": TS_SEASON_MONTH, "ts_season_weekday": TS_SEASON_WEEKDAY,
    "ts_season_hour": _season_hour("mean"), "ts_season_hour_median": _season_hour("median"),
    "compare_schema": _compare_schema(), "compare_numeric": COMPARE_NUMERIC,
    "compare_categorical": union(map(_compare_categorical, ("o_orderstatus", "o_orderpriority"))),
    "csv_odd_headers": CSV_ODD_HEADERS, "csv_late_comma": CSV_LATE_COMMA, "csv_late_report": CSV_LATE_REPORT,
    "parquet_odd_names": PARQUET_ODD_NAMES, "compare_labels": COMPARE_LABELS,
    "ts_anomalies_spikes": _anomalies(_SPIKES, "D", "sum", 4), "ts_anomalies_flat": _anomalies(_FLAT, "D", "max", 4),
    "ts_long_daily": _points(_FAR, "D", "sum", 6),
    "quantiles_wide": QUANTILES_WIDE, "scatter_points": SCATTER_POINTS, "scatter_colored": SCATTER_COLORED,
    "scatter_matrix": SCATTER_MATRIX, "box_outlier_points": BOX_POINTS,
    "box_outliers_all": BOX_OUTLIERS, "scatter_all_colored": SCATTER_ALL, "scatter_matrix_all": MATRIX_ALL,
    "section_flags": SECTION_FLAGS, "chart_plan": CHART_PLAN, "findings_orders": _findings_orders(),
    "compare_overview": COMPARE_OVERVIEW, "report_defaults": REPORT_DEFAULTS,
}
ORACLES |= {f"pivot_{agg}": _pivot1(_ORDERS_RC, agg) for agg in AGG}
ORACLES |= {f"ts_{f.lower()}": _points(_ORDERS_DV, f, "sum") for f in UNITS}
ORACLES |= {"ts_auto": _points(_ORDERS_DV, "M", "sum")}
ORACLES |= {f"ts_m_{agg}": _points(_ORDERS_DV, "M", agg, 7 if agg == "mean" else 5) for agg in AGG if agg != "sum"}
