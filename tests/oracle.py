"""Run registered queries and their SQL twins side by side.

    python -m tests.oracle [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(v):
    if isinstance(v, float):
        v = 0.0 if v == 0 else v
        return "NaN" if math.isnan(v) else f"{v:.12g}"
    return str(v)


def _kind(name: str) -> str:
    n = name.lower()
    for kinds, words in (("int", ("bigint", "long", "int", "hugeint")), ("float", ("double", "float", "decimal")),
                         ("time", ("timestamp",)), ("date", ("date",)), ("bool", ("bool",)), ("str", ("varchar", "string"))):
        if any(n.startswith(w) or (kinds == "int" and n == w) for w in words):
            return kinds
    return n


def compare(spark, con, name: str, folder: str) -> list[str]:
    """Differences between the query and its SQL (empty: equal)."""
    df = queries()[name](spark, folder)
    rows = df.collect()
    sql = oracle_sql().get(name)
    if sql is None:
        return []
    rel = con.sql(sql)
    problems = []
    mine, theirs = sorted(df.columns), sorted(rel.columns)
    if mine != theirs:
        return [f"columns {mine} <> {theirs}"]
    spark_kinds = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    duck_kinds = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    problems += [f"type of {c}: {spark_kinds[c]} <> {duck_kinds[c]}" for c in mine
                 if spark_kinds[c] != duck_kinds[c] and "null" not in duck_kinds[c]]
    a = sorted(tuple(_key(r[c]) for c in mine) for r in rows)
    at = [rel.columns.index(c) for c in mine]
    b = sorted(tuple(_key(r[i]) for i in at) for r in rel.fetchall())
    if len(a) != len(b):
        problems.append(f"rows {len(a)} <> {len(b)}")
    for x, y in zip(a, b):
        if x != y:
            problems.append(f"\n   spark {dict(zip(mine, x))}\n   sql   {dict(zip(mine, y))}")
            if len(problems) > 3:
                break
    return problems


if __name__ == "__main__":
    from tests.conftest import make_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    session, con = make_session(), connect(folder)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            found = compare(session, con, name, folder)
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        mark = "FAIL" if found else "ok" if name in oracle_sql() else "rows"
        print(f"{mark:5} {name:24} {time.time() - start:6.2f}s", *found[:3], flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} fine")
