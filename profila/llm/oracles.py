"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    fields = ["doc_id::varchar", "source", "lang", "n_chars::varchar", text]
    return "sha256(" + " || ".join(map(_field, fields)) + ")"


def _levels(nodes: str, made: str, levels: int) -> str:
    """CTEs of a 16-ary tree over ``nodes`` (k, p, d): ``made``0 .. levels, each (k, p, d, l, r, n)."""
    out = []
    for i in range(levels + 1):
        if i == 0:
            rows = f"SELECT k, p, d FROM {nodes}"
        else:
            rows = (f"SELECT k, p // 16 AS p, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d "
                    f"FROM {made}{i - 1} GROUP BY k, p // 16")
        run = "PARTITION BY k, p // 16 ORDER BY p ROWS BETWEEN"
        out.append(
            f"{made}{i} AS (SELECT k, p, d, count(*) OVER (PARTITION BY k) AS n, "
            f"coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({rows}))")
    return ",\n".join(out)


def _folded(made: str, levels: int, start: str) -> str:
    """The node that ``start`` leads to by the siblings of levels ``made``0 and up."""
    for i in range(levels):
        m = f"{made}{i}"
        start = f"CASE WHEN {m}.n = 1 THEN {start} ELSE sha256({m}.l || ({start}) || {m}.r) END"
    return start


def manifest(levels: int = 5, tops: int = 3) -> str:
    """Sources of up to 16 ** levels rows, up to 16 ** tops sources."""
    bits = ("list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
            "lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))")
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], "
           "list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::BIGINT)), "
           f"lambda c, b: {bits}), 4294967295)")
    joins = "".join(
        f" JOIN s{i} ON s{i}.k = leaves.k AND s{i}.p = leaves.p // {16 ** i}" for i in range(levels))
    joins += "".join(f" JOIN t{i} ON t{i}.p = tops.p // {16 ** i}" for i in range(tops))
    proof = " || ".join([f"s{i}.l || s{i}.r" for i in range(levels)] + [f"t{i}.l || t{i}.r" for i in range(tops)])
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_leaf("text")} AS d,
    CASE WHEN {crc} % 5 = 0 THEN {_leaf(LOW.format("text"))} ELSE {_leaf("text")} END AS c
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, d) - 1 AS p FROM docs),
{_levels("leaves", "s", levels)},
tops AS (SELECT '' AS k, k AS source, d, row_number() OVER (ORDER BY encode(k)) - 1 AS p FROM s{levels}),
{_levels("tops", "t", tops)},
whole AS (SELECT d AS root FROM t{tops}),
told AS (
  SELECT leaves.doc_id, leaves.d AS leaf, tops.d AS subroot, whole.root, sha256({proof}) AS proof_sha256,
    {_folded("t", tops, _folded("s", levels, "leaves.c"))} AS folded_root
  FROM leaves JOIN tops ON tops.source = leaves.k{joins} CROSS JOIN whole)
SELECT *, folded_root = root AS verified FROM told"""


SEARCH = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({LOW.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS t FROM documents),
sizes AS (SELECT doc_id, len(t) AS n, t FROM words WHERE len(t) > 0),
all_docs AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({LOW.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
  FROM benchmark),
tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sizes)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, all_docs GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), all_docs GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""

ORACLES: dict[str, str] = {"op11_manifest": manifest(), "op12_search": SEARCH}
