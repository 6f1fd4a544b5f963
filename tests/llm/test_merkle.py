from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from profila.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, place string, node string"


def digest(s):
    return sha256(s.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(nodes):
    """Root of ``nodes`` and, per node, its siblings level by level as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for m, p in enumerate(at):
            run, i = runs[p // 16], p % 16
            paths[m].append(("".join(run[:i]), "".join(run[i + 1 :])))
        at = [p // 16 for p in at]
        nodes = [digest("".join(run)) for run in runs]
    return nodes[0], paths


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: b"" if s is None else b"=" + s.encode())
    tops, own = [], []
    for s in order:
        held = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in held])
        tops.append(root)
        own.append((held, paths))
    root, above = climb(tops)
    out = []
    for (held, paths), up, sub in zip(own, above, tops):
        for row, path in zip(held, paths):
            now = list(row)
            if row[0] is not None and crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now[4] = "".join(c.lower() if c.isascii() else c for c in row[4])
            fold = leaf(now)
            for left, right in path + up:
                fold = digest(left + fold + right)
            proof = digest("".join(a + z for a, z in path + up))
            out.append((row[0], leaf(row), sub, root, proof, fold, fold == root))
    return sorted(out, key=str)


def query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.op11_manifest(spark, str(tmp_path)).collect()), key=str)


def test_equals_brute_force(spark, tmp_path):
    # sources of 1, 16, 17, 256, 257 and 700 rows; 19 sources, one of them null
    sizes = {None: 3, "b": 1, "a": 16, "é": 17, "Z": 256, "hot": 700, "": 257} | {f"s{i}": 2 for i in range(12)}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7919 % 100_003, source, None if n % 3 else "en", n, f"Text É {n}" if n % 11 else None, "x", "y", "z"))
            n += 1
    got = query(spark, rows, tmp_path)
    assert got == brute(rows)
    assert 0 < sum(not r[6] for r in got) < len(got) / 4


def test_edges(spark, tmp_path):
    rows = [(None, None, None, None, None, "k", "p", "n"), (None, "a", "en", 1, "Same", None, None, None),
            (5, "a", "en", 1, "Same", None, None, None), (5, "a", "en", 1, "Same", None, None, None),
            (5, "a", "en", 1, "other", None, None, None), (-3, "a", "en", 0, "", None, None, None),
            (9, "b", "x", 9, "WORD " * 300_000, None, None, None)]
    assert query(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(4, "only", "en", 1, "Text", None, None, None)]])
def test_few_rows(spark, tmp_path, rows):
    got = query(spark, rows, tmp_path)
    assert got == (brute(rows) if rows else [])


def test_appends_extend_partial_witnesses():
    tree = merkle.Subtrees(2)
    for i in range(15):
        tree.append(digest(str(i)))
    assert tree.witness[3] == []
    tree.append(digest("15"))
    assert len(tree.witness[3]) == 1 and tree.root is None
    tree.append(digest("16"))
    root, paths = climb([digest(str(i)) for i in range(17)])
    assert tree.end() == root and tree.witness == paths


def test_witnesses_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", 1, f"t{i}", "k", "p", "n") for i in range(60)], SCHEMA)
    for r in merkle.witnesses(docs).collect():
        node = r.leaf
        for step in r.path:
            node = digest(step["left"] + node + step["right"])
        assert node == r.root


def test_leaf_of_other_fields(spark):
    docs = spark.createDataFrame([(1, "é", None, 2, "t", "k", "p", "n")], SCHEMA)
    got = docs.select(merkle.leaf([F.col("source"), F.col("lang"), F.col("n_chars")])).first()[0]
    assert got == digest("2:é-1:2")
