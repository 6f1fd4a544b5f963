import math
import random
import re
from collections import Counter

from profila.llm import lexical

SCHEMA = "doc_id long, text string, n string, terms string, item_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, items, k=10):
    docs = [(r[0], Counter(t)) for r in rows if (t := terms(r[1]))]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms(text))
    out = []
    for i, ts in wanted.items():
        found = []
        for doc_id, c in docs:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in ts if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(spark, rows, items, **options):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, bytes string")
    return sorted(map(tuple, lexical.search(docs, asked, **options).collect()), key=str)


def cases():
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "äpfel", "日本", "w1w2", "a"]
    rows = [(i, r.choice(" ,.-\n").join(r.choices(words, k=r.choice([1, 4, 40])))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "?! --"), (None, "w3 w4"), (7, "w3 w4"), (7, "w3 w4"), (903, "w5 " * 200_000),
             (904, "x" * 300_000), (905, "w1_w2"), (906, "W1W2")]
    items = [(i, " ".join(r.choices(words, k=6))) for i in range(12)] + [
        (50, None), (51, ""), (52, "nowhere"), (53, "W3 w3 w4"), (54, "w1"), (54, "w2"), (None, "w5")]
    return rows, items


def test_equals_brute_force(spark):
    rows, items = cases()
    assert run(spark, rows, items) == brute(rows, items)
    assert run(spark, rows, items, k=3) == brute(rows, items, 3)


def test_blocks_and_groups(spark, monkeypatch):
    rows, items = cases()
    monkeypatch.setattr(lexical, "ITEM_GROUP", 3)
    monkeypatch.setattr(lexical, "EXACT_TERMS", 2)
    assert run(spark, rows, items, block_bytes=60) == brute(rows, items)


def test_empty(spark):
    rows, items = cases()
    assert run(spark, [], items) == []
    assert run(spark, rows, []) == []
    assert run(spark, [(1, None), (2, "--")], items) == []


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, "same words here") for i in range(40)] + [(100, "other")]
    assert [r[:3] for r in sorted(run(spark, rows, [(1, "words")], k=4), key=lambda r: r[1])] == [
        (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)]
