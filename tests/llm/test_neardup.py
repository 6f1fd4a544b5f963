import random
import re

import numpy as np

from profila.llm import neardup
from profila.llm.shingles import shingle_set, word_hashes

SCHEMA = "doc_id long, text string, component_id string, n string"


def brute(rows, words, least=80):
    sets = {}
    for i, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    group = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= least * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return {i: (len(sets[i]), group[i]) for i in ids}


def test_words_and_blocks(monkeypatch):
    text = "A b c\tÄä  the end " * 50
    whole = word_hashes(text)
    assert len(whole) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
    assert (word_hashes(text.replace("A", "a")) == whole).all()
    monkeypatch.setattr("profila.llm.shingles.BLOCK", 16)
    assert (word_hashes(text) == whole).all()
    assert len(word_hashes(None)) == len(shingle_set(" \n", 2)) == 0
    assert len(shingle_set("one", 5)) == 1


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows, base = [], [[f"w{r.randrange(90)}" for _ in range(r.choice([3, 6, 30, 60]))] for _ in range(12)]
    for i in range(90):
        words = list(r.choice(base))
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(words)))
    want = brute(rows, 2)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2, centres=2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


def test_edges(spark):
    rows = [(1, None, "a", None), (2, " ", None, "b"), (3, "Solo", "x", "y"), (4, "solo", "x", "y"), (5, "A b c", "x", "y"),
            (5, "A b c", "x", "y"), (None, "a b c", "x", "y"), (6, "a b c", None, None), (7, "word " * 9000, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(docs, words=2).collect()),
                 key=str)
    assert out == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 2, 5, True), (5, 2, 5, True),
                          (None, 2, None, True), (6, 2, 5, False), (7, 1, 7, True)], key=str)
    kept = neardup.keep_one_each(docs, words=2)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id or 0 for x in kept.collect()) == [1, 2, 3, 5, 7]
    rows = [(1, "text a one two", "k", None), (1, "text b three four", "k", None), (2, "text b three four", "k", None),
            (3, "text a one two", "k", None), (None, "only here five", "k", None), (None, "only here five", "j", None),
            (4, None, "k", None), (4, None, "k", None), (None, None, "k", None)]
    kept = neardup.keep_one_each(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((x.doc_id, x.text, x.component_id) for x in kept.collect()), key=str) == sorted(
        [(1, "text a one two", "k"), (1, "text b three four", "k"), (None, "only here five", "j"), (4, None, "k"), (None, None, "k")], key=str)
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signature_borrows_by_order():
    r = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 900):
        held = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        bins = 64
        of = np.minimum(held // np.uint64((1 << 64) // bins), np.uint64(bins - 1)).astype(int)
        least = {b: held[of == b].min() for b in set(of.tolist())}
        want = [least[next(b for b in order if b in least)] for order in neardup._orders(bins).tolist()]
        assert neardup.signature(held, bins).tolist() == want


def test_texts_of_one_id_are_one_document(spark):
    texts = [f"{c}1 {c}2 {c}3 {c}4" for c in "abc"]
    rows = [(7, t) for t in texts] * 2 + [(10 + i, t + " z") for i, t in enumerate(texts)] + [(3, texts[1]), (20, "other words here")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=9).collect()
    assert {x.doc_id: x.component_id for x in out} == {7: 3, 3: 3, 10: 10, 11: 11, 12: 12, 20: 20}


def test_copies_of_a_late_original_are_one_group(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in r.sample(range(150), 12):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    rows.append((60, " ".join(base)))
    want = brute(rows, 2)
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == want


def test_outsiders_of_a_large_group_are_not_compared_with_all_of_it(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        for at in r.sample(range(150), 4 if i % 3 else 14):  # of 150: similar to the first, or not
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    compared, passing = [], neardup._passing
    monkeypatch.setattr(neardup, "_passing", lambda pairs, *rest: compared.append(pairs.count()) or passing(pairs, *rest))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == brute(rows, 2)
    assert len({x.component_id for x in out}) > 30
    assert sum(compared) < 15 * len(rows), compared  # members times outsiders: over 3000 pairs


def test_texts_that_nobody_asks_for_are_not_shuffled(spark, monkeypatch):
    ids = "named_struct('unnamed', id % 50 = 0, 'id', if(id % 50 = 0, null, id))"
    docs = spark.range(30000).selectExpr("id", f"{ids} AS doc_id", "concat('text ', id) AS text")
    asked = docs.where("id % 30 = 7").select("doc_id")
    for most in (neardup.SIEVE_MOST, 5000):
        monkeypatch.setattr(neardup, "SIEVE_MOST", most)
        out = neardup._sieved(docs, asked)
        assert out.columns == docs.columns
        found = {r.id for r in out.collect()}
        assert found >= set(range(7, 30000, 30))
        assert len(found) < (4000 if most > 5000 else 10000)
    assert neardup._sieved(docs, asked.limit(0)).count() == 0
    named = spark.createDataFrame([(None, "a b"), ("x", "c d"), ("y", "e f")], "doc_id string, text string")
    assert [r.text for r in neardup._sieved(named, named.where("doc_id = 'x'").select("doc_id")).collect()] == ["c d"]

    shuffled, sets = [], neardup._sets
    monkeypatch.setattr(neardup, "_sets", lambda rows, size: shuffled.append(rows._jdf.queryExecution().toString()) or sets(rows, size))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, f"w{i // 2} " * 3 + " ".join(f"v{i // 2}_{k}" for k in range(40)) + (" z" if i % 2 else "")) for i in range(20)]
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {x.doc_id: x.component_id for x in out} == {i: i - i % 2 for i in range(20)}
    assert shuffled and all("getbit" in plan for plan in shuffled)
