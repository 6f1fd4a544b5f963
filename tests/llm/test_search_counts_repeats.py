import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from profila.llm import ann, hamming, repeats, tokencount
from profila.llm.suffixes import common_prefixes, joined, suffix_array


def test_suffix_array_and_prefixes_equal_plain_sorting():
    r = random.Random(4)
    for i in range(120):
        parts = [bytes(r.choice(b"ab" if i % 2 else b"abcdxyz") for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 12))]
        text, _ = joined(parts + parts[: i % 3] + [b"a" * (i % 50)])
        plain = text.tolist()
        want = sorted(range(len(plain)), key=lambda at: plain[at:])
        order = suffix_array(text)
        assert order.tolist() == want
        for got, (one, two) in zip(common_prefixes(text, order).tolist(), zip(want, want[1:])):
            n = 0
            while plain[one + n] == plain[two + n] > 1:
                n += 1
            assert got == n
    assert suffix_array(joined([])[0]).tolist() == [0]


@pytest.mark.parametrize("block, shard_bytes", [(repeats.BLOCK, repeats.SHARD), (1, 500), (2, 1 << 19)])
def test_repeats_equal_brute_force(spark, block, shard_bytes):
    r = random.Random(5)
    phrase = "".join(r.choice("abcdé ") for _ in range(400))
    texts = [None, "", "x" * 700, phrase, "head " + phrase + " tail", phrase[100:330] + "end", phrase[:199], "q" * 50 + phrase[90:310]]
    texts += ["".join(r.choice("mnop") for _ in range(300)) for _ in range(3)] + [phrase]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    seen = Counter(b[p : p + 200] for b in raw.values() for p in range(len(b) - 199))
    out = repeats.without_repeats(docs, block=block, shard_bytes=shard_bytes).collect()
    assert len(out) == len(rows)
    for x in out:
        b = raw[x.doc_id]
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        assert bytes(x.kept) == np.frombuffer(b, np.uint8)[~gone].tobytes(), x.doc_id
        assert (x.n_bytes, x.n_removed) == (len(b), int(gone.sum()))
    assert repeats.without_repeats(docs.limit(0)).collect() == []


def plain_tokens(word, scores, longest):
    text, best = tokencount.MARK + word, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        ways = [(best[-1][0] + tokencount.UNKNOWN * n, best[-1][1] - n)]
        ways += [(best[s][0] + scores[text[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if text[s:end] in scores]
        best.append(max(ways))
    return -best[-1][1]


def test_trie_equals_plain_dynamic_programming(monkeypatch):
    scores = {"▁": -3.0, "a": -2.0, "ab": -2.5, "▁a": -1.0, "b": -2.0, "bc": -9.0, "c": -2.0, "\0c": -1.0}
    model, r = tokencount.Unigram(scores), random.Random(8)
    words = sorted({"".join(r.choice("abcé日😀\0") for _ in range(r.randint(1, 9))) for _ in range(900)} | {"a", "ab", "a\0", "a\0\0"})
    want = [plain_tokens(w, scores, 2) for w in words]
    assert model.group(words).tolist() == [model.one(w) for w in words] == want
    monkeypatch.setattr(tokencount, "GROUP", 7)
    monkeypatch.setattr(tokencount, "LONG", 6)
    r.shuffle(words)
    assert model.counts(pa.array(words + [""])).tolist() == [plain_tokens(w, scores, 2) for w in words] + [0]


def test_token_counts_equal_plain_dynamic_programming(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = tokencount.vocabulary()
    longest = max(map(len, scores))
    held = lru_cache(None)(lambda w: plain_tokens(w, scores, longest))
    odd = [(-1, None), (-2, ""), (-3, " \t\n "), (-4, "ab cd"), (-4, "ab cd"), (None, "x " * 3), (-5, "z" * 300_000 + " 日本語のテキスト" * 40)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("n_tokens", F.lit("x"))
    want = []
    for x in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", x.text or "")
        want.append((x.doc_id, len(words), sum(map(held, words))))
    got = [(x.doc_id, x.n_words, x.n_tokens) for x in tokencount.count_tokens(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(docs.limit(0)).collect() == []


def test_codes_equal_brute_force(spark):
    r = random.Random(1)
    codes = {i: r.getrandbits(12) | r.choice([0, 7 << 40]) for i in range(60)}
    rows = [(i, c, "x") for i, c in codes.items()] + [(None, 5, "x"), (99, None, "x"), (3, codes[3], "x")]
    table = spark.createDataFrame(rows, "vec_id long, code long, distance string")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.distance) for x in hamming.nearest_codes(table, table.where("vec_id % 20 = 0"), 4).collect())
    want = []
    for q in (0, 20, 40):
        near = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in codes.items() if i != q)[:4]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == want


def test_neighbours_and_edges(spark):
    schema = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, 0.0], "x"), (1, [2.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [0.0, 0.0], "x"), (4, None, "x"),
            (5, [float("nan"), 1.0], "x"), (6, [1.0, None], "x"), (None, [1.0, 1.0], "x"), (7, [1.0, 0.0], "x")]
    out = ann.nearest(spark.createDataFrame(rows, schema), "vec_id % 50 = 0").orderBy("rank").collect()
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in out] == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (0, 3, 2, 0.0)]
    assert ann.nearest(spark.createDataFrame([], schema), "vec_id % 50 = 0").collect() == []


def test_shards_tell_of_neighbouring_windows_in_one_row():
    r = random.Random(11)
    base = bytes(r.choice(b"abcdefgh") for _ in range(300))
    cuts = [base] + [base[:at] + b"X" + base[at + 1 :] for at in r.sample([*range(110), *range(160, 300)], 25)]
    shard = pd.DataFrame({"anchor": 7, "offset": 120, "content": range(len(cuts)), "copies": 1, "block": 0, "blocks": 2, "raw": cuts})
    out = repeats.repeated_in_shard(shard, 200)
    told = out[out["core"].notna()]
    windows = Counter((at, cut[at : at + 200]) for cut in cuts for at in range(101))
    listed = [(at, cuts[x.content][at : at + 200], alone) for x in told.itertuples() for at, alone in zip(x.places, x.alone)]
    assert sorted(listed) == sorted((at, w, n == 1) for (at, w), n in windows.items())
    assert len(told) * 8 < len(listed)
    # Equal common bytes have equal hashes, others have not.
    cores = {(x.core, (120 - at) // repeats.STEP, cuts[x.content][120 - (120 - at) // repeats.STEP * repeats.STEP :][: 200 - repeats.STEP + 1])
             for x in told.itertuples() for at in x.places}
    assert len(cores) == len({c[0] for c in cores}) == len({c[1:] for c in cores})
