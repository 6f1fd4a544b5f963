import random
import string

from profila.llm import langid

FOLDER = "/root/testdata/sf0.01"


def test_short_clean_texts_stay_and_long_gibberish_goes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    clean = [r.text for r in docs.where(langid.held_out()).where("lang is not null and n_chars > 200").collect()]
    assert len(clean) > 100
    shares = {}
    for words in (1, 2, 5, 20, 10_000):
        texts = [" ".join(t.split()[:words]) for t in clean]
        texts = [t for t in texts if langid.has_letter(t)]
        shares[words] = sum(langid.judge(texts, model)[2]) / len(texts)
    draw = random.Random(5)
    junk = [" ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(3, 9))) for _ in range(n))
            for n in (1000, 3000, 10_000) for _ in range(5)]
    gone = langid.judge(junk, model)[2]
    assert max(shares.values()) <= 0.02
    assert all(gone)
