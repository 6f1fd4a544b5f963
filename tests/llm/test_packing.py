import zlib
from collections import defaultdict

import numpy as np
import pytest

from profila.llm import packing
from profila.llm.queries import op8_pack

SCHEMA = "doc_id long, text string, ids string, open string"


def check(pieces, texts, length):
    """Every id in exactly one piece; sequences without gaps and not too long."""
    docs, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
        windows[p.sequence_id].append((p.offset, len(p.ids) // 4))
    for doc, text in texts.items():
        whole = [*packing.encode(text).tolist(), packing.END_ID]
        got = sorted(docs.pop(doc))
        assert [i for _, ids, _ in got for i in ids] == whole
        assert all(total == len(whole) for _, _, total in got)
    assert not docs
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return sum(n for parts in windows.values() for _, n in parts), len(windows)


def test_round_trip_and_padding(spark):
    texts = {i: "word " * (i * 37 % 900) + str(i) for i in range(700)}
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts.items()], SCHEMA).repartition(7)
    tokens, n = check(packing.pack(df, length=256, windows=8, merge=3).collect(), texts, 256)
    assert tokens / (n * 256) > 0.96


def test_edges(spark):
    texts = {1: None, 2: "", 3: "x y" * 30_000, 4: "<|endoftext|>", 5: "é \U0001F600"}
    df = spark.createDataFrame([(i, t, None, None) for i, t in texts.items()], SCHEMA)
    check(packing.pack(df).collect(), texts, 2048)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = spark.createDataFrame([(7, "same", "", ""), (7, "same", "", ""), (None, "n", "", "")], SCHEMA)
    assert sorted((r.doc_id or 0) for r in packing.pack(twice).collect()) == [0, 7, 7]
    large = spark.createDataFrame([((1 << 60) + 1, "a", "", ""), (None, "b", "", "")], SCHEMA).coalesce(1)
    assert {r.doc_id for r in packing.pack(large).collect()} == {(1 << 60) + 1, None}


def test_ids_equal_those_of_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text in [*texts, "a  b\r\n c", "ÀÉ " * 50, "1234567 don't 'LL", "x" * 3000,
                 "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c", "<|endoftext"]:
        assert packing.encode(text).tolist() == model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = op8_pack(spark, folder).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.append(packing.encode(d.text), 1).astype("<u4")
        assert sum(r.length for r in by[d.doc_id]) == len(ids)
        for r in by[d.doc_id]:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    padded = len({r.sequence_id for r in rows}) * 2048
    assert sum(r.length for r in rows) > 0.98 * padded
