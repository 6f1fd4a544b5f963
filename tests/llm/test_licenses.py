import re

from profila.llm import licenses
from profila.llm.queries import op1_licenses

SCHEMA = "doc_id long, text string, license string, start string"


def brute(text, containment=licenses.CONTAINMENT):
    words, out = re.findall(r"[a-z0-9]+", (text or "").lower()), set()
    for name, _, part in licenses.passages(licenses.TEMPLATES):
        want = {tuple(part[i : i + 5]) for i in range(len(part) - 4)}
        for at in range(max(len(words) - 4, 0)):
            near = words[at : at + len(part)]
            if len({tuple(near[i : i + 5]) for i in range(len(near) - 4)} & want) >= containment * len(want):
                out.add(name)
    return out


def test_edges(spark):
    lead = "lorem ipsum dolor sit amet " * 3
    texts = [None, "", "Released under the MIT", *[lead[: 6 * i] + t + " tail" for i, t in enumerate(licenses.TEMPLATES.values())],
             "word " * 20_000 + licenses.TEMPLATES["mit"], "a license to the public under MIT terms, version 2"]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] * 2
    found = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r.doc_id, r.license) for r in found}
    assert len(found) == len(got)
    assert got == {(i, name) for i, t in enumerate(texts) for name in brute(t)}
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = {(r.doc_id, name) for r in docs for name in brute(r.text)}
    assert {(r.doc_id, r.license) for r in op1_licenses(spark, "/root/testdata/sf0.01").collect()} == want
    assert want
