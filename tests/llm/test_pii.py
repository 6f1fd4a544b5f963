import random
import re
from hashlib import sha256

from profila.llm import pii, queries

SCHEMA = "doc_id long, text string, spans string, kind string"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    ds = [int(d) for d in digits][::-1]
    return sum(ds[::2] + [sum(divmod(2 * d, 10)) for d in ds[1::2]]) % 10 == 0


def brute(text):
    """(start, place of the kind, kind, end) by the plain patterns."""
    out = []
    for at, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), at, kind, m.end()))
    return sorted(out)


def base(text):
    return [s[:4] for s in pii.find(text) if s[2] in pii.BASE]


def test_base_equals_plain_patterns():
    r = random.Random(11)
    parts = ["a", "b.c", "@", "@x.y", "a@b", "é", "+", "+1 (555) 123-4567", "4", "4111 1111 1111 1111", "1.2.3.4", ".5", "-", " ",
             "256.1.1.1", "007.0.0.01", "%", "日", "378282246310005", "0000", "\n", "(", ")", "@@", "..", "a@b.c@d.e", "12345678901234567890"]
    for _ in range(6000):
        text = "".join(r.choices(parts, k=r.randrange(1, 14)))
        assert base(text) == brute(text), text


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def test_added_kinds_and_context():
    kinds = lambda t: [s[2] for s in pii.find(t)]
    assert kinds("Pay to GB82 WEST 1234 5698 7654 32 AND THEN") == ["iban"]
    assert kinds("GB82 WEST 1234 5698 7654 33") == []
    assert kinds("XGB82WEST12345698765432") == []
    assert kinds("her ssn is 123-45-6789.") == ["ssn"] and kinds("123-45-6789") == []
    assert kinds("ssn 000-45-6789, 666-45-6789, 123-00-6789, 9-123-45-6789") == []
    assert "iban" in kinds("part GB82WEST12345698765432 of my bank account") and kinds("serial part GB82WEST12345698765432") == []
    plain, near = pii.find("x 10.1.2.3")[0][4], pii.find("server 10.1.2.3")[0][4]
    assert near > plain > pii.find("version 10.1.2.3")[0][4]


def test_long_texts_take_linear_time():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "a@" * 1_000_000, "+1 " * 700_000, "1 " * 1_000_000, "AA11" * 500_000):
        pii.find(text)


def test_query(spark, tmp_path):
    texts = [None, "", "Mail Ä me@x.org, call +1 (555) 123-4567", "4111 1111 1111 1111 from 10.0.0.1", "me@x.org"]
    rows = [(i, t, "old", "k") for i, t in enumerate(texts)] + [(4, "me@x.org", None, None), (None, "me@x.org", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text, *_ in rows:
        found = brute(text)
        told = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
        want.append((i, *[sum(f[2] == k for f in found) for k in BASE], sha256(told.encode()).hexdigest(), told))
    got = sorted(map(tuple, queries.op13_pii(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(want, key=str)


def test_redacted_and_empty(spark):
    docs = spark.createDataFrame([(1, "at me@x.org now", "s", "k"), (2, None, None, None)], SCHEMA)
    assert [tuple(r) for r in pii.redacted(docs).orderBy("doc_id").collect()] == [
        (1, "at <email> now", "s", "k"), (2, None, None, None)]
    assert pii.scan(docs).columns == ["doc_id", "text", "kind", "spans"]
    assert pii.scan(docs.limit(0)).collect() == []
