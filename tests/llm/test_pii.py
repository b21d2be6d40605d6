import hashlib
import re

from lodestone.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def plain(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and plain_luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


TEXTS = [
    None, "", "a@b.c", "x..y@@a.b", "a@b a@b.co@c.d", "é@b.fr é.a@b-c.fr.", "1.2.3.4.5 256.1.1.1 01.2.3.4 1.2.3", "999.1.1.1.1",
    "4532015112830366 4532-0151-1283-0366 4532 0151 1283 0367", "+1 (988) 555-2485 +12 +123-456-78 +1 2345678901234567", "+1.2.3.4.5.6.7.8",
    "12345678901234567890123", "call 555-123-4567 or 555-123-4567x", "ssn 123-45-6789", "GB82 WEST 1234 5698 7654 32", "a" * 5000 + "@b.c", "1" * 3000,
    "😀 a@b.cd 😀 10.0.0.1", "a@b..c a@-.- @a.b",
]


def test_base_spans_equal_the_patterns():
    for text in TEXTS:
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == plain(text), text


def test_added_kinds():
    kinds = lambda t: [s[0] for s in pii.find(t)]
    assert kinds("account GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("account GB83 WEST 1234 5698 7654 32.") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("item 123-45-6789") == []
    assert kinds("call 555-123-4567") == ["local_phone"]


def test_query(spark, tmp_path):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a@b.c", "x"), (0, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op2_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 0)}
    for i, t in enumerate(TEXTS):
        if i:
            want = plain(t)
            assert by[i].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
            assert [by[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
    masked = {r.doc_id: r.text for r in pii.mask(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert masked[2] == "<email>" and masked[1] == ""


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert pii.op2_pii(spark, str(tmp_path)).count() == 0
