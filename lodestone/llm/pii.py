"""Personal data: regular expressions propose spans, checksums confirm them, context words move the score.

Every text is read whole. Null and empty texts have no spans; other columns are left alone.
Positions are code points, end exclusive; rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import slices, table

#: Kinds in the order in which spans are listed; the first four are the base kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
#: The score from which a span of an added kind is reported; base spans always are.
THRESHOLD = 0.5
#: So many characters on each side are searched for context words.
CONTEXT = 48
CONTEXT_WORDS = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|login)\b"),
    "card": re.compile(r"(?i)\b(card|visa|credit|debit|carte|karte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(phone|tel|call|mobile|fax|t[ée]l[ée]phone|telefon|tel[ée]fono)\b"),
    "iban": re.compile(r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(ssn|social|security|taxpayer)\b"),
    "local_phone": re.compile(r"(?i)\b(phone|tel|call|mobile|fax|t[ée]l[ée]phone|telefon|tel[ée]fono)\b"),
}
#: The score of a confirmed span without context, and what one context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3}
LIFT = 0.3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether the digits, the last being the check digit, pass the Luhn test."""
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account code passes the mod-97 test (its first four characters moved to the end)."""
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the email pattern matches, leftmost first, in time linear in the text.

    A local part holds no @, so a match that starts in the run before an @ ends after that @: the
    leftmost start is the run's first character that the last match has not taken.
    """
    done = before = 0
    at = text.find("@")
    while at >= 0:
        low = max(done, before)
        run = text[low:at]
        start = low + len(run.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        before = at + 1
        at = text.find("@", before)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans, by kind as in KINDS, then start."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += (("email", *x) for x in _emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
        # Confirmed spans merged into runs in order, so that each candidate asks only the run it begins in and the next.
        runs: list[list[int]] = []
        for a, b in sorted((a, b) for _, a, b in found):
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        starts = [a for a, _ in runs]

        def free(start: int, end: int) -> bool:
            at = bisect_right(starts, start)
            return not (at and runs[at - 1][1] > start) and not (at < len(runs) and runs[at][0] < end)

        for kind, pattern, valid in (("iban", _IBAN, lambda s: mod97(s.replace(" ", ""))), ("ssn", _SSN, None), ("local_phone", _LOCAL_PHONE, None)):
            for m in pattern.finditer(text):
                if (valid is None or valid(m[0])) and free(*m.span()):
                    found.append((kind, *m.span()))
    out = []
    for kind, start, end in found:
        near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
        score = min(1.0, PRIOR[kind] + LIFT * bool(CONTEXT_WORDS[kind].search(near)))
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, start, end, score))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text="text"):
        rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(x)] for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,score>>) of each document; needs doc_id and text only."""
    plan = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plan.mapInArrow(_spans, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, text="text"):
        out = []
        for x in b.column(1).to_pylist():
            done, parts = 0, []
            for kind, start, end, _ in sorted(find(x), key=lambda s: (s[1], -s[2])):
                if start >= done:
                    parts += [x[done:start], f"<{kind}>"]
                    done = end
            out.append(x if x is None else "".join([*parts, x[done:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def mask(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in angle brackets; overlaps go to the leftmost, longest."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_masked, "doc_id long, text string")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the spans of each document, the spans and their scores."""
    spans = F.col("spans")

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    scores = F.array_join(F.transform(spans, lambda x: F.format_number(x["score"], 2)), ",")
    return detect(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"), scores.alias("scores"))

