import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        doubled = sum(d if i % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and doubled % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+() 0123456789é", max_size=80))
def test_base_spans_by_brute_force(text):
    assert pii.base_spans(text) == plain(text)


def added(text):
    """Spans of the added kinds by comparing every match with every base span, checksums in whole numbers."""
    base = plain(text)
    out = set()
    for kind, pattern in (("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), ("national", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ("local", r"(?<![0-9+().-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])")):
        for m in re.finditer(pattern, text):
            if kind == "iban":
                sign = m[0].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in sign[4:] + sign[:4])) % 97 != 1:
                    continue
            if kind == "national" and (m[0][:3] in ("000", "666") or m[0][0] == "9" or m[0][4:6] == "00" or m[0][7:] == "0000"):
                continue
            near = text[max(0, m.start() - 48) : m.start()] + "\n" + text[m.end() : m.end() + 48]
            words = {"iban": "iban|bank", "national": "ssn", "local": "tel|call"}[kind]
            sure = {"iban": 0.8, "national": 0.25, "local": 0.25}[kind] + (0.35 if re.search(rf"\b(?:{words})\b", near, re.I) else 0)
            if sure >= 0.5 and all(m.end() <= s or e <= m.start() for _, s, e in base):
                out.add((kind, *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "000-45-6789", "030 1234 5678", "(030) 123.45678", "+49 30 1234567", "4111 1111 1111 1111", "1.2.3.4", "a.b@c.org", "IBAN", "SSN", "tel", "call", "x" * 50, ",", "\n"]), max_size=12).map(" ".join))
def test_added_spans_by_brute_force(text):
    found = pii.find(text)
    assert {s[:3] for s in found if s[0] not in pii.BASE_KINDS} == added(text)
    assert [s[:3] for s in found if s[0] in pii.BASE_KINDS] == plain(text)


def test_texts_dense_in_matches_take_linear_time():
    import time

    took = []
    for n in (2_000, 16_000):
        text = "IBAN DE89 3704 0044 0532 0130 00 tel 030 1234 5678, a@b.org, 1.2.3.4 " * n
        began = time.process_time()
        pii.find(text)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


def test_query_by_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op2_pii(spark, small).collect()
    assert len(rows) == len(texts)
    for row in rows:
        spans = plain(texts[row["doc_id"]] or "")
        line = ",".join("%s:%d:%d" % s for s in spans)
        assert row["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert row["n_card"] == sum(s[0] == "card" for s in spans) and row["n_email"] == sum(s[0] == "email" for s in spans)
        assert not line or set(line.split(",")) <= set(row["spans"].split(","))


def test_added_kinds_need_a_checksum_or_context():
    assert ("iban", 5, 32) in [s[:3] for s in pii.find("IBAN DE89 3704 0044 0532 0130 00 ok")]
    assert not [s for s in pii.find("IBAN DE88 3704 0044 0532 0130 00 ok") if s[0] == "iban"]
    assert [s[0] for s in pii.find("my social security number is 123-45-6789.")] == ["national"]
    assert pii.find("part 123-45-6789.") == []


def test_redaction():
    assert pii.redact_text("Write to a.b@c.org or +49 30 1234567!") == "Write to <EMAIL> or <PHONE>!"
    assert pii.redact_text("") == ""


def test_odd_rows(odd, none):
    rows = pii.digest(odd).collect()
    assert len(rows) == 12 and all(r["n_email"] == 0 for r in rows)
    assert pii.digest(none).count() == 0 and pii.redact(none).count() == 0
    back = pii.redact(odd)
    assert back.columns == odd.columns and back.where("text IS NULL").count() == 1
    assert pii.detect(odd).count() == 12
