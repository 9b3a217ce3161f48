import re

from stressloom.llm import pii


def brute(text):
    """The base kinds by their plain patterns."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_equal_plain_patterns():
    import random

    rng = random.Random(9)
    pieces = ["a@b.c", "_d@e.f", "x.y+z@host.org", "@", "@@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567", "+1", "+(2)", "12", " ", "-", "é", "你", "--", "a"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == brute(text), text


def test_checksums_and_context():
    found = lambda t: [(k, t[a:b], s) for k, a, b, s in pii.spans(t)]
    assert [x[:2] for x in found("IBAN DE89 3704 0044 0532 0130 00 here") if x[0] == "iban"] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert not [x for x in found("IBAN DE88 3704 0044 0532 0130 00 here") if x[0] == "iban"]
    assert [x[0] for x in found("social security 123-45-6789")] == ["ssn"] and not found("range 123-45-6789")
    (near,), (far,) = found("server address 10.0.0.1"), found("version 10.0.0.1")
    assert near[2] > far[2]


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 150_000, "+1" * 100_000):
        pii.spans(text)


def test_odd_rows(odd, clash, none, spark):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == odd.count() and all(r["spans"] == [] for r in rows)
    assert pii.find_pii(clash).count() == odd.count() and pii.find_pii(none).count() == 0


def test_query(spark, sf):
    q = pii.query(spark, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import hashlib

    for r in q.collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in base) for k in pii.BASE)
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in base).split(",")) - {""} <= set(r.spans.split(","))
