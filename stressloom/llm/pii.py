"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds, in the order of results:
  email, ip, card, phone   the base kinds; a base span is always reported, whatever its score
  iban                     account numbers that pass the mod-97 check
  ssn                      ddd-dd-dddd, reported only where words nearby lift its score to `least` or more

Matches of a kind are leftmost and do not overlap; a match that fails its check is dropped and not tried again. Positions are code
points, end exclusive. Null and empty texts have no spans; repeated rows give repeated results; a null id is passed through.
Work is per document, linear in its length, without a shuffle.
"""

from __future__ import annotations

import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stressloom.llm.staging import mapped, small_batches

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
LEAST = 0.5
REACH = 48
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|payment|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|call|tel|mobile|fax|telefon|tél|teléfono)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|taxpayer)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|example|order|invoice|part|isbn|serial)\b", re.I)

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at each "@": the name before it is the whole run of its characters since the last match."""
    done, seen, at = 0, 0, text.find("@")
    while at >= 0:
        since = max(done, seen)
        start = since + len(text[since:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        seen = at + 1
        at = text.find("@", max(seen, done))


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield "iban", m.start(), m.end()
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def spans(text: str, least: float = LEAST) -> list[tuple[str, int, int, float]]:
    out = []
    for kind, a, b in candidates(text):
        near = text[max(0, a - REACH) : a] + " " + text[b : b + REACH]
        score = PRIOR[kind] + (0.3 if CONTEXT[kind].search(near) else 0.0) - (0.2 if AGAINST.search(near) else 0.0)
        if kind in BASE or score >= least:
            out.append((kind, a, b, round(min(1.0, max(0.0, score)), 2)))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end, score>> by kind as listed, then start."""
    kind = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>"
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    small_batches(docs.sparkSession)

    def scan(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(t or "", least)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, item)], ["doc_id", "spans"])

    return mapped(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), scan, kind)


def joined(col) -> F.Column:
    return F.concat_ws(",", F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select(
        "doc_id", *[n(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        n("iban"), n("ssn"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )
