"""PII: patterns propose spans, checksums confirm them, context words adjust the score.

Each whole text is scanned once by patterns that take linear time on any text. Kinds `email`, `ip`, `card` and `phone` are the base; `iban`
(mod-97, the longest end that confirms) and `ssn` (issued ranges only, kept only with a context word near) are added. No shuffle:
one pass over the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
IBAN_LENGTH = 15
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Score of a confirmed span without context, and words that raise it when they stand within NEAR characters.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|schreib|courriel|écri|correo|escrib", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adress|rechner|serveur|servidor|direcci", re.I),
    "card": re.compile(r"card|visa|credit|debit|pay|karte|kredit|zahl|carte|paie|tarjeta|pago", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|anruf|handy|appel|llam|móvil", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|banque|cuenta|banco", re.I),
    "ssn": re.compile(r"ssn|social|security|tax|sozialvers|steuer|sécurité|seguridad", re.I),
}
NEAR = 40
RAISE = 0.1
#: Spans of the added kinds need this score.
LEAST_ADDED = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def issued(ssn: str) -> bool:
    """Whether the three parts are in ranges that are given out."""
    area, group, serial = ssn.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed ones; of a run that goes on into the next words, the longest end at a word's edge that confirms."""
    at = 0
    while m := IBAN.search(text, at):
        at = m.start() + 4
        for end in range(m.end(), m.start() + IBAN_LENGTH - 1, -1):
            if text[end - 1] != " " and (end == len(text) or not (text[end].isascii() and text[end].isalnum())):
                compact = text[m.start() : end].replace(" ", "")
                if len(compact) >= IBAN_LENGTH and mod97(compact):
                    yield m.start(), end
                    at = end
                    break


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                yield at, end
            at = end + 1


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text by kind as in KINDS, then start; code points, end exclusive; null: none."""
    if not text:
        return []
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    found += [("ip", s, e) for s, e in _ips(text)]
    found += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    found += [("iban", s, e) for s, e in _ibans(text)]
    found += [("ssn", *m.span()) for m in SSN.finditer(text) if issued(m[0])]
    out = []
    for kind, start, end in found:
        near = CONTEXT[kind].search(text, max(0, start - NEAR), start) or CONTEXT[kind].search(text, end, end + NEAR)
        score = round(min(1.0, PRIOR[kind] + (RAISE if near else 0.0)), 3)
        if kind in BASE or score >= LEAST_ADDED:
            out.append((kind, start, end, score))
    return out


SPANS = "spans array<struct<kind:string,start:int,end:int,score:double>>"


def detect_pii(docs: DataFrame) -> DataFrame:
    """doc_id and the array of spans of every row's whole text.

    Null or empty text: an empty array. Null doc_id stays null. Repeated rows give repeated results. No rows: no rows.
    Other columns are neither read nor returned.
    """

    def run(columns: dict[str, list]) -> dict:
        return {"spans": [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find_spans(t)] for t in columns["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ["text"], SPANS)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and scores (as strings, in the same order) and mean_score of every row, in one stage."""

    def run(columns: dict[str, list]) -> dict:
        rows = [find_spans(t) for t in columns["text"]]
        shown = [[(k, f"{k}:{s}:{e}") for k, s, e, _ in r] for r in rows]
        return {f"n_{k}": [sum(x[0] == k for x in r) for r in rows] for k in BASE} | {
            "base_sha256": [hashlib.sha256(",".join(x for k, x in r if k in BASE).encode()).hexdigest() for r in shown],
            "spans": [",".join(x for _, x in r) for r in shown],
            "scores": [",".join(f"{x[3]:g}" for x in r) for r in rows],
            "mean_score": [sum(x[3] for x in r) / len(r) if r else None for r in rows],
        }

    made = ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, scores string, mean_score double"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ["text"], made)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
