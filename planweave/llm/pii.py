"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.common import documents, in_slices

#: Kinds in the order in which spans are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
#: Score that a proposed span starts with, by kind; context words add or take away BONUS. The second table is of spans that are not base spans.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7}
ADDED_PRIOR = {"card": 0.6, "iban": 0.65, "ssn": 0.45, "secret": 0.6}
BONUS = 0.2
#: Spans of a kind beyond the base kinds are reported from this score on.
THRESHOLD = 0.5
#: Code points before and after a span in which context words count.
CONTEXT = 48

# The base patterns of the data contract, then the patterns that this method adds.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), which can only begin where digits begin: each run is read once
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: An access key that its prefix tells, and values that a name like "password" assigns.
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
ASSIGNED = re.compile(r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\x20]?[=:][\x20]?[\"']?([A-Za-z0-9_+/=.-]{8,})")
#: Lengths of bank account numbers by country, as the public registry lists them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Words that make a kind likelier, and words that make any number less likely to be personal.
FOR = {
    "email": re.compile(r"(?i)\b(e-?mail|contact|write|address)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|login)\b"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment)\b"),
    "phone": re.compile(r"(?i)\b(phone|tel|call|mobile|fax|contact)\b"),
    "iban": re.compile(r"(?i)\b(iban|account|bank|transfer)\b"),
    "ssn": re.compile(r"(?i)\b(ssn|social|security|insurance)\b"),
    "secret": re.compile(r"(?i)\b(login|user|credentials?|auth|private|bearer)\b"),
}
AGAINST = re.compile(r"(?i)\b(version|order|invoice|isbn|part|serial|build|checksum|commit)\b")
#: Distinct characters that an assigned secret has at least, among them a digit.
SECRET_CHARACTERS = 6


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether a bank account number passes the mod-97 check."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@lru_cache(maxsize=128)
def _rest_of_iban(n: int) -> re.Pattern:
    return re.compile(r"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % n)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Bank account numbers: as many characters as the country's have, with single spaces between them, and the right checksum."""
    for m in IBAN_START.finditer(text):
        length = IBAN_LENGTHS.get(m[0][:2])
        rest = _rest_of_iban(length - 4).match(text, m.end()) if length else None
        if rest and mod97(text[m.start() : rest.end()]):
            yield m.start(), rest.end()


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Access keys, and assigned values of many characters with a digit among them."""
    for m in ACCESS_KEY.finditer(text):
        yield m.span()
    for m in ASSIGNED.finditer(text):
        if len(set(m[1])) >= SECRET_CHARACTERS and any(c.isdigit() for c in m[1]) and not ACCESS_KEY.fullmatch(m[1]):
            yield m.span(1)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of run@host. A match has one ``@`` only, so it begins where the run that ends there begins."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and EMAIL_RUN.match(text, start - 1, start):
            start -= 1
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            floor = host.end()
        at = text.find("@", max(at + 1, floor))


def propose(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Spans that a pattern proposes and its checksum confirms: kind, start, end, and whether it is a base span."""
    yield from (("email", s, e, True) for s, e in _emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end(), True
    for m in CARD.finditer(text):
        if 13 <= len(m[0]) and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), len(digits) >= 16
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end(), True
    yield from (("iban", s, e, False) for s, e in _ibans(text))
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", m.start(), m.end(), False
    yield from (("secret", s, e, False) for s, e in _secrets(text))


def find_spans(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """All reported spans of a text by kind as listed, then start: kind, start, end (exclusive), score, base or not.

    Base spans are always reported, with their score; the others only from THRESHOLD on, so context words decide about them. A null text has no spans.
    """
    found = []
    for kind, start, end, base in propose(text or ""):
        near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
        score = (PRIOR if base else ADDED_PRIOR)[kind]
        score += BONUS * bool(FOR[kind].search(near)) - BONUS * bool(AGAINST.search(near))
        if base or score >= THRESHOLD:
            found.append((kind, start, end, min(1.0, max(0.0, round(score, 3))), base))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redacted(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, redact: bool = False) -> DataFrame:
    """Adds ``pii_spans`` (array of kind, start, end, score, base) to the documents and, with ``redact``, ``pii_redacted``, the text without them.

    One pass over whole texts, no shuffle; a task holds one batch. Offsets are code points, ends exclusive. A null or empty text has an
    empty list (and stays as it is). Other columns and repeated rows pass through; columns named like a result are replaced. Spans of
    different kinds may overlap; in the redacted text they become one.
    """
    docs = docs.drop("pii_spans", "pii_redacted")
    kind = docs.schema
    fields = "pii_spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>" + ", pii_redacted string" * redact
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
    place = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 1024):
            texts = batch.column(place).to_pylist()
            spans = [find_spans(t) for t in texts]
            listed = [[{"kind": k, "start": s, "end": e, "score": x, "base": b} for k, s, e, x, b in r] for r in spans]
            columns, names = [*batch.columns, pa.array(listed, spans_type)], [*batch.schema.names, "pii_spans"]
            if redact:
                columns.append(pa.array([redacted(t, r) if r else t for t, r in zip(texts, spans, strict=True)], pa.string()))
                names.append("pii_redacted")
            yield pa.RecordBatch.from_arrays(columns, names)

    out = type(kind)(list(kind.fields))
    for f in docs.sparkSession.createDataFrame([], fields).schema.fields:
        out = out.add(f)
    return docs.mapInArrow(scan, out)


def _listed(spans) -> F.Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op6_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; base spans digested, all spans listed."""
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii_spans")
    base = F.filter("pii_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("pii_spans")).alias("spans"),
        F.size("pii_spans").cast("long").alias("n_spans"),
    )


QUERIES = {"op6_find_pii": op6_find_pii}
SQL: dict[str, str] = {}
