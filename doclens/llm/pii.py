"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Kinds, in the order of results: email, ip, card, phone (base kinds), then iban
(mod-97, at the length of its country), ssn and secret (keys and tokens). A base span stays whatever its score; an added span stays if its score reaches
`min_score`. Offsets are code points, end exclusive.

Defined cases: a null or empty text has no spans; rows with equal or null ids are
treated one by one; an empty table gives an empty result; other columns are
ignored by `find_pii` and kept by `redact`; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import arrow_map, slices, table, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: All starts within one run of digits go on alike, so a match that fails at the first fails at all: only that is tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
#: Characters of an account number by country; of other countries, each end before a blank is tried.
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV HN", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Keys and tokens: long hexadecimal strings, and those with a well-known beginning. Without a word near them that tells so they may be anything.
SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|A[KS]IA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72})(?![A-Za-z0-9_])")
NOT_DIGIT = re.compile(r"[^0-9]+")

START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6, "ssn": 0.4, "secret": 0.4}
#: Words near a span, on either side, that speak for a kind, and words that speak against any.
FOR = {
    "email": ("mail", "contact", "correo", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "key", "secret", "password", "passwd", "api", "auth", "credential", "credentials", "bearer"),
}
AGAINST = ("version", "example", "sample", "isbn", "serial", "order", "invoice")
BOOST, CUT, WINDOW = 0.3, 0.2, 40


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return not (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10


def octet(digits: str) -> bool:
    """At most 255, whatever zeros lead and however many."""
    x = digits.lstrip("0")
    return len(x) <= 3 and int(x or 0) <= 255


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Each match has one @: it takes the whole run of local characters before it that no earlier match holds."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans that mod-97 confirms: of the country's length, or of the longest end that no letter or digit follows."""
    out, done = [], 0
    for m in IBAN.finditer(text):
        if m.start() < done:
            continue
        run, full = m[1], IBAN_LENGTHS.get(m[1][:2])
        length = 0
        ends = []
        for i, c in enumerate(run, 1):
            length += c != " "
            after = text[m.start() + i : m.start() + i + 1]
            if c != " " and not (after.isascii() and after.isalnum()) and (length == full if full else 15 <= length <= 34):
                ends.append(i)
        for i in reversed(ends):
            if mod97(run[:i]):
                done = m.start() + i
                out.append((m.start(), done))
                break
    return out


def found(text: str, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind, then start."""
    spans: list[tuple[str, int, int]] = [("email", *s) for s in emails(text)]
    if "." in text:
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    spans += [("iban", *s) for s in ibans(text)]
    if "-" in text:
        spans += [("ssn", *m.span()) for m in SSN.finditer(text)]
    spans += [("secret", *m.span()) for m in SECRET.finditer(text)]
    out = []
    for kind, a, b in spans:
        near = re.findall(r"[a-z]+", f"{text[max(0, a - WINDOW) : a]} {text[b : b + WINDOW]}".lower())
        score = START[kind] + BOOST * any(w in FOR[kind] for w in near) - CUT * any(w in AGAINST for w in near)
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE or score >= min_score:
            out.append((kind, a, b, score))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """One row per input row: (id, found array<struct<kind,start,end,score>>). No shuffle."""

    def run(batch):
        return {"id": batch.column(0), "found": [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in found(t, min_score)] for t in texts(batch, 1)]}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint,score:double>>").withColumnRenamed("id", id_col)


def redacted(text: str, min_score: float = 0.5) -> str:
    """Each span becomes <KIND>; of overlapping spans, the earlier and then the longer is taken, the rest of the other with it."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b, _ in found(text, min_score)):
        if not out or a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", min_score: float = 0.5) -> DataFrame:
    """The same rows and columns with personal data replaced in the text (null stays null) and the character count set anew."""
    import pyarrow as pa

    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches):
        for batch in slices(batches):
            new = pa.array([t if t is None else redacted(t, min_score) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    out = docs.mapInArrow(run, schema)
    if chars_col and chars_col in schema.names:
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.char_length(text_col)).cast(schema[chars_col].dataType))
    return out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns over all documents, and `scores` in the order of `spans`."""

    def run(batch):
        out = {"doc_id": batch.column(0), **{k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores")}}
        for t in texts(batch, 1):
            got = found(t)
            for k in BASE:
                out[f"n_{k}"].append(sum(x[0] == k for x in got))
            out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in got if k in BASE).encode()).hexdigest())
            out["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in got))
            out["scores"].append(",".join(f"{s:g}" for *_, s in got))
        return out

    return arrow_map(table(spark, sf_dir, "documents").select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string")
