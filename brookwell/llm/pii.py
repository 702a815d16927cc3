"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_rows, map_arrow, pieces

#: The kinds in their order. The first four are the base; their spans are kept whatever their score.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
BASE = KINDS[:4]

# An email is looked for from its @: the local part is the run before it, back to the last match's end.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs and the look-behind keep the search linear: no match can start inside a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that raise or lower a kind's score when they stand near (lower case).
CONTEXT = {
    "email": ({"mail", "email", "e-mail", "contact", "write"}, {"example"}),
    "ip": ({"ip", "host", "server", "address", "login"}, {"version", "release", "section"}),
    "card": ({"card", "visa", "mastercard", "credit", "debit", "payment"}, {"isbn", "order", "serial", "tracking"}),
    "phone": ({"phone", "tel", "call", "mobile", "fax"}, set()),
    "iban": ({"iban", "account", "bank", "konto", "compte", "cuenta"}, {"part", "model"}),
    "secret": ({"token", "key", "secret", "password", "api", "credential"}, {"sha", "sha1", "sha256", "md5", "commit", "digest", "checksum"}),
    "ssn": ({"ssn", "social", "security", "taxpayer"}, {"order", "part", "phone"}),
}
#: Score of a proposal, of one that a checksum confirmed, a context word's weight, the least score of an added span.
PROPOSED, CONFIRMED, NEAR, LEAST = 0.4, 0.8, 0.25, 0.6
WINDOW = 48
_WORDS = re.compile(r"[a-z0-9-]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The IBAN check: moved country and check digits to the end, letters as numbers, remainder 1."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    last, at = 0, text.find("@")
    while at >= 0:
        if m := _AT.match(text, at):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end(), False
                last = m.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            yield *m.span(), False


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield *m.span(), True


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield *m.span(), False


def _ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _IBAN.finditer(text):
        # trailing words in capitals may have been taken along: the longest confirmed prefix at a group's end counts
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start() + 14, -1) if text[i] == " ")]
        for end in ends:
            if mod97(text[m.start() : end]):
                yield m.start(), end, True
                break


def _secrets(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _SECRET.finditer(text):
        yield *m.span(), not re.fullmatch(r"[0-9a-f]+", m[0])


def _ssns(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield *m.span(), False


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "secret": _secrets, "ssn": _ssns}


def score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    good, bad = CONTEXT[kind]
    words = set(_WORDS.findall(text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower()))
    return min(1.0, max(0.0, (CONFIRMED if confirmed else PROPOSED) + NEAR * (bool(words & good) - bool(words & bad))))


def find_spans(text: str | None) -> list[Span]:
    """All spans by kind, then start (code points, end exclusive). Added kinds need a score of LEAST and no base span there."""
    out: list[Span] = []
    if not text:
        return out
    for kind in KINDS:
        for start, end, confirmed in FINDERS[kind](text):
            s = score(text, kind, start, end, confirmed)
            if kind in BASE or s >= LEAST and not any(x.start < end and start < x.end for x in out if x.kind in BASE):
                out.append(Span(kind, start, end, s))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span's place taken by [KIND]; where spans overlap, their union is taken by the first's."""
    out, last = [], 0
    merged: list[list] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end, s.kind])
    for start, end, kind in merged:
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join(out) + text[last:]


SPAN_TYPE = "array<struct<kind: string, start: long, end: long, score: double>>"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and spans. Null or empty texts have no spans; repeated rows and null ids stay; other columns are ignored.

    A narrow map: no shuffle, one pass over the text, memory of some megabytes of text at a time.
    """
    d = clean_rows(docs, id_col, text_col).toDF("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield {"id": part.column("id"), "spans": [[vars(s) for s in find_spans(t)] for t in part.column("text").to_pylist()]}

    kind = f"id {d.schema['id'].dataType.simpleString()}, spans {SPAN_TYPE}"
    return map_arrow(d, run, kind).withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table, same columns, each text with its spans taken by [KIND]; null texts stay null."""

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in pieces(batch, text_col):
                columns = {c: part.column(c) for c in names}
                columns[text_col] = [t and redact(t, find_spans(t)) for t in part.column(text_col).to_pylist()]
                yield columns

    return map_arrow(docs, run, docs.schema)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
