"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in a whole text: at-signs, `://`, plus signs, digits and identifier cues. From
each anchor a deterministic parser expands to the bounds of an email, address or account and validates it. The spans
of the four base kinds are those of their patterns, leftmost and non-overlapping within a kind; a match that fails its
check is dropped and not tried again from inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "login")
SPANS = "array<struct<kind:string,start:int,end:int>>"
_AT, _SCHEME, _PLUS, _DIGIT, _IBAN, _SSN = range(6)
_CUES = {"@": _AT, "://": _SCHEME, "+": _PLUS} | {str(d): _DIGIT for d in range(10)} | {c: _IBAN for c in ("IBAN", "Iban", "iban")} | {c: _SSN for c in ("SSN", "Ssn", "ssn")}

_local = re.compile(r"[A-Za-z0-9._%+-]").match
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_digits = re.compile(r"[0-9]+").match
_address = re.compile(r"[0-9]+(?:\.[0-9]+){3}").match
_account = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_iban = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})").match
_ssn = re.compile(r"[\x20:#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])").match
_login = re.compile(r"[A-Za-z0-9._~%!$&*+-]+(?::[^\s/?#@:]*)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*").match
_scheme_char = re.compile(r"[A-Za-z0-9+.-]").match


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@lru_cache(1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for cue, kind in _CUES.items():
        found.add_word(cue, kind)
    found.make_automaton()
    return found


def _iban_end(text: str, start: int, end: int) -> int:
    """The longest end of a valid account in text[start:end], else 0."""
    while end > start:
        plain = text[start:end].replace(" ", "")
        if len(plain) < 15:
            return 0
        if text[end - 1] != " " and mod97(plain) and not text[end : end + 1].isalnum():
            return end
        end -= 1
    return 0


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, sorted; code points, end exclusive."""
    out: list[tuple[int, int, int]] = []
    email_at = ip_at = card_at = phone_at = 0
    for last, anchor in _anchors().iter(text):
        if anchor == _DIGIT:
            if last >= ip_at:
                if m := _address(text, last):
                    ip_at = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                        out.append((last, 1, ip_at))
                else:
                    ip_at = _digits(text, last).end()
            if last >= card_at:
                if m := _account(text, last):
                    card_at = m.end()
                    number = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(number) <= 19 and luhn(number):
                        out.append((last, 2, card_at))
                else:
                    card_at = last + 1
        elif anchor == _AT:
            start = last
            while start > email_at and _local(text[start - 1]):
                start -= 1
            if start < last and (m := _domain(text, last + 1)):
                email_at = m.end()
                out.append((start, 0, email_at))
        elif anchor == _PLUS:
            if last >= phone_at and (m := _phone(text, last)):
                phone_at = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((last, 3, phone_at))
        elif anchor == _IBAN:
            if (m := _iban(text, last + 1)) and (end := _iban_end(text, m.start(1), m.end(1))):
                out.append((m.start(1), 4, end))
        elif anchor == _SSN:
            if m := _ssn(text, last + 1):
                out.append((m.start(1), 5, m.end(1)))
        elif m := _login(text, last + 1):
            start = last - 2
            while start and last - start < 20 and _scheme_char(text[start - 1]):
                start -= 1
            if start < last - 2:
                out.append((start, 6, m.end()))
    return sorted(out)


def redacted(text: str) -> str:
    """The text with a placeholder in place of each span; spans that overlap become one, named by the first."""
    out, at = [], 0
    for start, kind, end in spans_of(text):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (kind, start, end) for each row, sorted by start and then kind; whole texts.

    Null and empty texts have an empty list. Repeated rows and null keys keep their rows; other columns are dropped.
    """
    own_name(key, ["spans"])
    kind = docs.schema[key].dataType.simpleString()
    entry = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, entry)], ["key", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, spans {SPANS}").withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in `text` replaced by placeholders such as <EMAIL>. Null texts stay null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _joined(spans, kinds=None):
    kept = spans if kinds is None else F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(F.col("spans"), BASE), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
