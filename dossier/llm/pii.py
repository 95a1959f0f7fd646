"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, digits before a dot, ``://``, identifier
cues, country codes of account numbers) in one pass over each text. At an anchor a local parser finds the boundaries to the left and right and
validates what it has found. No pattern is searched through a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import pieces

#: Kinds in their order; the first four have the fixed definition, the others are the method's.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "account", "url_login")

SPANS = "array<struct<kind: string, start: int, end: int, value: string>>"

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE_GAP = re.compile(r"(?:\x20?(?:no|nr|number))?[\x20:#=.]{0,4}")
#: Characters of an international account number by country code.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_BLOCK = re.compile(r"\x20?[A-Z0-9]")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"[0-9]{6,17}(?![0-9])")
#: Of any length. It never passes a slash and each ``://`` has two, so that all scans of a text together are linear.
_LOGIN = re.compile(r"[^\s/?#@:]++:[^\s/?#@]++@")
_CUES = {"ssn": "ssn", "account": "account", "acct": "account"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_end(text: str, start: int) -> int:
    """Where the account number ends that begins with a country code at ``start``; -1 if there is none.

    The country gives the number of characters, with at most one space before each. A number that goes on without a
    space is none; a word or number behind a space is not part of it.
    """
    size, at = IBAN_LENGTHS.get(text[start : start + 2]), start + 2
    if not size or not text[at : at + 2].isdigit() or not text[at : at + 2].isascii():
        return -1
    plain = text[start:at]
    while len(plain) < size:
        m = _IBAN_BLOCK.match(text, at)
        if not m:
            return -1
        plain, at = plain + text[m.end() - 1], m.end()
    if text[at : at + 1].isalnum():
        return -1
    return at if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1


def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in _DIGITS:
        found.add_word(c, "digit")
        found.add_word(c + ".", "dot")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for country in IBAN_LENGTHS:
        for digit in _DIGITS:
            found.add_word(country + digit, "iban")
    for cue, kind in _CUES.items():
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, kind)
    found.make_automaton()
    return found


def find_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by kind, then start; offsets in code points, end exclusive."""
    spans: list[tuple[str, int, int]] = []
    email = ip = card = phone = 0  # where the last match of each kind ended
    for at, kind in automaton.iter(text):
        if kind == "digit":
            if at >= card:
                m = _CARD.match(text, at)
                card = m.end() if m else at + 1
                if m and card - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", at, card))
        elif kind == "dot":
            start = at
            while start > ip and text[start - 1] in _DIGITS:
                start -= 1
            if start < at and (m := _IP.match(text, start)):
                ip = m.end()
                if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m.groups()):
                    spans.append(("ip", start, ip))
        elif kind == "at":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                spans.append(("email", start, email))
        elif kind == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    spans.append(("phone", at, phone))
        elif kind == "scheme":
            if m := _LOGIN.match(text, at + 1):
                spans.append(("url_login", at + 1, m.end() - 1))
        elif kind == "iban":
            start = at - 2
            if (not start or not text[start - 1].isalnum()) and (end := iban_end(text, start)) > 0:
                spans.append(("iban", start, end))
        else:
            if kind == "ssn" and at >= 3 and text[at - 3].isalnum():
                continue
            start = _CUE_GAP.match(text, at + 1).end()
            m = {"ssn": _SSN, "account": _ACCOUNT}[kind].match(text, start)
            if m:
                spans.append((kind, start, m.end()))
    spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return list(dict.fromkeys(spans))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id and ``spans`` (kind, start, end, value), by kind and start.

    A null text is empty and has no spans. Rows are handled one by one (equal or null ids are no matter), whole
    texts of any length are read, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for piece in pieces(batches, "text"):
            found = []
            for text in piece.column("text"):
                text = text.as_py() or ""
                found.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in find_spans(text, automaton)])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found, type=kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
