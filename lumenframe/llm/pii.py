"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, plus signs, digits, schemes and identifier cues; at each, a
deterministic local parser expands to the boundaries and validates what it finds. Nothing is read twice but what stands round an anchor.

Kinds. email, ip, card and phone follow the base patterns below, leftmost and non-overlapping for each kind: a match that fails its
validation is consumed and dropped. The anchors add: url (a scheme with user and password before its host), account (an IBAN whose
check digits hold; a number of 6 to 17 digits after an account cue) and secret (a value after a password, token or key cue; an access
key id).

Defined results: null and empty texts have no spans, and a null text stays null when redacted. Spans count code points, end exclusive,
ordered by start and then by kind as listed. Repeated rows are searched each. Redaction merges spans that overlap and leaves one tag,
that of the first. An empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import add_columns

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_USERINFO = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_IBAN = re.compile(r"[\s:#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Characters of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_NUMBER = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|#))?\s?[:=#]?\s?([0-9]{6,17})(?![0-9A-Za-z])", re.IGNORECASE)
_VALUE = re.compile(r"\s?[:=]\s?[\"']?([^\s\"']{8,})")
_KEY_ID = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")
#: Cues by kind; each is looked for in lower case, capitalised and in capitals.
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for sign, kind in [("@", "email"), ("+", "phone"), ("://", "url"), ("AKIA", "key_id"), *((d, "digit") for d in "0123456789")]:
        found.add_word(sign, (len(sign), kind))
    for kind, cues in (("iban", ("iban",)), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                found.add_word(form, (len(form), kind))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) << (k & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _iban(found: str, after: str) -> str | None:
    """The account number at the start of what was found, as long as its country's are (of an unknown country, all of it), if its check
    digits hold and no letter or digit follows."""
    size, n = IBAN_LENGTHS.get(found[:2]), 0
    for end, c in enumerate(found, 1):
        n += c != " "
        if n == size:
            found, after = found[:end], found[end:] or after
            break
    packed = found.replace(" ", "")
    whole = len(packed) == size if size else 15 <= len(packed) <= 34
    good = whole and not after[:1].isalnum() and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1
    return found if good else None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span of the text."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    email = ip = card = phone = secret = 0  # where the next match of each kind may start
    for last, (size, kind) in _anchors().iter(text):
        at, after = last - size + 1, last + 1
        if kind == "digit":
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                        out.append(("ip", at, ip))
                else:  # no later start within this run of digits can match either
                    ip = _DIGITS.match(text, at).end()
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, card))
        elif kind == "email":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, after)):
                email = m.end()
                out.append(("email", start, email))
        elif kind == "phone":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", at, phone))
        elif kind == "url":
            start = at
            while start and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _USERINFO.match(text, after)):
                out.append(("url", start, m.end()))
        elif at and text[at - 1].isalnum():
            continue  # a cue within a word
        elif kind == "iban":
            if (m := _IBAN.match(text, after)) and (number := _iban(m[1], text[m.end() : m.end() + 1])):
                out.append(("account", m.start(1), m.start(1) + len(number)))
        elif kind == "account":
            if m := _NUMBER.match(text, after):
                out.append(("account", *m.span(1)))
        elif kind == "secret":
            if at >= secret and (m := _VALUE.match(text, after)):  # a cue within a value is part of it
                secret = m.end(1)
                out.append(("secret", *m.span(1)))
        elif m := _KEY_ID.match(text, after):
            out.append(("secret", at, m.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with a tag such as <EMAIL> in place of each span."""
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with pii: the array of spans of its text."""

    def kernel(texts: list) -> list[list]:
        return [[[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in texts]]

    return add_columns(df, [text], [pa.field("pii", _SPANS)], kernel)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text redacted, in its columns' order."""

    def kernel(texts: list) -> list[list]:
        return [[redact(t, find(t)) for t in texts]]

    return add_columns(df, [text], [pa.field(text, pa.string())], kernel).select(*(F.col(f"`{c}`") for c in df.columns))
