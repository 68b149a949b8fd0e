"""Operator 8: personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, digits, plus signs, schemes and identifier cues; from each such
anchor a local parser expands to the boundaries of an email, address or account and validates it.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

#: Kinds in the order of ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USER = re.compile(r"[^\s/?#@<>\"']+")
HOST = re.compile(r"@[A-Za-z0-9.-]+[^\s<>\"']*")
IBAN = re.compile(r"[\s:=#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})(?![A-Z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|#))?\s{0,2}[:=#]?\s{0,2}([0-9][0-9-]{4,32}[0-9])(?![0-9A-Za-z])", re.IGNORECASE)
SECRET = re.compile(r"\"?\s{0,3}[:=]\s{0,3}([\"']?)(?=[A-Za-z0-9+/_=.~-]{16})")
VALUE = re.compile(r"[A-Za-z0-9+/_=.~-]+")

SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = {"iban": "iban", "account": "account", "acct": "account", "token": "secret", "api_key": "secret", "apikey": "secret", "api-key": "secret", "secret": "secret", "password": "secret", "passwd": "secret"}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for word, kind in [(s, "scheme") for s in SCHEMES] + list(CUES.items()):
        for form in {word, word.upper(), word.capitalize()}:
            found.add_word(form, (kind, len(word)))
    found.make_automaton()
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Finder:
    def __init__(self):
        self.automaton = automaton()

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind's number, end) in code points, by start and kind. Null and empty texts have none.

        Of each base kind the matches are leftmost and do not overlap; a match that validation refuses
        still uses up its characters.
        """
        if not text:
            return []
        out: list[tuple[int, int, int]] = []
        email = ip = card = phone = other = 0  # ends of the last match of each kind
        value = 0  # end of the last secret's value, which may hold more cues and is walked once, however long
        nobody = 0  # no scheme before this place is followed by a user and a host
        last_digit = value_digit = -2
        for at, (kind, width) in self.automaton.iter(text):
            p = at - width + 1
            if kind == "digit":
                if (p != last_digit + 1 or p == ip) and p >= ip and (m := IP.match(text, p)):
                    ip = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                        out.append((p, 1, ip))
                last_digit = p
                if p >= card and (m := CARD.match(text, p)):
                    card = m.end()
                    if 14 <= card - p - m[0].count(" ") - m[0].count("-") <= 19 and luhn(_digits(m[0])):
                        out.append((p, 2, card))
            elif kind == "at":
                start = p
                while start > email and text[start - 1] in LOCAL:
                    start -= 1
                if start < p and (m := DOMAIN.match(text, p)):
                    email = m.end()
                    out.append((start, 0, email))
            elif kind == "plus":
                if p >= phone and (m := PHONE.match(text, p)):
                    phone = m.end()
                    if 10 <= len(_digits(m[0])) <= 15:
                        out.append((p, 3, phone))
            elif p >= other:
                if kind == "scheme":
                    # the run that a user's name may be is walked once, however many schemes it holds
                    if at + 1 >= nobody and (m := USER.match(text, at + 1)):
                        nobody = m.end()
                        if m := HOST.match(text, nobody):
                            other = m.end()
                            out.append((p, 4, other))
                elif kind == "secret":
                    if m := SECRET.match(text, at + 1):
                        if m.end() >= value:
                            value = VALUE.match(text, m.end()).end()
                            value_digit = next((i for i in range(value - 1, m.end() - 1, -1) if "0" <= text[i] <= "9"), -2)
                        if value_digit >= m.end() and (not m[1] or text[value : value + 1] == m[1]):
                            other = value
                            out.append((m.end(), 6, other))
                elif (m := (IBAN if kind == "iban" else ACCOUNT).match(text, at + 1)) and (kind != "iban" or _iban(m[1])):
                    other = m.end(1)
                    out.append((m.start(1), 5, other))
        return sorted(out)


def redact(text: str | None, spans) -> str | None:
    """The text with each span (overlapping ones as one) replaced by the first one's kind in brackets."""
    if not spans:
        return text
    out, done, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_finder: Finder | None = None


def finder() -> Finder:
    global _finder
    _finder = _finder or Finder()
    return _finder


def find(documents: DataFrame) -> DataFrame:
    """doc_id, all spans as structs, and the text without them; one row for each row. Columns but doc_id and text are not read."""

    def run(rows):
        found = [finder().spans(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "spans": [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in s] for s in found], "redacted": [redact(t, s) for t, s in zip(rows["text"], found)]}

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, spans array<struct<kind:string,start:long,stop:long>>, redacted string")


def digest(documents: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text; a null text counts as empty."""

    def run(rows):
        out = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        out["doc_id"] = rows["doc_id"]
        for t in rows["text"]:
            spans = finder().spans(t)
            base = [s for s in spans if s[1] < BASE]
            for k in range(BASE):
                out[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(spans))
        return out

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op8_pii(spark, sf_dir):
    """Null and empty texts have no spans, repeated rows have the same ones, null ids are kept; see Finder.spans()."""
    return digest(table(spark, sf_dir, "documents"))
