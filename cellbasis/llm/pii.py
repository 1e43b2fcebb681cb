"""Personal data by anchor expansion: an automaton finds anchors, local parsers expand and validate around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellbasis.llm.common import ready

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the anchors add to the four base kinds.
ADDED = ("iban", "account", "login", "veiled", "secret", "street")
_ORDER = {k: i for i, k in enumerate(KINDS + ADDED)}

# The cues that anchor the added kinds, in lower case; they are sought in a lower-cased copy.
CUES = {
    "iban": "iban",
    "ssn": "account",
    "social security": "account",
    "account": "account",
    "passport": "account",
    "://": "login",
    "(at)": "veiled",
    "[at]": "veiled",
    "token": "secret",
    "secret": "secret",
    "password": "secret",
    "passwd": "secret",
    "api key": "secret",
    "api_key": "secret",
    "api-key": "secret",
    "apikey": "secret",
    "access key": "secret",
    "access_key": "secret",
    "private key": "secret",
    "private_key": "secret",
    "credential": "secret",
    "bearer": "secret",
    " street": "street",
    " avenue": "street",
    " road": "street",
    " lane": "street",
    " boulevard": "street",
    "straße": "street",
    "strasse": "street",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\s:.#]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[\x20_-]?(?:security|number|num|no|nr|id))?[\s:.#=-]{0,4}((?:[A-Z]{1,3}[\x20-]?)?[0-9](?:[\x20-]?[0-9])+)(?![A-Za-z0-9])", re.IGNORECASE)
_LOGIN = re.compile(r"[^\s:/?#@]+:[^\s/?#@]+(?=@)")
_VEILED_RIGHT = re.compile(r"\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)+", re.IGNORECASE)
#: After a cue: the rest of the identifier, a separator, and a value in quotes or bare.
_SECRET = re.compile(r"[\w-]*[\"']?(\s*(?:=>|:=|=|:)\s*|\x20(?:is\x20)?)(?:(?:bearer|basic)\x20)?[\"']?([A-Za-z0-9+/_.~$!%^&*-]+=*)", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[\w-]*")
_STREET_LEFT = re.compile(r"(?<![0-9A-Za-z])[0-9]+[A-Za-z]?(?:\x20[A-Z][^\W\d_]*\.?){1,4}$")
_STREET_RIGHT = re.compile(r"\x20[0-9]+[A-Za-z]?(?![0-9A-Za-z])")
_STREET_NAME = 200  # characters that house number and name before a cue may take

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, found boolean"


def anchors() -> ahocorasick.Automaton:
    """At-signs, plus signs, digits and cues."""
    out = ahocorasick.Automaton()
    for c in "0123456789":
        out.add_word(c, ("digit", 1))
    out.add_word("@", ("email", 1))
    out.add_word("+", ("phone", 1))
    for cue, kind in CUES.items():
        out.add_word(cue, (kind, len(cue)))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """`text` in lower case with every character at its place: the one capital whose lower case is two code points goes first."""
    return text.replace("\u0130", "i").lower()


def is_secret(value: str, assigned: bool) -> bool:
    """Whether the value after a cue is no plain word: 8 characters with a digit where it is assigned, else 16 with a digit and a letter."""
    digit = any(c.isdigit() for c in value)
    return digit and (len(value) >= 8 if assigned else len(value) >= 16 and any(c.isalpha() for c in value))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans of `text` by start, then kind. Each kind's matches are leftmost and do not overlap; what fails
    validation is used up all the same."""
    out: list[tuple[int, int, str]] = []
    used = {"email": 0, "ip": 0, "card": 0, "phone": 0}
    named = 0
    for last, (kind, size) in automaton.iter(lowered(text)):
        at = last - size + 1
        if kind == "digit":
            if at >= used["card"]:
                m = _CHAIN.match(text, at)
                if m:
                    used["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, m.end(), "card"))
            if at >= used["ip"]:
                m = _IP.match(text, at)
                if m:
                    used["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                        out.append((at, m.end(), "ip"))
                else:  # no later start within this run of digits can do better
                    used["ip"] = _RUN.match(text, at).end()
        elif kind == "email":
            first = at
            while first > used["email"] and text[first - 1] in _LOCAL:
                first -= 1
            m = _DOMAIN.match(text, at + 1) if first < at else None
            if m:
                used["email"] = m.end()
                out.append((first, m.end(), "email"))
        elif kind == "phone":
            m = _PHONE.match(text, at) if at >= used["phone"] else None
            if m:
                used["phone"] = m.end()
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((at, m.end(), "phone"))
        elif kind == "iban":
            m = _IBAN.match(text, last + 1)
            if m and _mod97(m.group(1)):
                out.append((*m.span(1), "iban"))
        elif kind == "account":
            m = _ACCOUNT.match(text, last + 1)
            if m and sum(c.isdigit() for c in m.group(1)) >= 6:
                out.append((*m.span(1), "account"))
        elif kind == "login":
            m = _LOGIN.match(text, last + 1)
            if m:
                out.append((*m.span(), "login"))
        elif kind == "secret":
            if at < named:  # inside the identifier or the value that an earlier cue has led to
                continue
            m = _SECRET.match(text, last + 1)
            named = m.end() if m else _IDENTIFIER.match(text, last + 1).end()
            if m and is_secret(m.group(2), bool(m.group(1).strip("\x20is"))):
                out.append((*m.span(2), "secret"))
        elif kind == "street":
            left = _STREET_LEFT.search(text, max(0, at - _STREET_NAME), at)
            m = _STREET_RIGHT.match(text, last + 1)
            if left:
                out.append((left.start(), last + 1, "street"))
            elif m:
                first = last + 1
                while first > max(0, at - _STREET_NAME) and (text[first - 1].isalpha() or first > at):
                    first -= 1
                out.append((first, m.end(), "street"))
        else:
            first = at - (text[max(0, at - 1) : at] == " ")
            end = first
            while first > 0 and text[first - 1] in _LOCAL:
                first -= 1
            m = _VEILED_RIGHT.match(text, last + 1) if first < end else None
            if m:
                out.append((first, m.end(), "veiled"))
    return sorted(set(out), key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def digest_row(doc_id, text: str | None, automaton) -> tuple:
    spans = find(text, automaton) if text else []
    base = [s for s in spans if s[2] in KINDS]
    say = lambda some: ",".join(f"{k}:{a}:{b}" for a, b, k in some)
    counts = [sum(s[2] == k for s in base) for k in KINDS]
    return doc_id, *counts, hashlib.sha256(say(base).encode()).hexdigest(), say(spans), len(spans) - len(base), bool(spans)


_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("found", pa.bool_())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = anchors()
    for batch in batches:
        rows = [digest_row(i, t.as_py(), automaton) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: counts of the four base kinds, their digest, all spans, how many are of the added kinds
    (account numbers, logins, veiled addresses, secrets, streets), and whether there is any.

    A span is kind:start:end in code points of the whole text, end exclusive. Null and empty texts have no spans (and the
    digest of an empty list). Rows repeated in `docs` give repeated rows; null ids stay null; an empty table gives an
    empty result; other columns are ignored. Each text is scanned once, in time linear in its length, and nothing is
    shuffled.
    """
    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run, SCHEMA)
