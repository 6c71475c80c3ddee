"""Personal data in whole texts, found by expanding anchors.

One Aho-Corasick automaton walks a text and stops at anchors only: at-signs,
signs of a phone number, digits that meet (at most one space, hyphen or dot
between), schemes of addresses, and cue words of identifiers.  At each anchor a
deterministic parser reads outwards to the span's two ends and validates it.

Base kinds, leftmost and non-overlapping within a kind:

* ``email``: from an at-sign, right over a domain of two labels or more, left
  over the local part, back to the last email's end at most.
* ``ip``: from digits around a dot, the whole dotted chain of numbers, cut into
  fours; parts are at most 255.
* ``card``: from two digits, the maximal run; 12 to 19 digits that pass Luhn.
* ``phone``: from a plus and a digit; 9 to 15 digits.

Further kinds, which never displace those:

* ``mailbox``: an address with letters beyond ASCII, of which ``email`` holds
  a part or nothing.  Local part up to 64 characters, domain up to 255, a last
  label of two letters or more.
* ``login``: ``user:password`` between a scheme and an at-sign.
* ``secret``: what a cue such as ``token`` or ``api_key`` is set to by ``:`` or
  ``=``: 16 to 4,096 characters, letters and digits, at least 8 different ones.
* ``iban``: after its cue, the longest run of groups that passes modulo 97.
* ``account``: 6 to 17 digits after a cue such as ``account no``.
* ``ssn``: after its cue, three, two and four digits in the ranges that are given out.

A cue counts in lower, upper or title case where no letter or digit stands
before it.  Positions are code points, ends exclusive.

Edge cases.  A null text counts as empty and has no spans.  Repeated rows are
searched alike.  A text has any length: parsers go on from where the last one
ended, and look back in small steps, so time and memory are linear in it.  Other
columns pass through unchanged, except one with an output's name, which is
replaced.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mailbox", "login", "secret", "iban", "account", "ssn")
_DIGITS = "0123456789"
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _DIGITS + "._%+-"
#: Cue words by the kind they announce.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key", "client_secret"),
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security"),
}

# possessive where the longest match is the only one, so that long runs keep no states
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_NUMBER = re.compile(r"[0-9]+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDE_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-])")
_WIDE_LOCAL = re.compile(r"[\w.%+-]+\Z")
_LOGIN = re.compile(r"[^\s/?#@:\[\]]+:[^\s/?#@]+(?=@[A-Za-z0-9\[])")
_SECRET = re.compile(r"[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9_./+=~-]{16,4096}+)(?![A-Za-z0-9_./+=~-])")
_IBAN = re.compile(r"(?:\s(?:no|number))?[\s.:=#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s(?:no|number|id|nr))?[.:=#\s]{1,4}([0-9]{6,17})(?![A-Za-z0-9-])")
_SSN = re.compile(r"(?:\s(?:no|number))?[\s.:=#]{0,4}(([0-9]{3})-([0-9]{2})-([0-9]{4}))(?![0-9-])")


@functools.cache
def automaton():
    """The automaton of all anchors (kept per worker)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for d in _DIGITS:
        found.add_word("+" + d, ("phone", 2))
        for e in _DIGITS:
            found.add_word(f"{d}.{e}", ("ip", 3))
            for sign in ("", " ", "-"):
                found.add_word(d + sign + e, ("card", 2 + len(sign)))
    for kind, words in CUES.items():
        for word in words:
            for x in {word, word.upper(), word.title(), word.capitalize()}:
                found.add_word(x, (kind, len(x)))
    found.make_automaton()
    return found


def back(text: str, at: int, floor: int, signs: str, step: int = 64) -> int:
    """Where the run of ``signs`` that ends at ``at`` begins, ``floor`` at least."""
    while at > floor:
        part = text[max(floor, at - step) : at]
        left = len(part.rstrip(signs))
        at -= len(part) - left
        if left:
            break
    return at


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _iban(text: str) -> int:
    """Length of the longest part, ending with a group, that passes modulo 97; 0 if none does."""
    ends = [m.start() for m in re.finditer(" ", text)] + [len(text)]
    for end in reversed(ends):
        signs = text[:end].replace(" ", "")
        if 15 <= len(signs) <= 34 and int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1:
            return end
    return 0


def _cued(kind: str, text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at ``at``."""
    if kind == "secret":
        m = _SECRET.match(text, at)
        value = m[1] if m else ""
        if len(set(value)) >= 8 and re.search("[0-9]", value) and re.search("[A-Za-z]", value):
            return m.span(1)
    elif kind == "iban":
        m = _IBAN.match(text, at)
        if m and (n := _iban(m[1])):
            return m.start(1), m.start(1) + n
    elif kind == "account":
        m = _ACCOUNT.match(text, at)
        return m.span(1) if m else None
    else:
        m = _SSN.match(text, at)
        if m and m[2] not in ("000", "666") and m[2] < "900" and m[3] != "00" and m[4] != "0000":
            return m.span(1)
    return None


def _mailbox(text: str, at: int, floor: int) -> tuple[int, int] | None:
    m = _WIDE_DOMAIN.match(text, at + 1, at + 1 + 256)
    local = _WIDE_LOCAL.search(text[max(floor, at - 65) : at])
    if not m or not local or len(local[0]) > 64 or m.end() - at > 256:
        return None
    start = at - len(local[0])
    return None if text[start : m.end()].isascii() else (start, m.end())


def find(text: str) -> list[tuple[int, str, int]]:
    """Start, kind and end of all spans, by start, then kind as listed."""
    spans: list[tuple[int, str, int]] = []
    emails = boxes = chains = runs = secrets = 0  # where the last of each ended
    for last, (kind, size) in automaton().iter(text):
        first = last - size + 1
        if kind == "card":
            if first >= runs:
                run = _RUN.match(text, first)
                runs, digits = run.end(), _digits(run[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((first, kind, runs))
        elif kind == "ip":
            if first >= chains:
                chain = _CHAIN.match(text, back(text, first, chains, _DIGITS))
                chains, parts = chain.end(), [m.span() for m in _NUMBER.finditer(text, chain.start(), chain.end())]
                for k in range(0, len(parts) - 3, 4):
                    if all(len(x) < 4 and int(x) < 256 for x in (text[a:b].lstrip("0") or "0" for a, b in parts[k : k + 4])):
                        spans.append((parts[k][0], kind, parts[k + 3][1]))
        elif kind == "phone":
            m = _PHONE.match(text, first)
            if m and 9 <= len(_digits(m[0])) <= 15:
                spans.append((first, kind, m.end()))
        elif kind == "at":
            m = _DOMAIN.match(text, last + 1)
            start = back(text, last, emails, _LOCAL) if m else last
            if start < last:
                emails = m.end()
                spans.append((start, "email", emails))
            wide = _mailbox(text, last, boxes)
            if wide:
                boxes = wide[1]
                spans.append((wide[0], "mailbox", wide[1]))
        elif kind == "scheme":
            m = _LOGIN.match(text, last + 1)
            if m and first and text[first - 1].isalnum():
                spans.append((m.start(), "login", m.end()))
        elif first == 0 or not text[first - 1].isalnum():
            m = None if kind == "secret" and last < secrets else _cued(kind, text, last + 1)
            if m:
                secrets = m[1] if kind == "secret" else secrets
                spans.append((m[0], kind, m[1]))
    rank = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(set(spans), key=lambda s: (s[0], rank[s[1]], s[2]))


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """``text`` with each span as ``<kind>``; of spans that overlap the first stands for all."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def personal_data(documents: DataFrame, text: str = "text", spans: str = "spans", redacted: str | None = None) -> DataFrame:
    """Add ``spans``, and the text without them as ``redacted`` if a name is given."""
    added = {spans: SPAN} | ({redacted: T.StringType()} if redacted else {})
    schema = T.StructType([*(f for f in documents.schema.fields if f.name not in added), *(T.StructField(n, t) for n, t in added.items())])

    def run(batches):
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            found = [find(x) for x in texts]
            columns = {n: batch.column(n) for n in batch.schema.names if n not in added}
            columns[spans] = pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in some] for some in found], _ARROW)
            if redacted:
                columns[redacted] = pa.array([redact(x, some) for x, some in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return documents.mapInArrow(run, schema)
