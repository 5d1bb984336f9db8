"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
plus signs, digits, URL schemes and identifier cues. Small deterministic
parsers expand each anchor to both sides and validate what they find:

- email: local part left of an at-sign, dotted labels right of it;
- ip: four dotted numbers, each at most 255;
- card: digits with single blanks or hyphens between, 16 to 19 digits, Luhn;
- phone: plus sign, digits, blanks, brackets, dots, hyphens, 8 to 15 digits;
- account: a value of 8 or more characters with a digit, after a cue such as
  ``token``, ``iban`` or ``passport`` (in any case, ``apiKey`` too) and an
  optional ``no``, ``:`` or ``=``;
- url: an address with a scheme whose authority carries credentials or is
  numeric.

The first four are leftmost, non-overlapping matches per kind. Positions are
code points, end exclusive. A null text is an empty one. No text is cut: a
parser only looks at the anchor's surroundings, so a text of any length takes
linear time.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from spillspark.llm.common import slabs

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url")
SCHEMES = ("http", "https", "ftp", "ssh", "postgres", "mysql", "redis", "mongodb", "amqp")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "iban", "account", "acct", "passport", "ssn")

DIGITS = frozenset("0123456789")
_LOWER = {c: c + 32 for c in range(65, 91)}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIALLED = re.compile(r"[\x20().0-9-]+")
VALUE = re.compile(r"(?:[ _-]?(?:no|number|id|key))?\.?[ \t]*[:=#]?[ \t]*[\"']?([A-Za-z0-9][A-Za-z0-9_/+.-]{6,}[A-Za-z0-9])")
NUMERIC_HOST = re.compile(r"[0-9]+(?:\.[0-9]+){3}(?::[0-9]+)?")
AUTHORITY = re.compile(r"[^\s/?#<>\"']+")
REST = re.compile(r"[^\s<>\"']*")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Anchors by kind, for texts in lower case."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", (":", 3))
    for d in DIGITS:
        a.add_word(d, ("0", 1))
    for cue in CUES:
        a.add_word(cue, ("cue", len(cue)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """``text`` in lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of each kind's spans, in order."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended
    number_end = -1  # end of the digit run seen last
    for last, (kind, size) in automaton().iter(lowered(text)):
        at = last - size + 1
        if kind == "0":
            if at < number_end:
                continue
            number_end = _digits(text, at)
            if at >= free["ip"]:
                _ip(text, at, number_end, spans["ip"], free)
            if at >= free["card"]:
                _card(text, at, spans["card"], free)
        elif kind == "@":
            _email(text, at, spans["email"], free)
        elif kind == "+":
            if at >= free["phone"]:
                _phone(text, at, spans["phone"], free)
        elif kind == "cue":
            _account(text, at, last + 1, spans["account"], free)
        else:
            _url(text, at, spans["url"], free)
    return spans


def _digits(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in DIGITS:
        at += 1
    return at


def _ip(text: str, at: int, end: int, out: list, free: dict) -> None:
    parts = [text[at:end]]
    while len(parts) < 4 and text[end : end + 1] == "." and text[end + 1 : end + 2] in DIGITS and end + 1 < len(text):
        stop = _digits(text, end + 1)
        parts.append(text[end + 1 : stop])
        end = stop
    if len(parts) == 4:
        free["ip"] = end
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append((at, end))


def _card(text: str, at: int, out: list, free: dict) -> None:
    end = _digits(text, at)
    while text[end : end + 1] in (" ", "-") and end + 1 < len(text) and text[end + 1] in DIGITS:
        end = _digits(text, end + 1)
    if end - at >= 2:
        free["card"] = end
        digits = text[at:end].replace(" ", "").replace("-", "") if end - at <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((at, end))


def _email(text: str, at: int, out: list, free: dict) -> None:
    start = at
    while start > free["email"] and text[start - 1] in LOCAL_CHARS:
        start -= 1
    if start < at and (m := DOMAIN.match(text, at + 1)):
        out.append((start, m.end()))
        free["email"] = m.end()


def _phone(text: str, at: int, out: list, free: dict) -> None:
    if at + 1 >= len(text) or text[at + 1] not in DIGITS or not (m := DIALLED.match(text, at + 2)):
        return
    end = m.end()
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return
    free["phone"] = end
    if 8 <= sum(c in DIGITS for c in text[at:end]) <= 15:
        out.append((at, end))


def _account(text: str, at: int, end: int, out: list, free: dict) -> None:
    if at and (text[at - 1].isalnum()) or not (m := VALUE.match(text, end)):
        return
    start, stop = m.span(1)
    if start >= free["account"] and start > end and any(c in DIGITS for c in m[1]):
        out.append((start, stop))
        free["account"] = stop


def _url(text: str, at: int, out: list, free: dict) -> None:
    start = at
    while start > free["url"] and at - start < 12 and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    if text[start:at].lower() not in SCHEMES or not (m := AUTHORITY.match(text, at + 3)):
        return
    if "@" in m[0] or NUMERIC_HOST.fullmatch(m[0]):
        end = REST.match(text, m.end()).end()
        out.append((start, end))
        free["url"] = end


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """kind:start:end, by kind as listed, then start."""
    return ",".join([f"{k}:{a}:{b}" for k in kinds for a, b in spans[k]])


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind in brackets.

    Where spans of two kinds overlap, the one that starts first names the
    mask, which covers both.
    """
    found = sorted((a, b, k) for k in KINDS for a, b in spans[k])
    out, at, i = [], 0, 0
    while i < len(found):
        a, end, kind = found[i]
        i += 1
        while i < len(found) and found[i][0] < end:
            end = max(end, found[i][1])
            i += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of the base kinds, digest, spans, masked.

    ``base_sha256`` digests the base spans, ``spans`` lists all, ``masked`` is
    the text without them (null stays null, and has no spans; so have empty
    texts). Texts may be of any length and are read whole. Spans of one kind never
    overlap, the leftmost counts. Empty tables give empty results; repeated rows
    and ids are judged one by one; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            counts: list[list[int]] = [[], [], [], []]
            digests, listed, clean = [], [], []
            for text in batch.column("text").to_pylist():
                spans = find(text or "")
                for c, k in zip(counts, BASE, strict=True):
                    c.append(len(spans[k]))
                digests.append(hashlib.sha256(joined(spans, BASE).encode()).hexdigest())
                listed.append(joined(spans, KINDS))
                clean.append(masked(text, spans) if listed[-1] else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(clean, pa.string())],
                ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "masked"],
            )

    made = StructType.fromDDL("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, masked string")
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *made.fields])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
