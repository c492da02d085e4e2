"""Personal data: exact base patterns plus offset-preserving deobfuscation.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers as
written.  Disguised ones are found by three transducers, each of which rewrites a text
and keeps, for every character it emits, the source span that the character stands for:

1. look-alike letters and digits to ASCII, invisible characters dropped;
2. bracketed ``at`` and ``dot`` to ``@`` and ``.``;
3. chains of spelled digits, also mixed with written ones and with spelled dots, to
   digits, ``plus`` before such a chain to ``+``; then written-out ``at`` and ``dot``.

The maps are composed, the base patterns run on the rewritten text, and whatever is
found there is mapped back to source characters.  A span that a transducer touched and
that meets no base span of its kind is added; base spans always stay.

Edge cases: null or empty text has no spans; a text of any length is scanned whole, in
time linear in its length; touching spans are separate; repeated rows give repeated
results; columns besides id and text, whatever their names, are not read; an empty table
gives no rows.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .frames import map_arrow, table

KINDS = ("email", "ip", "card", "phone")
#: Chains of fewer digits are no card or phone and stay, but for the dotted numbers of an address.
LEAST_SPELLED = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A failed start inside a digit run fails everywhere in that run, hence the possessive parts.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    """Each ``@`` is tried once, with all of the local part before it that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns, in that order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in _ips(text)] if "." in text else []
        found += [(a, 2, b) for a, b in _cards(text)]
        found += [(a, 3, b) for a, b in _phones(text)] if "+" in text else []
    found.sort()
    return found


# Letters that look like ASCII ones, and characters that show nothing.
_ALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοριτνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。｡", "aeopcyxijshdqwABEKMHOPCTYXIJSaopitvABEZHIKMNOPTYX..."))
_HIDDEN = "­​‌‍⁠﻿"
_ODD = re.compile("[­Ͱ-ԯ٠-٩۰-۹०-९​-‍․⁠-⁡⁰-₉①-⓿。﹒﹫﻿！-･\U0001d400-\U0001d7ff]")

# Digits zero to nine as words.
_SPELLED = [
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
]
_DIGIT_WORD = {w: str(k) for line in _SPELLED for k, w in enumerate(line.split())} | {"oh": "0"}
_WORD = "(?:" + "|".join(sorted(_DIGIT_WORD, key=lambda w: (-len(w), w))) + ")"
_POINT = r"\s+(?:dot|punkt|punto|point)\s+"
_ITEM, _BETWEEN = rf"(?:{_WORD}|[0-9]++)(?!\w)", rf"(?:{_POINT}|[\s,.-]{{1,3}})"
_PAREN = rf"\({_ITEM}(?:{_BETWEEN}{_ITEM})*+\)"
_CHAIN = re.compile(rf"(?<!\w)(?:plus[\s-]+|\+\s*)?(?:{_ITEM}|{_PAREN})(?:{_BETWEEN}(?:{_ITEM}|{_PAREN}))*+", re.I)
_CHAIN_PART = re.compile(rf"(?P<plus>(?:plus[\s-]+|\+\s*))|(?P<word>{_WORD})|(?P<digits>[0-9]+)|(?P<paren>[()])|(?P<dot>{_POINT}|\.|\s\.\s)(?=[0-9]|{_WORD})|(?P<gap>[\s,.-]+)", re.I)
# Ignoring case, patterns also take these letters for s and i.
_CASE = str.maketrans("ſıİ", "sii")

_AT, _DOT = r"(?:at|ät|arroba|arobase|@)", r"(?:dot|punkt|punto|point|\.)"
_BRACKETED = re.compile(rf"\s*[\[({{<]\s*({_AT}|{_DOT})\s*[\])}}>]\s*", re.I)
_NAME = r"[A-Za-z0-9-]+"
_WRITTEN = re.compile(rf"(?<=[A-Za-z0-9])\s+(?:at|ät|arroba|arobase)\s+(?={_NAME}(?:\s+(?:dot|punkt|punto|point)\s+|\.){_NAME})|(?<=[A-Za-z0-9])\s+(?:dot|punkt|punto|point)\s+(?=[A-Za-z])", re.I)


class Tape:
    """A rewritten text; character k stands for source characters ``first[k]`` to ``last[k]`` (exclusive)."""

    def __init__(self, text: str):
        self.text = text
        self.first = np.arange(len(text))
        self.last = self.first + 1
        self.touched = np.zeros(len(text), bool)

    def rewrite(self, pattern: re.Pattern, emit: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> None:
        """Replace each match by what ``emit`` gives: characters with the spans of this tape that they stand for.

        A match for which it gives None stays.
        """
        text, first, last, touched = [], [], [], []
        at = 0

        def keep(a: int, b: int) -> None:
            text.append(self.text[a:b])
            first.append(self.first[a:b])
            last.append(self.last[a:b])
            touched.append(self.touched[a:b])

        for m in pattern.finditer(self.text):
            if (now := emit(m)) is None:
                continue
            keep(at, m.start())
            for c, a, b in now:
                text.append(c)
                first.append(self.first[a : a + 1])
                last.append(self.last[b - 1 : b])
                touched.append(np.ones(1, bool))
            at = m.end()
        if at:
            keep(at, len(self.text))
            self.text = "".join(text)
            self.first, self.last, self.touched = map(np.concatenate, (first, last, touched))


def _fold(m: re.Match) -> list[tuple[str, int, int]]:
    c = m.group()
    plain = "" if c in _HIDDEN else _ALIKE.get(c) or unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and not plain.isascii() and plain.isdigit():
        plain = str(unicodedata.digit(plain))
    if plain and (len(plain) != 1 or not plain.isascii()):
        plain = c
    return [(plain, m.start(), m.end())] if plain else []


def _digits(m: re.Match) -> list[tuple[str, int, int]] | None:
    """A chain in digits, or None where it has nothing spelled or is too short for any identifier.

    Gaps at spelled digits go, but the dots of an IPv4 address and all spelled dots stay.
    """
    parts = [(p.lastgroup, p.group(), m.start() + p.start(), m.start() + p.end()) for p in _CHAIN_PART.finditer(m.group())]
    words = sum(kind == "word" for kind, *_ in parts)
    points = sum(kind == "dot" and len(w) > 3 for kind, w, *_ in parts)
    digits = words + sum(len(w) for kind, w, *_ in parts if kind == "digits")
    if not words + points or (digits < LEAST_SPELLED and sum(kind == "dot" for kind, *_ in parts) < 3):
        return None
    pieces, part = [], []
    for k, (kind, w, *_) in enumerate(parts):
        part.append(k)
        if kind == "gap" and ("," in w or "." in w or "\n" in w):
            pieces.append(part)
            part = []
    address = set()
    for part in [*pieces, part]:
        inner = [k for k in part if k < part[-1] or parts[k][0] != "gap"]
        groups = [0]
        for k in inner:
            kind, w = parts[k][:2]
            if kind == "dot":
                groups.append(0)
            groups[-1] += 1 if kind == "word" else len(w) if kind == "digits" else 0
        if len(groups) == 4 and all(1 <= n <= 3 for n in groups):
            address.update(inner, (part[0] - 1, part[-1]))
    out = []
    for k, (kind, w, a, b) in enumerate(parts):
        if kind == "plus":
            out.append(("+", a, b))
        elif kind == "word":
            out.append((_DIGIT_WORD[w.translate(_CASE).lower()], a, b))
        elif kind == "dot" and (len(w) > 3 or k in address):
            out.append((".", a, b))
        elif kind in ("digits", "paren") or (k in address and ("," in w or "." in w or "\n" in w)) or "word" not in (parts[k - 1][0], parts[k + 1][0]):
            out += [(c, a + j, a + j + 1) for j, c in enumerate(w)]
    return out


def _sign(m: re.Match) -> list[tuple[str, int, int]]:
    w = (m.group(1) if m.re is _BRACKETED else m.group().strip()).translate(_CASE).lower()
    return [("@" if w in ("at", "ät", "arroba", "arobase", "@") else ".", m.start(), m.end())]


def deobfuscate(text: str) -> Tape | None:
    """The rewritten text, or None where no transducer has anything to do."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_ODD, _fold)
    tape.rewrite(_BRACKETED, _sign)
    tape.rewrite(_CHAIN, _digits)
    tape.rewrite(_WRITTEN, _sign)
    return tape if tape.touched.any() or len(tape.text) < len(text) else None


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base plus mapped-back spans."""
    base = base_spans(text)
    tape = deobfuscate(text)
    if tape is None:
        return base, base
    found = list(base)
    for a, kind, b in base_spans(tape.text):
        s, e = int(tape.first[a]), int(tape.last[b - 1])
        rewritten = tape.touched[a:b].any() or e - s != b - a
        if rewritten and not any(k == kind and s < y and x < e for x, k, y in base):
            found.append((s, kind, e))
    found.sort()
    return base, found


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with ``base`` and ``spans``, arrays of (kind, start, end)."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = W.column(batch, "text")
        for a, b in W.slices(texts, 8 << 20):
            both = [all_spans(t) for t in texts.slice(a, b - a).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], names=["doc_id", "base", "spans"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    span = "array<struct<kind:string,start:int,end:int>>"
    return map_arrow(kept, rows, f"doc_id {dict(kept.dtypes)['doc_id']}, base {span}, spans {span}")


def listed(spans: str) -> F.Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    of = lambda kind: lambda s: s["kind"] == kind
    count = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.size("spans").cast("long").alias("n_spans"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
