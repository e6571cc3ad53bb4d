"""Personal data in whole texts, also where it is disguised, with places in the text as it came.

*Plain* identifiers are found in the text itself. For *disguised* ones a text goes through a row of transducers, each of which rewrites what
it knows and keeps where every piece of its output came from:

1. invisible characters go;
2. letters, digits and signs of other shapes become the ASCII ones they look like;
3. written-out signs (``%40``, ``&#64;``, ``[at]``, ``(dot)``, ``hxxp``-style ``[.]``), and bare ``at`` and ``dot`` where both stand in one address;
4. digits in words, two or more in a row or behind a plus, and a spoken plus;
5. letters that stand in for digits inside a long number.

The identifiers of the rewritten text are mapped back through the transducers, last one first, to characters of the source. Text that no
transducer touches has no disguise, so a text without any rewriting is scanned once. All scans are linear in the length of a text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import documents_of, keyed
from lakeweave.llm.tokens import slices

#: The kinds in the order of every list.
KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]

# Plain identifiers. Each pattern is scanned in one pass; what it cannot tell is told by the code behind it.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[Span]:
    """``local@host.host``: the host decides, then the local part is all that may belong to it back to the email before."""
    out, free = [], 0
    for m in _HOST.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            free = m.end()
    return out


def addresses(text: str) -> list[Span]:
    """Four numbers with dots between them; a longer chain of numbers is cut into fours from its start."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    """Chains of 13 to 19 digits, single blanks or hyphens between them, with a right check digit."""
    out = []
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NO_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    """A plus and 9 to 15 digits, with blanks, brackets, dots and hyphens between them."""
    if "+" not in text:
        return []
    return [m.span() for m in _PLUS.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15]


def identifiers(text: str) -> dict[str, list[Span]]:
    """Plain identifiers of each kind, leftmost first and without overlaps within a kind."""
    digits = _NUMBER.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": addresses(text) if digits else [], "card": cards(text) if digits else [], "phone": phones(text) if digits else []}


# Transducers. Each takes a text and gives the rewritten one with the pieces it rewrote: (from, to) in the source and in the output.


class Rewritten:
    """A text with its way back. Pieces are ordered; between them characters stand for themselves."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int]]):
        self.text = text
        self.starts = [p[2] for p in pieces]
        self.pieces = pieces

    def source(self, span: Span) -> Span:
        """Characters of the source that made the characters ``span`` of the output. A piece is taken whole."""
        return self._place(span[0], 0), self._place(span[1] - 1, 1) + 1

    def _place(self, at: int, end: int) -> int:
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return at
        a, b, out_a, out_b = self.pieces[k]
        if at < out_b:
            return b - 1 if end else a
        return at - out_b + b


def rewrite(text: str, pattern: re.Pattern, answer) -> Rewritten | None:
    """Each match of a pattern replaced by what ``answer`` gives for it (None: left as it is). None if nothing changes.

    An answer of the length of its match stands character for character.
    """
    parts, pieces, done, size = [], [], 0, 0
    for m in pattern.finditer(text):
        new = answer(m)
        if new is None:
            continue
        parts += [text[done : m.start()], new]
        size += m.start() - done
        if len(new) != m.end() - m.start():
            pieces.append((m.start(), m.end(), size, size + len(new)))
        size += len(new)
        done = m.end()
    if not parts:
        return None
    parts.append(text[done:])
    return Rewritten("".join(parts), pieces)


# Characters without a width, and letters of other scripts that look like a Latin one.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]+")
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ι": "i", "ν": "v", "ρ": "p", "ı": "i", "ɑ": "a", "ɡ": "g",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".",
}


def _shapes() -> dict[int, str]:
    """What every character looks like in ASCII, if it is one character: digits of any script by value, others by their compatible form."""
    table = {ord(c): a for c, a in LOOKALIKES.items()}
    for code in range(0x80, 0x20000):
        char = chr(code)
        digit = unicodedata.digit(char, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
        if len(plain) == 1 and " " <= plain < "\x7f":
            table.setdefault(code, plain)
    return table


SHAPES = _shapes()

# Signs in writing.
_SPACE = r"[ \t]{0,3}"
_APART = r"(?:[ \t]{1,3}|[_-])"
_DOT_IN = rf"{_SPACE}[\[({{<]{_SPACE}(?:dot|punkt|punto|point|\.){_SPACE}[\])}}>]{_SPACE}"
_AT_IN = rf"{_SPACE}[\[({{<]{_SPACE}(?:at|arroba|@){_SPACE}[\])}}>]{_SPACE}"
_DOT_OUT = rf"{_APART}dot{_APART}"
_LABEL = r"[A-Za-z0-9-]{1,63}"
# Bare words, and blanks around the sign, count only where the address goes on with a dot; a bare "at" asks for a dot in writing, too.
_SIGNS = re.compile(
    rf"(?P<dot>&#46;|&#x2e;|&period;|%2e|(?<=[A-Za-z0-9])(?:{_DOT_IN}|{_DOT_OUT})(?=[A-Za-z0-9]))"
    rf"|(?P<at>&#64;|&#x40;|&commat;|%40|(?<=[A-Za-z0-9._%+-])(?:{_AT_IN}(?=[A-Za-z0-9])"
    rf"|{_APART}at{_APART}(?={_LABEL}(?:\.{_LABEL}){{0,4}}(?:{_DOT_OUT}|{_DOT_IN}){_LABEL})"
    rf"|(?:[ \t]{{1,3}}@{_SPACE}|@[ \t]{{1,3}})(?={_LABEL}(?:\.|{_DOT_OUT}|{_DOT_IN}){_LABEL})))",
    re.IGNORECASE,
)
_ANY_SIGN = re.compile(rf"&#|&period|&commat|%2e|%40|[\[({{<]{_SPACE}(?:dot|punkt|punto|point|\.|at|arroba|@){_SPACE}[\])}}>]|{_APART}dot{_APART}|[ \t]@|@[ \t]")

# Digits in words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r")(?!\w)"
_GAP = r"(?:[ \t]{1,2}|[ \t]{0,2}[,–-][ \t]{0,2}|\.[ \t]{1,2})"
_SEVERAL = rf"{_DIGIT}(?:{_GAP}{_DIGIT})*"
_SPOKEN = re.compile(rf"\b(?:plus[ \t]{{1,3}}(?:(?P<behind>{_SEVERAL})|(?=[0-9]))|(?P<alone>{_SEVERAL}))", re.IGNORECASE)
_DIGIT_WORD = re.compile(rf"\b{_DIGIT}", re.IGNORECASE)
_WORD = re.compile(r"\w+")
_SPOKEN_WORDS = frozenset([*DIGIT_WORDS, "plus"])

# Letters that stand in for digits.
STAND_INS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1"}
_MIXED = re.compile(r"(?<![A-Za-z0-9])\+?[0-9OoIl|](?:[ .()-]{0,2}[0-9OoIl|]){6,}(?![A-Za-z0-9])")
_ANY_MIXED = re.compile(r"[0-9][ .()-]{0,2}[OoIl|]|[OoIl|][ .()-]{0,2}[0-9]")


def _sign(m: re.Match) -> str:
    return "." if m.lastgroup == "dot" else "@"


def _spoken(m: re.Match) -> str | None:
    words = _DIGIT_WORD.findall(m.group("behind") or m.group("alone") or "")
    if len(words) == 1 and m.group("alone"):
        # A single digit counts only beside the dot of an address.
        around = m.string[max(0, m.start() - 1) : m.start()] + m.string[m.end() : m.end() + 2]
        if not (around.startswith(".") or (around[-2:-1] == "." and around[-1].isalnum())):
            return None
    return ("" if m.group("alone") else "+") + "".join(DIGIT_WORDS[w.lower()] for w in words)


def _stood_in(m: re.Match) -> str | None:
    found = m.group()
    letters = sum(map(found.count, STAND_INS))
    digits = sum(c.isdigit() for c in found)
    return "".join(STAND_INS.get(c, c) for c in found) if 0 < letters <= digits else None


def transduced(text: str) -> list[Rewritten]:
    """The transducers that changed something, in the order they were applied."""
    steps: list[Rewritten] = []

    def now() -> str:
        return steps[-1].text if steps else text

    def apply(pattern: re.Pattern, answer) -> None:
        if step := rewrite(now(), pattern, answer):
            steps.append(step)

    if not text.isascii():
        apply(_INVISIBLE, lambda m: "")
        if (shaped := now().translate(SHAPES)) != now():
            steps.append(Rewritten(shaped, []))
    low = now().lower()
    # The quick looks tell only whether a transducer has anything to rewrite at all.
    if ("dot" in low or any(c in low for c in "&%[({<@")) and _ANY_SIGN.search(low):
        apply(_SIGNS, _sign)
    if not _SPOKEN_WORDS.isdisjoint(_WORD.findall(now().lower())):
        apply(_SPOKEN, _spoken)
    if _ANY_MIXED.search(now()):
        apply(_MIXED, _stood_in)
    return steps


_NAME_END = re.compile(r"\.[A-Za-z]{2,24}$")


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain and disguised identifiers of a text, by kind.

    A disguised one does not lie within a plain one of its kind; it may reach beyond one, as where only the end of a host was disguised. A disguised email ends in
    a name of letters, and a disguised card number is not one digit over and over, which words repeated by mistake would make.
    """
    base = identifiers(text)
    steps = transduced(text)
    extra: dict[str, list[Span]] = {k: [] for k in KINDS}
    if steps:
        last = steps[-1].text
        for kind, spans in identifiers(last).items():
            for span in spans:
                if kind == "email" and not _NAME_END.search(last[max(span[0], span[1] - 26) : span[1]]):
                    continue
                if kind == "card" and len(set(_NO_DIGIT.sub("", last[span[0] : span[1]]))) == 1:
                    continue
                for step in reversed(steps):
                    span = step.source(span)
                k = bisect_right(base[kind], (span[0], len(text) + 1)) - 1
                if k < 0 or base[kind][k][1] < span[1]:
                    extra[kind].append(span)
    return base, extra


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"


def _told(found: dict[str, list[Span]]) -> list[dict]:
    return [{"kind": kind, "start": a, "end": b} for kind in KINDS for a, b in sorted(found[kind])]


def masked(text: str, spans: Iterable[tuple[str, int, int]]) -> str:
    """The text with ``[KIND]`` for each stretch of spans that touch or overlap, named by the one that starts first."""
    out, done, name, end = [], 0, None, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if name is not None and a < end:
            end = max(end, b)
            continue
        if name is not None:
            out.append(f"[{name.upper()}]")
            done = end
        out.append(text[done:a])
        name, end = kind, b
    if name is not None:
        out.append(f"[{name.upper()}]")
        done = end
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each document: ``row_key, doc_id, base, added``, and with ``with_text`` the ``masked`` text.

    ``base`` has the plain identifiers and ``added`` the disguised ones, each as ``kind, start, end`` in code points of the text, end exclusive, by kind and start.
    A null or empty text has none (a null one is masked as null). Null and repeated ids are kept, each row for itself. Kinds may overlap.
    """

    def scan(batches):
        for batch in batches:
            keys, ids, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in slices(texts, 2_000_000):
                base, added, left = [], [], []
                for text in texts[a:b]:
                    plain, extra = find(text or "")
                    base.append(_told(plain))
                    added.append(_told(extra))
                    if with_text:
                        left.append(text if text is None else masked(text, [(s["kind"], s["start"], s["end"]) for s in base[-1] + added[-1]]))
                columns = [keys.slice(a, b - a), ids.slice(a, b - a), pa.array(base, pa.list_(SPAN)), pa.array(added, pa.list_(SPAN))]
                names = ["row_key", "doc_id", "base", "added"]
                if with_text:
                    columns.append(pa.array(left, pa.string()))
                    names.append("masked")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    shape = f"row_key long, doc_id long, base {_SPAN_TYPE}, added {_SPAN_TYPE}" + (", masked string" if with_text else "")
    return keyed(documents_of(docs, id_col, text_col)).select("row_key", "doc_id", "text").mapInArrow(scan, shape)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of plain identifiers of each kind, a digest of these, and all spans as text."""
    place = F.create_map(*(x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))))
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(place[s["kind"]].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(both).alias("spans"))
