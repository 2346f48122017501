"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. Then two transducers rewrite a text and keep
for every character they emit the source characters it came from: the first maps homoglyphs
and foreign digits and drops invisible characters; the second turns spelled digits and at/dot
disguises into characters. Identifiers found in the rewritten text are mapped back to source
spans. A span is added only if the rewriting changed something inside it and if no plain span
of its kind overlaps it. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import per_text, table

KINDS = ("email", "ip", "card", "phone")

_AT_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits before a digit could only match where the run itself does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Letters that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n", "ѵ": "v", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "ε": "e", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: Digits spelled in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words for the at sign, each with the words for the dot that go with it.
AT_DOT = {"at": ("dot", "punkt"), "arobase": ("point",), "arroba": ("punto",)}

#: Digits that make a run of digits and spelled digits a number, whatever its parts.
NUMBER = 9

_ATS, _DOTS = "|".join(AT_DOT), "|".join(d for ds in AT_DOT.values() for d in ds)
_TOKEN = re.compile(r"[^\W_]+")
#: What may stand between the spelled digits of a run, between the parts of a number, and after a plus.
_IN_RUN, _IN_NUMBER, _AFTER_PLUS = re.compile(r"[\s,-]+"), re.compile(r"[\s,().-]{1,3}"), re.compile(r"[\s-]+")
_BRACKETED = re.compile(rf"(?<!\s)\s*[\[({{<]\s*({_ATS}|{_DOTS}|@|\.)\s*[\])}}>]\s*", re.I)
#: A spelled at, and the dots of the name after it, of which one at least must be disguised.
_SPOKEN_AT = re.compile("|".join(rf"(?<=[A-Za-z0-9])\s+{at}\s+(?=([A-Za-z0-9-]+(?:(?:\s+(?:{'|'.join(dots)})\s+|\.)[A-Za-z0-9-]+)+))" for at, dots in AT_DOT.items()), re.I)
_DOT_AFTER, _DOT_BEFORE = re.compile(rf"\s+(?:{_DOTS})\s", re.I), re.compile(rf"\s(?:{_DOTS})\s+\Z", re.I)
_SPOKEN_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s+(?:{_DOTS})\s+(?=[A-Za-z0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: the local part is the run that ends at an at sign."""
    out, least, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT_RIGHT.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        least = m.end() if m else at + 1
        at = text.find("@", least)
    return out


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """All kinds, in the order of KINDS and then of start; offsets in code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


class Rewritten:
    """A text with, for each character, the source span it came from and whether it was changed."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.changed = text, None, None, None

    def _offsets(self):
        n = len(self.text)
        return (list(range(n)), list(range(1, n + 1)), bytearray(n)) if self.start is None else (self.start, self.end, self.changed)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts other characters in place of disjoint ascending ranges; each covers the whole range."""
        if not edits:
            return
        start, end, changed = self._offsets()
        text, s, e, c, at = [], [], [], bytearray(), 0
        for lo, hi, new in edits:
            text += [self.text[at:lo], new]
            s += start[at:lo] + [start[lo]] * len(new)
            e += end[at:lo] + [end[hi - 1]] * len(new)
            c += changed[at:lo] + b"\1" * len(new)
            at = hi
            if not new and c and lo:
                c[-1] = 1
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end, self.changed = s + start[at:], e + end[at:], c + changed[at:]


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _FOREIGN.finditer(text):
        c = m[0]
        if c in HOMOGLYPHS:
            new = HOMOGLYPHS[c]
        elif c in INVISIBLE:
            new = ""
        elif "！" <= c <= "～":
            new = chr(ord(c) - 0xFEE0)  # full-width forms of ASCII
        elif (d := unicodedata.decimal(c, None)) is not None:
            new = str(d)
        else:
            continue
        edits.append((*m.span(), new))
    return edits


#: A class with the characters that may be rewritten, and any digit that isn't ASCII.
_FOREIGN = re.compile("[" + "".join(map(re.escape, [*HOMOGLYPHS, *INVISIBLE])) + "！-～]|(?![0-9])\\d")


def _digit_runs(text: str) -> list[tuple[int, int, str]]:
    #: Numbers as (start, end, digit if spelled, where a plus before it starts), the chain of each, and the digits of a chain.
    found, chain, digits = [], [], []
    last = "", 0, 0
    for m in _TOKEN.finditer(text):
        word = m[0].lower()
        spelled, (lo, hi) = DIGITS.get(word), m.span()
        if spelled or word.isascii() and word.isdigit():
            plus = last[1] if last[0] == "plus" and _AFTER_PLUS.fullmatch(text, last[2], lo) else None
            if not (found and _IN_NUMBER.fullmatch(text, found[-1][1], lo)):
                digits.append(0)
            chain.append(len(digits) - 1)
            digits[-1] += 1 if spelled else hi - lo
            found.append((lo, hi, spelled, plus))
        last = word, lo, hi
    edits, k = [], 0
    while k < len(found):
        first = k
        k += 1
        if found[first][2] is None:
            continue
        while k < len(found) and found[k][2] is not None and _IN_RUN.fullmatch(text, found[k - 1][1], found[k][0]):
            k += 1
        plus, hi = found[first][3], found[k - 1][1]
        lo = found[first][0] if plus is None else plus
        if k - first < 3 and max(digits[c] for c in chain[first:k]) < NUMBER and not re.search("[0-9.@]", text[hi : hi + 1] + text[max(0, lo - 1) : lo]):
            alone = _DOT_AFTER.match(text, hi, hi + 10) or _DOT_BEFORE.search(text[max(0, lo - 10) : lo])
            if not alone:
                continue
        edits.append((lo, hi, ("" if plus is None else "+") + "".join(x[2] for x in found[first:k])))
    return edits


def _at_signs(r: Rewritten) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPOKEN_AT.finditer(r.text):
        name = next(k for k, x in enumerate(m.groups(), 1) if x)
        made = r.changed is not None and any(r.changed[k] and r.text[k] == "." for k in range(*m.span(name)))
        if made or re.search(r"\s", m[name]):
            edits.append((*m.span(), "@"))
    return edits


def disguised_spans(text: str) -> list[tuple[str, int, int]]:
    """Identifiers of the rewritten text that the rewriting brought about, as source spans."""
    r, low = Rewritten(text), text.lower()
    if not text.isascii():
        r.replace(_look_alikes(r.text))
        low = r.text.lower()
    if not DIGITS.keys().isdisjoint(_TOKEN.findall(low)):
        r.replace(_digit_runs(r.text))
    if any(w in low for w in _DOTS.split("|")) or _BRACKETED.search(r.text):
        r.replace([(*m.span(), "@" if m[1].lower() in AT_DOT else "." if m[1] not in "@." else m[1]) for m in _BRACKETED.finditer(r.text)])
        r.replace(_at_signs(r))
        r.replace([(*m.span(), ".") for m in _SPOKEN_DOT.finditer(r.text)])
    if r.start is None:
        return []
    out = []
    for kind, a, b in plain_spans(r.text):
        if kind == "email" and not r.text[a:b].rpartition(".")[2].isalpha():
            continue
        if 1 in r.changed[a:b]:
            out.append((kind, r.start[a], r.end[b - 1]))
    return out


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and those with the disguised ones, in the order of KINDS and then of start."""
    base = plain_spans(text)
    more = disguised_spans(text)
    if not more:
        return base, base
    taken = {k: sorted((a, b) for x, a, b in base if x == k) for k in KINDS}
    extra = []
    for k, a, b in more:
        at = bisect_right(taken[k], (b - 1, float("inf")))
        if not (at and taken[k][at - 1][1] > a):
            extra.append((k, a, b))
    return base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, base and spans, arrays of (kind, start, end) in code points.

    base holds the plain identifiers, spans those and the disguised ones. Null and empty texts
    have none. Repeated rows each get their row; other columns are ignored. Time is linear in
    the length of a text, whatever runs it holds."""

    def make():
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        as_rows = lambda found: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found], kind)

        def run(texts):
            found = [all_spans(t) for t in texts]
            return [as_rows([x for x, _ in found]), as_rows([x for _, x in found])]

        return run

    span = "array<struct<kind:string,start:long,end:long>>"
    return per_text(docs, id_col, text_col, make, f"base {span}; spans {span}")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    line = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_disguised"), F.size("spans").cast("long").alias("n_spans")
    )
