"""Personal data in texts, also where it is disguised.

Plain matches come from patterns. For disguised ones a text is rewritten by
transducers - look-alike letters and digits, spelled digits, and words for @
and . - of which each output character knows the source characters it came
from. The same patterns run on the rewritten text, and what only they find is
mapped back to spans of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PLAIN = ("email", "ip", "card", "phone")
KINDS = (*PLAIN, *(f"disguised_{k}" for k in PLAIN))
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαενοιρτυκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaevoiptukxABEZHIKMNOPTYX", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
#: Digits as words.
DIGITS = {word: str(n) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf") for n, word in enumerate(words.split())}
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:{_WORD})(?:[\x20,.-]{{1,2}}(?:{_WORD}|[0-9])){{3,}}(?!\w)", re.I)
SPELLED_ITEM = re.compile(rf"[0-9]|{_WORD}", re.I)
ODD = re.compile(f"[{''.join(ALIKE)}{INVISIBLE}٠-٩۰-۹०-९！-～﹫。․𝐀-𝟿]")
#: Words for @ that are no other words, and words for a point, of English, Spanish, German and French.
AT = "arroba|arobase|arrobase|klammeraffe"
DOT = "dot|punto|punkt|point"
BRACKETED = re.compile(rf"[\[({{<]\s*+(at|@|{AT}|{DOT}|\.)\s*+[\])}}>]\s*+", re.I)
_LABEL = "[A-Za-z0-9-]++"
#: "at" between blanks, before a domain; with a real point in that only after a local part that is no plain word.
BLANK_AT = re.compile(rf"(?<=[A-Za-z0-9])\s++(?:{AT}|(at))\s++(?={_LABEL}(?:\s++(?:{DOT})\s++|(\.))[A-Za-z0-9-])", re.I)
NOT_PLAIN = re.compile(r"[0-9._%+-]")
#: A domain of which all points are spelled, or the last ones by "dot".
SPELLED_DOMAIN = re.compile(rf"@{_LABEL}(?:(?:\s++(?:{DOT})\s++{_LABEL})++|(?:\.{_LABEL})++(?:\s++dot\s++{_LABEL})++)", re.I)
BLANK_DOT = re.compile(rf"\s++(?:{DOT})\s++", re.I)
ARROBA = re.compile(AT)
PLUS = re.compile(r"(?<!\w)plus\s+(?=[0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in linear time: from each @ back over what its local part may hold."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def look_alike(c: str) -> str:
    if c in ALIKE:
        return ALIKE[c]
    if c in INVISIBLE:
        return ""
    if c in "。․":
        return "."
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    return unicodedata.normalize("NFKC", c)


def rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[int], list[int]]:
    """The text with spans replaced, and for each of its characters the source span."""
    out, start, end, at = [], [], [], 0
    for a, b, new in sorted(edits):
        if a < at:
            continue
        out += [text[at:a], new]
        start += [*range(at, a), *[a] * len(new)]
        end += [*range(at + 1, a + 1), *[b] * len(new)]
        at = b
    out.append(text[at:])
    start += range(at, len(text))
    end += range(at + 1, len(text) + 1)
    return "".join(out), start, end


def after(text: str, start: list[int], end: list[int], edits: list[tuple[int, int, str]]) -> tuple[str, list[int], list[int]]:
    """rewrite() of a text that is itself rewritten."""
    new, a, b = rewrite(text, edits)
    return new, [start[k] for k in a], [end[k - 1] for k in b]


def blanks_before(text: str, at: int) -> int:
    start = at
    while start and text[start - 1].isspace():
        start -= 1
    return at - start


def spelled_locals(text: str) -> list[tuple[int, int, str]]:
    """Each "dot" between blanks in a local part, from its @ back."""
    out, at = [], text.find("@")
    while at >= 0:
        start = at
        while True:
            first = start
            while start and text[start - 1] in LOCAL:
                start -= 1
            word = start - blanks_before(text, start)
            before = word - 3 - blanks_before(text, word - 3) if text[max(0, word - 3) : word].lower() == "dot" else word
            if start == first or word == start or before > word - 4 or not before or text[before - 1] not in LOCAL:
                break
            out.append((before, start, "."))
            start = before
        at = text.find("@", at + 1)
    return out


def local_part(text: str, end: int) -> str:
    start = end
    while start and text[start - 1] in LOCAL:
        start -= 1
    return text[start:end]


def normalised(text: str) -> tuple[str, list[int], list[int]] | None:
    """The text as the transducers, in turn, leave it; None if none changes it."""
    now = None

    def apply(edits):
        nonlocal now
        if edits:
            now = after(*now, edits) if now else rewrite(text, edits)

    current = lambda: now[0] if now else text
    if not text.isascii():
        apply([(m.start(), m.end(), look_alike(m[0])) for m in ODD.finditer(text)])
    apply([(m.start() + x.start(), m.start() + x.end(), DIGITS.get(x[0].lower(), x[0])) for m in SPELLED.finditer(current()) for x in SPELLED_ITEM.finditer(m[0])])
    if now:
        # blanks and points between digits that were spelled go
        apply([(m.start(), m.end(), "") for m in re.finditer(r"(?<=[0-9])[\x20,.-]{1,2}(?=[0-9])", now[0]) if any(now[1][k] + 1 < now[2][k] for k in (m.start() - 1, m.end()))])
    apply([(m.start() - blanks_before(current(), m.start()), m.end(), "." if m[1] == "." or re.fullmatch(DOT, m[1], re.I) else "@") for m in BRACKETED.finditer(current())])
    low = current().lower()
    if " at " in low or ARROBA.search(low):
        apply([(m.start(), m.end(), "@") for m in BLANK_AT.finditer(current()) if not m[1] or not m[2] or NOT_PLAIN.search(local_part(current(), m.start()))])
    if "@" in current():
        apply([(m.start() + x.start(), m.start() + x.end(), ".") for m in SPELLED_DOMAIN.finditer(current()) for x in BLANK_DOT.finditer(m[0])])
        if " dot " in low:
            apply(spelled_locals(current()))
    if "plus" in low:
        apply([(m.start(), m.end(), "+") for m in PLUS.finditer(current())])
    return now


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if (found := normalised(text)) is None:
        return []
    new, start, end = found
    out = []
    for kind, a, b in plain_spans(new):
        x, y = start[a], end[b - 1]
        if text[x:y] != new[a:b] and not any(k == kind and p < y and x < q for k, p, q in plain):
            out.append((f"disguised_{kind}", x, y))
    return out


def find_personal(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain and disguised spans, in code points; none in a null text."""
    if not text:
        return [], []
    plain = plain_spans(text)
    return plain, disguised_spans(text, plain)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            plain, more = find_personal(text.as_py())
            n = [sum(k == x for x, _, _ in plain) for k in PLAIN]
            every = sorted(plain + more, key=lambda s: (s[1], s[2]))
            rows.append((*n, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(plain + more), [{"kind": k, "start": a, "end": b} for k, a, b in every]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [_FOUND]
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", *names])


def scan_personal(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): counts, the digest of the plain spans, all spans, and spans as structs.

    A null or empty text has no spans (and the digest of the empty string). Texts
    of any length are read whole, in time that grows with their length. Rows with
    equal ids each give a row, an empty table none. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {RESULT}")
