"""Personal data, also in disguise, with spans in the source text.

Base kinds (leftmost, non-overlapping per kind): email, ip, card, phone; a match that fails its
check (parts at most 255, 13 to 19 digits and Luhn, 9 to 15 digits) is dropped. Each is found in
one pass: a card or phone candidate is scanned once, and an e-mail address is read outwards from
its ``@``.

Disguises. Three transducers rewrite the text and keep, for every written character, the span of
source characters it stands for: letters, digits and signs that look like ASCII ones or stand
for nothing (full width, Cyrillic and Greek homoglyphs, zero-width characters), number words, and
words or brackets for ``@`` and ``.`` between the parts of an address. The same detectors run on
the rewritten text, and a span there maps back to the first and last source character it covers.
A span that overlaps a base span of its kind is not added, so base spans always stay as they are.

NULL is an empty text. The work per row is linear in its length. Other columns are not read, repeated
rows are judged one by one, and empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import prepared, values_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Characters that look like ASCII ones (fixed values): Cyrillic, then Greek, then Latin: a long s,
#: an i without its dot and an I with one.
LOOKS = dict(zip(
    "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ" "αοιερτνκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ſıİ",
    "aeopcyxijsdhqwABEKMHOPCTYXIJS" "aoieptvkABEZHIKMNOPTYX" "siI"))
#: Characters that show nothing (fixed values): soft hyphen, zero-width ones, joiners, mark.
NOTHING = frozenset("­​‌‍⁠﻿")
#: Signs for ASCII signs (fixed values): dots, hyphens, at signs, no-break blanks.
SIGNS = dict(zip("。．․‐‑‒–−＠﹫  ", "...-----@@  "))
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
NUMBER = {w: str(d) for d, w in enumerate(DIGITS)} | {"oh": "0", "plus": "+"}
SPELLED = re.compile(r"(?<![A-Za-z])(?:" + "|".join(NUMBER) + r")(?![A-Za-z])", re.IGNORECASE | re.ASCII)
#: Parts of an address: a sign, a dot, what stands between them, and all else, blanks at once.
SCAN = re.compile(
    r"(?P<at>\s*+[\[({<]\s*+(?i:at|@)\s*+[\])}>]\s*+|\s++(?:at|AT)\s++|@)"
    r"|(?P<dot>\s*+[\[({<]\s*+(?i:dot|punkt|point|punto|\.)\s*+[\])}>]\s*+|\s++(?:dot|DOT)\s++|\.)"
    r"|(?P<name>[A-Za-z0-9_%+-]++)|\s++|[^\sA-Za-z0-9_%+-]")
BRACKET, LABEL = re.compile(r"[\[({<]"), re.compile(r"[A-Za-z0-9-]+")
#: Every address that is rewritten has one of these.
HINT = re.compile(r"[\[({<]\s*+(?i:at|@|dot|punkt|point|punto|\.)\s*+[\])}>]|\s(?:dot|DOT)\s")
#: Last labels that make an address of bare words (fixed values); with brackets any will do.
LAST = frozenset("com org net edu gov info io co uk us eu de at ch fr es it nl be pl pt se dk fi ie in jp cn br mx ca au".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` takes the longest run before it that no earlier match has used."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            used = found.end()
        at = text.find("@", max(at + 1, used))


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found["ip"].append(m.span())
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
    return found


def _ascii_of(c: str) -> str | None:
    """What a character stands for, or None if for itself."""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if c in NOTHING:
        return ""
    return LOOKS.get(c) or SIGNS.get(c)


class Rewritten:
    """A text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Apply (start, end, new text) edits; all new characters stand for the whole edit."""
        out, start, end, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        out.append(self.text[at:])
        return Rewritten("".join(out), start + self.start[at:], end + self.end[at:])


ODD = re.compile("[" + "".join(map(re.escape, [*LOOKS, *NOTHING, *SIGNS])) + "！-～]")


def homoglyphs(r: Rewritten) -> Rewritten:
    edits = [(m.start(), m.end(), _ascii_of(m[0])) for m in ODD.finditer(r.text)]
    return r.replaced(edits) if edits else r


def spelled_digits(r: Rewritten) -> Rewritten:
    """Runs of number words, with what may stand between digits, become digits."""
    words = list(SPELLED.finditer(r.text))
    edits = []
    for k, m in enumerate(words):
        before = k and re.fullmatch(r"[\s,.-]{1,3}", r.text[words[k - 1].end(): m.start()])
        after = k + 1 < len(words) and re.fullmatch(r"[\s,.-]{1,3}", r.text[m.end(): words[k + 1].start()])
        if before or after:
            if before and edits and edits[-1][1] == words[k - 1].end():
                edits.append((words[k - 1].end(), m.start(), "" if edits[-1][2] == "+" else " "))
            edits.append((m.start(), m.end(), NUMBER[m[0].lower()]))
    return r.replaced(edits) if edits else r


def _host(parts: list, at: int) -> tuple[int, int]:
    """(index of the last part, its end) of two labels or more from part ``at`` on, or (-1, 0)."""
    last, end, labels = -1, 0, 0
    while at < len(parts) and parts[at].lastgroup == "name" and (label := LABEL.match(parts[at][0])):
        last, end, labels = at, parts[at].start() + label.end(), labels + 1
        if label.end() < len(parts[at][0]) or at + 1 >= len(parts) or parts[at + 1].lastgroup != "dot":
            break
        at += 2
    return (last, end) if labels > 1 else (-1, 0)


def addresses(r: Rewritten) -> Rewritten:
    """Words and brackets for at and dot, inside of what is an address with them: names joined by
    dots, a sign, labels joined by dots. A bare "at" and "dot" need a common last label, and a bare
    "at" a spelled dot. One pass over the parts of the text."""
    if not HINT.search(r.text):
        return r
    parts, edits = list(SCAN.finditer(r.text)), []
    begin, k = -1, 0
    while k < len(parts):
        kind = parts[k].lastgroup
        if kind == "name":
            if begin < 0 or parts[k - 1].lastgroup != "dot":
                begin = k
        elif kind == "dot":
            begin = begin if k and parts[k - 1].lastgroup == "name" else -1
        elif kind == "at" and begin >= 0 and parts[k - 1].lastgroup == "name":
            last, end = _host(parts, k + 1)
            joints = [x for x in parts[begin: last + 1] if x.lastgroup in ("at", "dot")] if last > 0 else []
            written = [x for x in joints if x[0] not in "@."]
            sure = parts[k][0] == "@" or any(BRACKET.search(x[0]) for x in written)
            spelled = any(x.lastgroup == "dot" for x in written) and LABEL.match(parts[last][0])[0].lower() in LAST if last > 0 else False
            if written and (sure or spelled):
                edits += [(x.start(), x.end(), "@" if x.lastgroup == "at" else ".") for x in written]
                k = last
            begin = -1
        else:
            begin = -1
        k += 1
    return r.replaced(edits) if edits else r


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, added spans) by kind."""
    base = detect(text)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    r = homoglyphs(Rewritten(text)) if not text.isascii() and ODD.search(text) else None
    if HINT.search(text) or r or SPELLED.search(text):
        r = addresses(spelled_digits(r or Rewritten(text)))
    if r is None or r.text == text:
        return base, added
    for kind, found in detect(r.text).items():
        starts = [x for x, _ in base[kind]]
        for a, b in found:
            low, high = r.start[a], r.end[b - 1]
            # Base spans are in order and apart: the last that starts before ``high`` decides.
            k = bisect_right(starts, high - 1)
            if k == 0 or base[kind][k - 1][1] <= low:
                added[kind].append((low, high))
    return base, added


def _joined(found: dict[str, list[tuple[int, int]]]) -> str:
    rows = [(k, a, b) for k in KINDS for a, b in found[k]]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in rows)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                        ("base_spans", pa.string()), ("spans", pa.string())])
    for batch in batches:
        rows = []
        for doc_id, text in zip(values_of(batch, "doc_id"), values_of(batch, "text")):
            base, added = spans(text or "")
            every = {k: sorted(base[k] + added[k]) for k in KINDS}
            rows.append((doc_id, *(len(base[k]) for k in KINDS), _joined(base), _joined(every)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base kinds), base_spans and spans (with the
    disguised ones), as kind:start:end by kind, then start; code points, end exclusive."""
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
