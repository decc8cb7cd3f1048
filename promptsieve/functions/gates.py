"""Cheap necessary conditions for regular expressions.

A JVM regex over a text costs many times a search for a word. ``required_words`` reads off a pattern the words that each of its matches holds; ``open_gates`` turns
them into a condition, so the regex runs only on the few rows that can match. A gate is never narrower
than its pattern: where no word is certain there is no gate. All gates of a text are judged together,
over Arrow batches (``open_gates``).
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _parser as sre  # private to Python: without it there are no gates, only slower scans
except ImportError:
    sre = None

MIN_WORD = 3
# The four non-ASCII letters that Unicode case folding equates with ASCII i, k and s.
FOLDING_LETTERS = "ſKıİ"
# White space as the JVM's \\s takes it.
SPACE = r"[ \t\n\x0B\f\r]"
# Bytes and texts that are looked at in one step: they bound what a worker holds.
SLICE = 1 << 20
BATCH = 500
# Sets of more beginnings are looked for by the regex itself.
MAX_BEGINNINGS = 8
# So few words are looked for in every text.
FEW_WORDS = 4
_FOLDED = bytes.maketrans((string.ascii_uppercase + "\t\n\x0b\f\r").encode(), (string.ascii_lowercase + " " * 5).encode())


def quote(text: str) -> str:
    """Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def required_words(pattern: str, spell=str, unicode_spaces: bool = False):
    """Lower-case words that every match of ``pattern`` holds: ('and' | 'or', parts) over
    words, or ``None``. Assumes ASCII case folding, as in ``(?i)`` without Unicode case.
    ``spell`` rewrites the words, for texts in which they appear encoded. White space that must stand
    between words is one blank in them, unless the pattern takes it by Unicode.
    """
    if sre is None:
        return None
    try:
        return _conjunction(sre.parse(pattern), spell, not unicode_spaces)
    except sre.error:  # Java-only syntax
        return None


def _is_space(op, arg) -> bool:
    return op is sre.IN and arg == [(sre.CATEGORY, sre.CATEGORY_SPACE)]


def _conjunction(items, spell, spaces):
    parts: list = []
    run: list[str] = []

    def flush():
        word = re.sub(f"{SPACE}+", " ", "".join(run).lower())
        run.clear()
        if len(word.replace(" ", "")) >= MIN_WORD:
            parts.append(spell(word))

    for op, arg in items:
        if op is sre.LITERAL and arg < 128:
            run.append(chr(arg))
            continue
        repeated = op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1
        if spaces and (_is_space(op, arg) or repeated and len(arg[2]) == 1 and _is_space(*arg[2][0])):
            run.append(" ")
            continue
        flush()
        inner = None
        if op is sre.SUBPATTERN:
            inner = _conjunction(arg[3], spell, spaces)
        elif repeated:
            inner = _conjunction(arg[2], spell, spaces)
        elif op is sre.BRANCH:
            options = [_conjunction(option, spell, spaces) for option in arg[1]]
            inner = ("or", options) if all(options) else None
        if inner:
            parts.append(inner)
    flush()
    return ("and", parts) if parts else None


def _weight(tree) -> tuple[int, int]:
    """Sort key: conditions that are cheap and seldom true come first."""
    if isinstance(tree, str):
        return (len(tree) <= 3, 1)
    weights = [_weight(p) for p in tree[1]]
    if tree[0] == "and":
        return min(weights)
    return (max(w[0] for w in weights), sum(w[1] for w in weights))


def _leaves(tree) -> set[str]:
    if tree is None:
        return set()
    return {tree} if isinstance(tree, str) else set().union(*map(_leaves, tree[1]))


def _sorted(tree):
    """The tree with conditions that are cheap and seldom true before the others."""
    return tree if isinstance(tree, str) else (tree[0], [_sorted(p) for p in sorted(tree[1], key=_weight)])


def _triples(data: np.ndarray) -> np.ndarray:
    """A number for each three bytes in a row, of their low seven bits."""
    low = (data & 127).astype(np.int32)
    return (low[:-2] << 14) | (low[1:-1] << 7) | low[2:]


def _word_triples(word: str) -> np.ndarray:
    return np.unique(_triples(np.frombuffer(word.encode(), np.uint8)))


def _held_triples(texts: list, numbers: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` numbered triples each text, or its bytes, holds; other triples have the number ``n``."""
    data = [t.encode(errors="replace") if isinstance(t, str) else t for t in texts]
    held = np.zeros((n, len(data)), dtype=bool)
    rows = np.repeat(np.arange(len(data), dtype=np.int32), [len(d) + 2 for d in data])
    joined = np.frombuffer(b"".join(d + b"\x00\x00" for d in data), np.uint8)
    for start in range(0, len(joined) - 2, SLICE):
        found = numbers[_triples(joined[start:start + SLICE + 2])]
        at = np.flatnonzero(found < n)
        held[found[at], rows[start + at]] = True
    return held.T


@dataclass(frozen=True)
class View:
    """Trees, and the form of a text that they are judged on: its folded bytes, some left out, some
    replaced by others; or, with ``raw``, the text as it is."""

    trees: tuple
    replaced: bytes | None = None
    left_out: bytes = b""
    raw: bool = False

    def of(self, texts: list[bytes], folded: list[bytes]) -> list[bytes]:
        if self.raw:
            return texts
        if self.replaced is None and not self.left_out:
            return folded
        return [f.translate(self.replaced, self.left_out) for f in folded]


#: One gate, for the letters outside ASCII that fold to ASCII ones.
FOLDING_VIEW = View((("or", tuple(FOLDING_LETTERS)),), raw=True)


def letters_view(trees) -> View:
    """Trees that are judged on the ASCII letters of a text alone. The other letters are left out too: that
    only brings words together, so the gate is wider."""
    return View(tuple(trees), None, bytes(sorted(set(range(256)) - set(string.ascii_lowercase.encode()))))


def run_view(characters: str, n: int) -> View:
    """One gate, for a run of ``n`` of some ASCII characters. Only for sets that hold both cases of a letter."""
    held = characters.lower().encode()
    return View(("x" * n,), bytes(ord("x") if i in held else ord(" ") for i in range(256)))


def _fold(text: bytes) -> bytes:
    """ASCII letters as lower case, white space as one blank, the letters that fold to ASCII ones as these."""
    if not text.isascii():
        for letter, plain in zip(FOLDING_LETTERS, "skii"):
            text = text.replace(letter.encode(), plain.encode())
    text = b" " + text.translate(_FOLDED) + b" "
    return b" " + b" ".join(text.split()) + b" " if b"  " in text else text


def _numbered(view: View) -> tuple[list, np.ndarray]:
    """Sorted trees and the triples of their words; few words are looked for without these."""
    words = sorted(set().union(*map(_leaves, view.trees)))
    triples = [_word_triples(w) for w in words] if len(words) > FEW_WORDS else []
    return (
        [None if tree is None else _sorted(tree) for tree in view.trees],
        np.unique(np.concatenate(triples)) if triples else np.zeros(0, np.int32))


def _judge(data: list[bytes], every: np.ndarray, trees: list, triples: np.ndarray, numbers: np.ndarray):
    """For each tree the rows, of ``every``, that meet it."""
    held = _held_triples(data, numbers, len(triples)) if len(triples) else None
    may, seen = {}, {}

    def met(tree, rows: np.ndarray) -> np.ndarray:
        if isinstance(tree, str):
            if held is not None:
                if tree not in may:
                    may[tree] = held.T[numbers[_word_triples(tree)]].all(axis=0)
                rows = rows[may[tree][rows]]
            sure, word = seen.setdefault(tree, {}), tree.encode()
            for r in rows:
                if r not in sure:
                    sure[r] = word in data[r]
            return rows[[sure[r] for r in rows]] if len(rows) else rows
        if tree[0] == "and":
            for part in tree[1]:
                rows = met(part, rows)
            return rows
        found = [rows[:0]]
        for part in tree[1]:
            found.append(met(part, rows))
            rows = np.setdiff1d(rows, found[-1])
        return np.sort(np.concatenate(found))

    return [every if tree is None else met(tree, every) for tree in trees]


def open_gates(text: Column, trees: list, views: tuple[View, ...] = ()) -> Column:
    """Numbers of the ``trees`` that a text meets, lower-cased and with white space as one blank; NULL
    without a text. No tree (None) is met by every text. The trees of ``views`` are numbered on.

    One pass over a batch of texts notes which three bytes of the words stand in which text; a word is
    looked for only in texts that hold all of its triples.
    """
    views = (View(tuple(trees)), *views)
    ordered = [_numbered(view) for view in views]

    def judge_some(values: list, tables: list) -> list:
        opened = [[] if v is not None else None for v in values]
        every = np.flatnonzero([v is not None for v in values])
        texts = [b"" if v is None else v for v in values]
        folded = [_fold(t) for t in texts]
        first = 0
        for view, (parts, triples), numbers in zip(views, ordered, tables):
            for i, rows in enumerate(_judge(view.of(texts, folded), every, parts, triples, numbers), first):
                for r in rows:
                    opened[r].append(i)
            first += len(parts)
        return opened

    def judge(texts: pa.Array) -> pa.Array:
        tables = []
        for _, triples in ordered:
            tables.append(np.full(1 << 21, len(triples), dtype=np.int32))
            tables[-1][triples] = np.arange(len(triples))
        batches = (texts.slice(i, BATCH).cast(pa.binary()).to_pylist() for i in range(0, len(texts), BATCH))
        return pa.array([x for batch in batches for x in judge_some(batch, tables)], pa.list_(pa.int32()))

    judge.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, "array<int>")(text)


def _first_bytes(ranges) -> list[bytes]:
    """Beginnings in UTF-8, but for the last byte, of the characters of ranges."""
    return sorted({chr(c).encode(errors="surrogatepass")[:-1] for low, high in ranges for c in {*range(low, high, 64), high}})


def non_ascii_sql(pattern: str, text: str) -> str | None:
    """Condition for patterns whose matches all begin with a character of a set outside ASCII, the
    letters that fold to ASCII ones excluded: a text of as many bytes as characters has none, and of the
    others only those that hold the first bytes of such a character. None for other patterns."""
    if not needs_non_ascii(pattern):
        return None
    low = f"octet_length({text}) > length({text})"
    op, arg = sre.parse(pattern)[0]
    if op is not sre.IN:
        op, arg = arg[2][0]
    ranges = [(a, a) if o is sre.LITERAL else a for o, a in arg]
    if sum((b - a) // 64 + 1 for a, b in ranges) > MAX_BEGINNINGS:
        return low
    held = " or ".join(f"contains(cast({text} as binary), X'{b.hex()}')" for b in _first_bytes(ranges))
    return f"{low} and ({held})"


def needs_non_ascii(pattern: str) -> bool:
    """Whether every match of ``pattern`` begins with a character of a set outside ASCII, the
    letters that fold to ASCII ones excluded: a text of as many bytes as characters has none."""
    if sre is None:
        return False
    try:
        op, arg = sre.parse(pattern)[0]
    except (sre.error, IndexError):
        return False
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1 and len(arg[2]) == 1:
        op, arg = arg[2][0]
    if op is not sre.IN:
        return False
    low = [a if o is sre.LITERAL else a[0] if o is sre.RANGE else 0 for o, a in arg]
    return min(low, default=0) >= 128 and not any(
        a <= ord(c) <= b for o, x in arg for a, b in [(x, x) if o is sre.LITERAL else x] for c in FOLDING_LETTERS)
