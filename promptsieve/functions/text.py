"""Text functions: ``Column -> Column``, all built-in expressions, no Python worker."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions.gates import FOLDING_VIEW, letters_view, open_gates, required_words, run_view

_PRINTABLE = r"\A(?:[^\p{C}\p{Z}]|[ ])*\z"
_NOT_PRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
_ROT13_FROM = string.ascii_uppercase + string.ascii_lowercase
_ROT13_TO = "".join(
    base[(i + 13) % 26]
    for base in (string.ascii_uppercase, string.ascii_lowercase)
    for i in range(26)
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- base64 --------------------------------------------------------------------------------
def _base64_text(run: Column) -> Column:
    """Decoded text of one base64 run, NULL unless it is well padded printable UTF-8.

    Spark takes missing padding and refuses surplus padding, so the padding rule is spelled
    out: with D data characters and P pads a run is valid iff D%4=0, or D%4=2 and P=2, or
    D%4=3 and P>=1.
    """
    data = F.rtrim(run, F.lit("="))
    rest = F.length(data) % 4
    pads = F.length(run) - F.length(data)
    valid = (rest == 0) | ((rest == 2) & (pads == 2)) | ((rest == 3) & (pads >= 1))
    raw = F.when(valid, F.try_to_binary(data, F.lit("base64"))).cast("string")
    return F.when(F.is_valid_utf8(raw) & raw.rlike(_PRINTABLE), raw)


def base64_runs(c) -> Column:
    """ARRAY<STRUCT<original, decoded>> of the runs that decode to printable text."""
    # Looking back for the start of a run spares a try at each of its characters.
    runs = F.regexp_extract_all(_col(c), F.lit(f"(?<![A-Za-z0-9+/]){K.BASE64_RUN}"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.struct(r.alias("original"), _base64_text(r).alias("decoded")))
    return F.filter(pairs, lambda p: p.decoded.isNotNull())


def base64_segments(c) -> Column:
    return F.transform(base64_runs(c), lambda p: p.decoded)


def count_base64(c) -> Column:
    return F.size(base64_runs(c))


def explode_decoded(df, text: str = "text"):
    """One row per decoded fragment: original, decoded, encoding, confidence."""
    whole = url_decode_lenient(text)
    item = lambda o, d, e, conf: F.struct(
        o.alias("original"), d.alias("decoded"), F.lit(e).alias("encoding"),
        F.lit(conf).alias("confidence"),
    )
    b64 = F.transform(base64_runs(text), lambda p: item(p.original, p.decoded, "base64", 0.9))
    url = F.when(
        has_url_encoding(text), F.array(item(F.col(text), whole, "url", 0.8))
    ).otherwise(F.array().cast(
        "array<struct<original:string,decoded:string,encoding:string,confidence:double>>"))
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.inline(F.concat(b64, url)))


# --- url, hex, rot13 -----------------------------------------------------------------------
def has_url_encoding(c) -> Column:
    return F.contains(_col(c), F.lit("%")) & _col(c).rlike(K.URL_ESCAPE)


def url_decode_lenient(c) -> Column:
    """Percent-decode; a malformed ``%`` and every ``+`` stay as they are."""
    kept = F.regexp_replace(_col(c), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))


def has_hex_escapes(c) -> Column:
    return F.contains(_col(c), F.lit("\\x")) & _col(c).rlike(K.HEX_ESCAPE)


def decode_hex_escapes(c) -> Column:
    """Each ``\\xHH`` becomes the Latin-1 character HH."""
    pieces = F.split(_col(c), f"(?={K.HEX_ESCAPE})")

    def decode(piece: Column) -> Column:
        char = F.char(F.conv(F.substring(piece, 3, 2), 16, 10).cast("int"))
        tail = F.substring(piece, 5, 2147483647)
        return F.when(piece.rlike(rf"\A{K.HEX_ESCAPE}"), F.concat(char, tail)).otherwise(piece)

    return F.array_join(F.transform(pieces, decode), "")


def rot13(c) -> Column:
    return F.translate(_col(c), _ROT13_FROM, _ROT13_TO)


def letters_only(c) -> Column:
    return F.regexp_replace(_col(c), r"\P{L}++", "")


# --- look-alike and invisible characters ---------------------------------------------------
def _char_count(c, chars: str) -> Column:
    # An ASCII-only text (bytes = characters) holds none of them; a regex only counts those there are.
    text = _col(c)
    ascii_only = F.octet_length(text) == F.length(text)
    held = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in chars])
    return F.when(ascii_only | ~held, F.lit(0)).otherwise(F.regexp_count(text, F.lit(f"[{chars}]")))


def zero_width_count(c) -> Column:
    return _char_count(c, K.ZERO_WIDTH)


def strip_zero_width(c) -> Column:
    return F.regexp_replace(_col(c), f"[{K.ZERO_WIDTH}]+", "")


def confusable_count(c) -> Column:
    return _char_count(c, K.CONFUSABLES)


# --- phrases and words ---------------------------------------------------------------------
_ROTATE = str.maketrans(_ROT13_FROM, _ROT13_TO)
_PLAIN_NEEDS = [required_words(p, unicode_spaces=True) for p in K.SUSPICIOUS_PHRASES]
_ROT13_NEEDS = [
    required_words(p, lambda word: word.translate(_ROTATE), unicode_spaces=True) for p in K.SUSPICIOUS_PHRASES
]


def suspicious_phrase(c, opened=lambda i: None) -> Column:
    """Text of the first phrase pattern, in list order, that matches; NULL if none does.

    Phrases fold case and white space by Unicode. ``opened`` may name a necessary condition for a phrase.
    """
    found = [F.regexp_extract(_col(c), f"(?U)(?i){p}", 0) for p in K.SUSPICIOUS_PHRASES]
    gates = [opened(i) for i in range(len(found))]
    gated = F.array(*[f if gate is None else F.when(gate, f) for f, gate in zip(found, gates)])
    # Through an array: NULLIF would run each regex twice.
    return F.get(F.filter(gated, lambda phrase: phrase != ""), F.lit(0))


# Gates of a text, numbered on: phrases whose words it holds, those whose rotated ones; both on its letters alone; a
# base64 run; a letter that folds to an ASCII one, which opens all phrases.
SCAN_NEEDS = _PLAIN_NEEDS + _ROT13_NEEDS
SCAN_VIEWS = (letters_view(SCAN_NEEDS), run_view(string.ascii_letters + string.digits + "+/", 20), FOLDING_VIEW)
_BASE64 = 2 * len(SCAN_NEEDS)
_FOLDS = _BASE64 + 1


def phrase_gates(c) -> Column:
    """What the ``gated_`` functions test, numbered from 0. They take the column of gates by name, and ``first``,
    the number of the first one where others come before."""
    return open_gates(_col(c), SCAN_NEEDS, SCAN_VIEWS)


def _opened(gates: str, number: int) -> Column:
    return F.array_contains(gates, F.lit(number))


def gated_phrase(c: str, gates: str, first: int, rotated: bool = False, letters: bool = False) -> Column:
    """``suspicious_phrase(c)`` (or of its rot13), ``c`` a text or, with ``letters``, its letters."""
    folds = _opened(gates, first + _FOLDS)
    n = len(_PLAIN_NEEDS)
    at = first + (len(SCAN_NEEDS) if letters else 0) + (n if rotated else 0)
    some = F.exists(F.col(gates), lambda g: (g >= at) & (g < at + n))
    phrase = suspicious_phrase(rot13(c) if rotated else c, lambda i: _opened(gates, at + i) | folds)
    return F.when(some | folds, phrase)


def gated_letters(c: str, gates: str, first: int) -> Column:
    """``letters_only(c)`` where these may hold a phrase, plain or rotated; else NULL."""
    at = first + len(SCAN_NEEDS)
    some = F.exists(F.col(gates), lambda g: (g >= at) & (g < at + len(SCAN_NEEDS)))
    return F.when(some | _opened(gates, first + _FOLDS), letters_only(c))


def gated_base64(c: str, gates: str, first: int) -> Column:
    """``count_base64(c)``, 0 without a run that is long enough."""
    return F.when(F.col(gates).isNotNull(), F.when(_opened(gates, first + _BASE64), count_base64(c)).otherwise(0))


def count_occurrences(c, needles) -> Column:
    """Sum over needles of their non-overlapping occurrences.

    A fold over a literal array keeps the generated code small however long the word list; a
    needle that does not occur costs one byte scan.
    """
    text = _col(c)

    def add(total: Column, needle: Column) -> Column:
        removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
        times = (removed / F.length(needle)).cast("int")
        return total + F.when(F.contains(text, needle), times).otherwise(0)

    return F.aggregate(F.array(*[F.lit(n) for n in needles]), F.lit(0), add)


def tokens_estimate(c) -> Column:
    """Token estimate for telemetry, never for enforcement; NULL on empty text.

    Counts words of at most 8 letters per piece, digit groups of 3, and punctuation runs.
    """
    text = _col(c)
    pieces = F.regexp_count(text, F.lit(r"[\p{L}\p{M}]{1,8}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]{1,4}"))
    return F.when(F.length(text) > 0, pieces)


# --- clean-up ------------------------------------------------------------------------------
def redact(c) -> Column:
    """Mask API keys and bearer tokens. The longer key prefix goes first, so no key tail is
    left behind."""
    return reduce(
        lambda text, p: F.regexp_replace(text, p, F.lit(K.REDACTED)), K.SECRET_PATTERNS, _col(c)
    )


def redact_headers(m) -> Column:
    return F.transform_values(
        _col(m),
        lambda k, v: F.when(F.lower(k).isin(*K.SECRET_HEADERS), F.lit(K.REDACTED)).otherwise(v),
    )


def normalize_category(c) -> Column:
    return F.replace(_col(c), F.lit("_"), F.lit("-"))


def sanitize_label(c) -> Column:
    return F.left(F.regexp_replace(_col(c), _NOT_PRINTABLE, ""), F.lit(K.LABEL_LIMIT))


def sse_data(c) -> Column:
    """Payloads of the ``data: `` lines of a chunk joined by a space, without ``[DONE]``."""
    lines = F.filter(F.split(_col(c), "\n"), lambda x: x.startswith("data: "))
    payload = F.transform(lines, lambda x: F.substring(x, 7, 2147483647))
    return F.array_join(F.filter(payload, lambda x: x != "[DONE]"), " ")


def glob_to_regex(pattern: str) -> str:
    """Anchored Java regex of a shell glob."""
    import fnmatch

    return fnmatch.translate(pattern).replace(r"\Z", r"\z")
