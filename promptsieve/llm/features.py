"""Hashed words and structure statistics of texts, for the classifiers.

Everything is computed from the text: no language, source, id or label goes in. Blocks of about
1 MB are read at a time with array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from promptsieve.llm.common import NON_SPACE, Words, word_table

UPPER, DIGIT = word_table(b"AZ"), word_table(b"09")
MARK = word_table(b"!/:@[`{~")
HIGH = word_table(b"\x80\xff")
STATISTICS = ("length", "words", "upper", "digits", "marks", "exclamations", "bars", "high", "word_length", "distinct",
              "top_word", "repeated", "lines", "repeated_lines", "line_words", "longest_run")


@dataclass
class Sparse:
    """Rows of (index, value), flat: row ``i`` is ``start[i]:start[i + 1]``."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _runs(doc: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])


class Block:
    """Words of a block of texts and what is derived from them."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.words = Words(texts, NON_SPACE)
        w = self.words
        order = np.lexsort((w.hash, w.doc))
        doc, h = w.doc[order], w.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        #: Different words of each document: document, first word's position, occurrences.
        self.doc, self.at = doc[at], order[at]
        self.times = np.diff(np.append(at, len(h)))
        self.texts = texts

    def counts(self, bits: int) -> Sparse:
        """Hashed words with log counts, each row scaled to length 1."""
        value = np.log1p(self.times).astype(np.float32)
        norm = np.sqrt(np.bincount(self.doc, value * value, minlength=self.n))
        index = (self.words.hash[self.at] >> np.uint64(64 - bits)).astype(np.int32)
        return Sparse(_runs(self.doc, self.n), index, value / norm[self.doc].astype(np.float32))

    def statistics(self) -> np.ndarray:
        """One row of STATISTICS per text; zeros for an empty one."""
        w, n = self.words, self.n
        raw = np.frombuffer(w.raw, np.uint8)
        bound = w.first[:-1]
        size = np.diff(w.first) - 1
        share = np.maximum(size, 1)

        def count(table):
            return np.add.reduceat(table[raw], bound, dtype=np.int64) if n else np.zeros(0)

        words = np.bincount(w.doc, minlength=n)
        some = np.maximum(words, 1)
        top = np.zeros(n)
        np.maximum.at(top, self.doc, self.times)
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        lines, repeated, longest = np.zeros(n), np.zeros(n), np.zeros(n)
        for i, t in enumerate(self.texts):
            own = t.split(b"\n")
            lines[i], repeated[i] = len(own), len(own) - len(set(own))
        length = w.end - w.start
        np.maximum.at(longest, w.doc, length)
        columns = [
            np.log1p(size) / 10, np.log1p(words) / 10, count(UPPER) / share, count(DIGIT) / share, count(MARK) / share,
            count(word_table(b"!!")) / share, count(word_table(b"||")) / share, count(HIGH) / share,
            np.bincount(w.doc, length, minlength=n) / some / 10, np.bincount(self.doc, minlength=n) / some, top / some,
            np.bincount(w.doc, same, minlength=n) / some, np.log1p(lines) / 10, repeated / np.maximum(lines, 1),
            np.log1p(words / np.maximum(lines, 1)) / 10, np.log1p(longest) / 10,
        ]
        return np.stack(columns, axis=1).astype(np.float32)

    def pieces(self, bits: int, lengths: tuple[int, ...]) -> Sparse:
        """Different hashed words and word beginnings of each document, with value 1."""
        w = self.words
        start, end = w.start[self.at], w.end[self.at]
        docs, found = [self.doc], [w.hash[self.at]]
        for k in lengths:
            long = end - start > k
            docs.append(self.doc[long])
            found.append(w.hashed(start[long], start[long] + k) ^ np.uint64(k))
        doc = np.concatenate(docs).astype(np.uint64)
        index = np.concatenate(found) >> np.uint64(64 - bits)
        both = np.unique((doc << np.uint64(bits)) | index)
        doc = (both >> np.uint64(bits)).astype(np.int64)
        index = (both & np.uint64((1 << bits) - 1)).astype(np.int32)
        return Sparse(_runs(doc, self.n), index, np.ones(len(index), np.float32))


def row_sums(start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of each row's entries (along the first axis); 0 for a row without any."""
    padded = np.concatenate([value, np.zeros((1, *value.shape[1:]), value.dtype)])
    sums = np.add.reduceat(padded, start[:-1], axis=0) if len(start) > 1 else padded[:0]
    sums[start[:-1] == start[1:]] = 0
    return sums
