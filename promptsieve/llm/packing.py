"""Packing into training sequences by order-preserving dynamic programming.

Every task packs its own documents in input order: their ids form one stream, cut into windows
of at most ``limit`` ids. A window may start at a document, at a sentence, and within a stretch
of more than GAP ids without a sentence end at every GAP ids. The cost of a plan is its padding
(``limit`` less the window's length; none for half or quarter windows, which count OFF_SIZE)
plus a penalty for each start that is inside a document (SENTENCE) or inside a sentence (INSIDE).

With positions p and best costs f, f[i] = penalty[i] + limit - p[i] + min(f[j] + p[j]) over the
starts j within ``limit`` before i, and the minimum of a sliding range is kept in a monotone
queue: each start enters and leaves it once. Plans are made for stretches of about STRETCH ids;
the last window of a stretch is packed again with what follows, so memory is bounded and only
the last window of a task is cut short by the end of its input.

Token ids are those of a byte-level BPE vocabulary file (its path is a parameter), without
special tokens, then the id ``end``. A NULL text is empty and has the id ``end`` alone. Rows are
packed one by one, also repeated ones; sequence ids are unique by input partition.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import prepared, texts_of, values_of

LIMIT, END = 2048, 1
SENTENCE, INSIDE, OFF_SIZE = 2.0, 24.0, 8.0
GAP, STRETCH = 64, 1 << 19
CACHE = 600_000
#: How the vocabulary's libraries split a text before BPE (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


class Encoder(dict):
    """Token ids, as little-endian 32-bit bytes, of words that follow a blank; a bounded memo.

    A blank before a non-blank starts a new pre-token, so a text without longer runs of white
    space around blanks is the concatenation of its words' ids. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.plain = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ends = np.zeros(max(max(ranks.values()), *self.special.values(), END) + 1, bool)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in token

    def whole(self, text: str) -> bytes:
        ids: list[int] = []
        for part in self.parts.split(text) if self.parts else [text]:
            ids += [self.special[part]] if part in self.special else self.plain(part)
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = self.whole(" " + word)
        return ids

    def encode(self, text: str) -> bytes:
        if re.search(r" (?:\s|$)", text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def best_cuts(position: list[int], penalty: list[float], limit: int) -> list[int]:
    """Indices of the chosen starts. Positions are increasing, start with 0, and are at most
    ``limit`` apart; the last one is the end of the stretch."""
    n = len(position)
    place = np.array(position)
    exact: dict[int, list[int]] = {}
    for size in (limit // 2, limit // 4):
        before = np.searchsorted(place, place - size)
        for i in np.flatnonzero((place >= size) & (place[np.minimum(before, n - 1)] == place - size)).tolist():
            exact.setdefault(i, []).append(int(before[i]))
    cost, back, weight = [0.0] * n, [0] * n, [0.0] * n
    queue: deque[int] = deque([0])
    for i in range(1, n):
        p = position[i]
        while position[queue[0]] < p - limit:
            queue.popleft()
        j = queue[0]
        best = weight[j] + limit - p
        if i in exact:
            for k in exact[i]:
                if cost[k] + OFF_SIZE < best:
                    best, j = cost[k] + OFF_SIZE, k
        back[i] = j
        cost[i] = best = best + penalty[i]
        weight[i] = w = best + p
        while queue and weight[queue[-1]] >= w:
            queue.pop()
        queue.append(i)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def starts(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Allowed starts and their penalties; ``ends`` are the documents' ends in the stream."""
    n = len(ids)
    kind = np.full(n + 1, 2, np.int8)
    kind[1:][sentence_end[ids]] = 1
    kind[0] = 0
    kind[ends] = 0
    place = np.flatnonzero(kind < 2)
    gaps = np.diff(place)
    wide = np.flatnonzero(gaps > GAP)
    extra = [np.arange(place[i] + GAP, place[i + 1], GAP) for i in wide]
    place = np.unique(np.concatenate([place, *extra]))
    return place, np.array([0.0, SENTENCE, INSIDE])[kind[place]]


def _pack(path: str, limit: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, ids before, ids, doc_tokens)
        size = 0
        end = np.array([END], "<u4").tobytes()

        def flush(last: bool):
            nonlocal held, size, sequence
            ids = np.frombuffer(b"".join(h[2] for h in held), "<u4")
            ends = np.cumsum([len(h[2]) // 4 for h in held])
            begins = np.concatenate([[0], ends[:-1]])
            place, penalty = starts(ids, ends, codec.ends)
            cuts = place[best_cuts(place.tolist(), penalty.tolist(), limit)]
            keep = [] if last or len(cuts) < 3 else held
            stop = cuts[-1] if last or len(cuts) < 3 else cuts[-2]
            edges = np.union1d(cuts[cuts <= stop], ends[ends <= stop])
            low, high = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, low, "right")
            window = np.searchsorted(cuts, low, "right") - 1
            skipped = np.array([h[1] for h in held])
            rows = pa.RecordBatch.from_arrays([
                pa.array([held[d][0] for d in doc], pa.int64()),
                pa.array(low - begins[doc] + skipped[doc]), pa.array(high - low),
                pa.array([ids[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist())], pa.binary()),
                pa.array([held[d][3] for d in doc], pa.int64()),
                pa.array(window + sequence), pa.array(low - cuts[window]),
            ], schema=schema)
            sequence += int(window[-1]) + 1
            rest = []
            for (doc_id, before, own, total), a, b in zip(keep, begins, ends):
                if b > stop:
                    cut = max(0, int(stop - a))
                    rest.append((doc_id, before + cut, own[4 * cut:], total))
            held, size = rest, sum(len(h[2]) // 4 for h in rest)
            return rows

        for batch in batches:
            for doc_id, text in zip(values_of(batch, "doc_id"), values_of(batch, "text")):
                own = (codec.encode(text) if text else b"") + end
                total, at = len(own) // 4, 0
                while at < total:
                    part = own[4 * at: 4 * (at + STRETCH)]
                    held.append((doc_id, at, part, total))
                    size += len(part) // 4
                    at += STRETCH
                    if size >= STRETCH:
                        yield flush(False)
        if held:
            yield flush(True)
    return run


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32 bits), doc_tokens, sequence_id, offset."""
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(path, limit), PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
