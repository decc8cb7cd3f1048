"""Runs of repeating words, found on a Re-Pair grammar of the text.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest period q (words q
apart are the same) of at least ``max(least, 3 * q)`` words that no neighbouring word extends. A word
is dropped if a run holds it after that run's first q words; the rest is the collapsed text.

1. Grammar. The word numbers of a block of texts are rewritten by Re-Pair: pairs that occur twice or
   more are replaced by nonterminals, the more frequent pair first, until no pair occurs twice. A
   round replaces at once all pairs that are more frequent than the pairs they overlap. Word numbers
   are told apart by text, so no pair ever spans two texts. What is left of a text is closed by a
   balanced binary tree over its symbols.
2. Runs. The least node of the parse tree that holds a run has its boundary inside the run. So every
   nonterminal is searched once, at its first place: for each period the words on both sides of its
   boundary are compared by hashes of four words, and what agrees is extended by hashes of
   prefixes, no further than the nonterminal, and then compared word by word (a wrong hash
   costs time only).
3. Places. A stretch found in a nonterminal is carried to all places that derive from it. A place
   where a neighbouring word goes on with the period is dropped: a larger nonterminal has it in
   full. What is left are the maximal stretches, each once, with its least period.

Work is n log n for a text of n words; memory is about 200 bytes a word of the longest text and is
bounded for all others by the block. No shuffle.

Nulls and ties: a NULL text has no words and no run. Rows are judged one by one, repeated ids too;
a NULL doc_id stays NULL. Other columns of the table are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import BASE, INVERSE, blocks, mixed, prepared, texts_of, values_of

LEAST = 24
RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Boundary tests made at a time.
TESTS = 1 << 21
#: Words whose hash is compared first. Of a run's two parts the larger one agrees with itself,
#: a period further, in at least 4 words: max(least, 3q) / 2 - q for least = 24.
GRAM = 4

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, different in different texts, and the first place of every text (and the end)."""
    ids, first, base = [], [0], 0
    for words in texts:
        if words:
            coded = pa.array(words, pa.binary()).dictionary_encode()
            ids.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + base)
            base += len(coded.dictionary)
        first.append(first[-1] + len(words))
    return np.concatenate(ids) if ids else np.empty(0, np.int64), np.array(first, np.int64)


def grammar(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair. Rows (rule, start, middle, end) of all places of nonterminals with at least
    ``least`` words, and the places of the symbols that are left."""
    n = len(ids)
    symbols, at, top = ids.copy(), np.arange(n + 1), int(ids.max(initial=-1)) + 1
    alive = np.ones(max(0, n - 1), bool)
    found = [np.empty((0, 4), np.int64)]
    while True:
        place = np.flatnonzero(alive)
        _, pair, count = np.unique(symbols[place] * np.int64(top) + symbols[place + 1], return_inverse=True, return_counts=True)
        # A pair that occurs once never occurs twice later: only pairs with a new symbol are new.
        twice = count[pair] >= 2
        alive[place[~twice]] = False
        place, pair = place[twice], pair[twice]
        if not len(place):
            break
        order = np.lexsort((mixed(np.arange(len(count), dtype=np.uint64)), count))
        rank = np.empty(len(count), np.int64)
        rank[order] = np.arange(len(count))
        ranks = np.full(len(symbols) + 1, -1)
        ranks[place + 1] = rank[pair]
        own = ranks[place + 1]
        best = (own >= ranks[place]) & (own >= ranks[place + 2])
        place, pair = place[best], pair[best]
        # Neighbours among these are one pair that overlaps itself: every other one is replaced.
        begins = np.diff(place, prepend=-2) != 1
        origin = place[begins][np.cumsum(begins) - 1]
        every = (place - origin) % 2 == 0
        place, pair = place[every], pair[every]
        _, rule = np.unique(pair, return_inverse=True)
        start, middle, end = at[place], at[place + 1], at[place + 2]
        long = end - start >= least
        found.append(np.column_stack([rule + top, start, middle, end])[long])
        symbols[place] = rule + top
        top += int(rule.max()) + 1
        alive[place] = True
        alive[place[place > 0] - 1] = True
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, at = symbols[keep], np.append(at[:-1][keep], n)
        alive = alive[keep[:-1]][: len(symbols) - 1]
    return np.concatenate(found), at[:-1]


def closed(at: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, middle, end) of balanced binary trees over the symbols of every text."""
    n, found = int(first[-1]), [np.empty((0, 3), np.int64)]
    while True:
        text = np.searchsorted(first, at, "right")
        begins = np.diff(text, prepend=-1) != 0
        number = np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(at) else np.empty(0, np.int64)
        ends = np.append(at, n)
        left = np.flatnonzero((number[:-1] % 2 == 0) & (text[1:] == text[:-1])) if len(at) else np.empty(0, np.int64)
        if not len(left):
            return np.concatenate(found)
        rows = np.column_stack([at[left], at[left + 1], ends[left + 2]])
        found.append(rows[rows[:, 2] - rows[:, 0] >= least])
        at = at[number % 2 == 0]


class _Hashes:
    """Compares stretches of words by hashes of prefixes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        words = mixed(ids.astype(np.uint64) + np.uint64(1))
        self.up, self.down = np.full(n + 1, BASE), np.full(n + 1, INVERSE)
        self.up[0] = self.down[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], out=self.sums[1:])
        size = max(0, n - GRAM + 1)
        self.gram = (self.sums[GRAM: GRAM + size] - self.sums[:size]) * self.down[:size]

    def same(self, i: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether [i, i + size) is [i + p, i + p + size)."""
        left, right = self.sums[i + size] - self.sums[i], self.sums[i + p + size] - self.sums[i + p]
        return left * self.up[p] == right

    def longest(self, i: np.ndarray, p: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """Largest size up to ``limit`` for which the words from i on (or, ``back``, before i) and
        those p further agree."""
        low, high = np.zeros_like(limit), limit.copy()
        while (low < high).any():
            size = (low + high + 1) >> 1
            agree = self.same(i - size if back else i, p, size)
            low, high = np.where(agree, size, low), np.where(agree, high, size - 1)
        return low


def _tests(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, period) for periods 1 to ``count`` of every node, TESTS or one node at a time."""
    upto, at = np.cumsum(count), 0
    while at < len(count):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + TESTS, "right")))
        node = np.repeat(np.arange(at, end), count[at:end])
        yield node, np.arange(len(node)) - np.repeat(upto[at:end] - count[at:end] - done, count[at:end]) + 1
        at = end


def crossing(ids: np.ndarray, nodes: np.ndarray, least: int) -> np.ndarray:
    """Rows (node, start, end, period), relative to the node's start, of stretches that cross the
    boundary of a node (start, middle, end), are as long as a run and cannot be extended in it."""
    hashes, found = _Hashes(ids), [np.empty((0, 4), np.int64)]
    a, m, b = nodes.T
    thirds = (b - a) // 3
    for right in (True, False):
        # The larger part of a run is right (or left) of the boundary, 1.5 periods at least.
        side = b - m if right else m - a
        for node, p in _tests(np.maximum(0, np.minimum(side * 2 // 3, thirds))):
            own = m[node]
            if right:
                fits = own + p + GRAM <= b[node]
                node, p, own = node[fits], p[fits], own[fits]
                agree = hashes.gram[own] == hashes.gram[own + p]
            else:
                fits = own - p - GRAM >= a[node]
                node, p, own = node[fits], p[fits], own[fits]
                agree = hashes.gram[own - GRAM] == hashes.gram[own - GRAM - p]
            node, p = node[agree], p[agree]
            i = m[node] if right else m[node] - p
            start = i - hashes.longest(i, p, i - a[node], True)
            end = i + p + hashes.longest(i, p, b[node] - i - p, False)
            found.append(_confirmed(ids, nodes, least, np.column_stack([node, start, end, p]), i))
    return _least_period(np.concatenate(found))


def _confirmed(ids: np.ndarray, nodes: np.ndarray, least: int, rows: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The stretches (node, start, end, period) around ``i`` that cross and are long enough, each
    with its least period and relative to its node, after a comparison word by word."""
    def fine(rows):
        a, m, _ = nodes[rows[:, 0]].T
        node, s, e, p = rows.T
        rows = np.column_stack([node, s - a, e - a, p])
        return _least_period(rows[(s < m) & (m < e) & (e - s >= np.maximum(least, 3 * p))])

    def differ(start, end, p):
        return np.flatnonzero(ids[start: end - p] != ids[start + p: end]) + start

    kept = fine(rows)
    for node, s, e, p in kept.tolist():
        a = int(nodes[node, 0])
        if len(differ(a + s, a + e, p)):
            break
    else:
        return kept
    for k, (_, s, e, p) in enumerate(rows.tolist()):
        wrong = differ(s, e, p)
        rows[k, 1] = max(wrong[wrong < i[k]], default=s - 1) + 1
        rows[k, 2] = min(wrong[wrong >= i[k]], default=e - p) + p
    return fine(rows)


def _least_period(rows: np.ndarray) -> np.ndarray:
    """One row for each stretch, with the least of its periods."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(1)
    return rows[new]


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of numbered texts, in the order of their starts."""
    if not len(ids):
        return np.empty((0, 3), np.int64)
    rules, at = grammar(ids, least)
    rules = rules[np.lexsort((rules[:, 1], rules[:, 0]))]
    new = np.diff(rules[:, 0], prepend=-1) != 0
    tree = closed(at, first, least)
    nodes = np.concatenate([rules[new][:, 1:], tree])
    place_of = np.concatenate([rules[:, 1], tree[:, 0]])
    begin = np.concatenate([np.flatnonzero(new), len(rules) + np.arange(len(tree)), [len(place_of)]])
    inside = crossing(ids, nodes, least)
    node, s, e, p = inside.T
    times = begin[node + 1] - begin[node]
    which = np.repeat(np.arange(len(node)), times)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    place = place_of[begin[node[which]] + offset]
    s, e, p = place + s[which], place + e[which], p[which]
    edged = np.concatenate([[-1], ids, [-2]])
    maximal = (edged[s] != edged[s + p]) & (edged[e + 1] != edged[e + 1 - p])
    return _least_period(np.column_stack([s, e, p])[maximal])


def _run(least: int, rewrite: Rewrite | None):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(kind)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = texts_of(batch), values_of(batch, "doc_id")
            for start, end in blocks(texts):
                words = [t.split() for t in texts[start:end]]
                if rewrite:
                    words = [rewrite(i, w) for i, w in zip(names[start:end], words)]
                ids, first = numbered(words)
                runs = runs_of(ids, first, least)
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 1], -1)
                kept = np.cumsum(change[:-1]) == 0
                bounds = np.searchsorted(runs[:, 0], first)
                found, texts_left = [], []
                for k, own in enumerate(words):
                    rows = runs[bounds[k]: bounds[k + 1]] - [first[k], first[k], 0]
                    found.append([(s, e - s, p) for s, e, p in sorted(rows.tolist(), key=lambda r: (r[0], r[2]))])
                    if len(rows):
                        own = [own[j] for j in np.flatnonzero(kept[first[k]: first[k + 1]])]
                    texts_left.append(b" ".join(own))
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[start:end], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in rows] for rows in found], pa.list_(kind)),
                    pa.array(texts_left, pa.binary()).cast(pa.string()),
                ], schema=schema)
    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the collapsed text of every
    row. ``rewrite`` (doc_id, words) -> words is applied to the words first. ``least`` must be 24
    or more: the first comparison needs it."""
    if least < LEAST:
        raise ValueError(f"runs have {LEAST} words at least")
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_run(least, rewrite), RUNS)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest length/period, and digests of runs and collapsed text."""
    def better(best, r):
        now, then = r["length"].cast("decimal(19,0)") * best["period"], best["length"].cast("decimal(19,0)") * r["period"]
        return F.when(best.isNull() | (now > then) | ((now == then) & (
            (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"])))), r).otherwise(best)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, better).alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
