"""Language-model scores by logistic context mixing.

A text is the stream of its tokens: words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased), each followed by
a blank, then one end. It is coded bit by bit. Five predictors look up how often the next bit was
1 after the last 1, 2, 3, 4 or 6 bytes of the token, hashed with the bits of the byte so far; a
sixth one counts the tokens of the vocabulary that begin alike, exactly. Their log odds are mixed
by weights from a set that is chosen by how often the beginning was seen and the position in the
token and in the byte (the gate), and the mixed odds are refined by an adaptive map from (bits so
far, odds) to what came. The sum of -log2 of the bits' probabilities is the
cost of the text; per byte of its stream it is the ``bits per byte``.

No context of these crosses a token, so a token costs the same wherever it stands, and this work is
done once for each different token of the corpus. Above it come contexts of tokens: what followed the
last token and the last two in all training texts, then what followed earlier in this text after
nothing, the last token and the last two. They are mixed in, in turn, as
P = w * (share among the followers) + (1 - w) * P. Each w is logistic in a weight chosen by how often
the context was seen and, in the text, how many different tokens followed it or, of two tokens in the
corpus, how often the later one was seen (the gate). Every step adds up to one over all tokens, so
scores stay log probabilities. The token before a text's first is the end of another.

1. Documents are cut into blocks of about BLOCK bytes; each gives its different tokens with their
   training counts, and its documents as token numbers (a row, written to the shared folder).
2. Token counts are summed over all blocks: the vocabulary, sorted, and dealt by the first PREFIX
   bytes, so that all tokens with a longer beginning in common are in one task.
3. Every vocabulary task fills count tables (of fixed sizes, parameters) from its tokens, weighted
   by their counts; the tables are summed by slot.
4. Every vocabulary task passes once over its tokens, learning online: weights move after each
   part of the stream, and the counts exclude the very occurrence that is predicted. The learned
   weights are averaged and the maps summed.
5. Every token is scored, and the scores go back to the blocks. So do the training counts of all
   pairs and triples of tokens: each block gives its different ones by a hash, as wide as the
   corpus asks for (``gram_bits``), with their counts, dealt by the hash into parts of about DEALT;
   they are summed there, none is left out. Blocks are written with scores and counts, a row each.
6. Tasks read these documents in parts of about TEXT_PART tokens and learn the weights of the
   contexts of tokens online from the training ones, whose counts exclude the very occurrence;
   they are averaged, and all are scored.

Only the tables and weights, whose sizes are fixed, come to the driver and are sent to tasks.
Documents outside the training folds are scored alike and never counted. The base score is the
add-a-half unigram model over the same tokens.

NULL is an empty text: one end. A NULL doc_id counts as training. Repeated rows count as often as
they come. Without training documents the counts are zero and scores are those of empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import fold, mixed, powers, prepared, ranges, saved, texts_of, values_of

BLOCK = 11 << 20
#: Bytes of the predictors' contexts, and slots of their tables as powers of two.
BYTES = (1, 2, 3, 4, 6)
SLOTS = (16, 17, 18, 19, 20)
CHUNK = 14
PART = 1 << 16
PREFIX = 3
RATE, PRIOR = 0.05, 0.4
#: First weights: of the five contexts, the beginning, and the constant.
START = (0.05, 0.05, 0.1, 0.1, 0.1, 0.7, 0.0)
#: Least counts of a beginning for the second and further gates.
LEVELS = (1, 3, 9, 65, 1025)
GATES, STEPS = 64 * (len(LEVELS) + 1), 24
NODE = np.uint64(0x9FB21C651E98DF25)
TOKENS = ("block long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, ids binary, words array<string>, "
          "train array<long>")
#: Contexts of 0 to 2 earlier tokens of the same text, and their first weights.
ORDERS, TEXT_START = 3, (-2.0, -1.0, 0.0)
#: First weights of the corpus' contexts of one and two earlier tokens, and pairs and triples of a part.
CORPUS_START, DEALT = (0.0, 0.0), 1 << 20
PAIR, TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Levels of a context's count and of its followers, and the gates of an order.
TIMES = (2, 3, 4, 6, 10, 20, 40, 80, 160, 320, 640, 1280)
LEVEL_OF = np.searchsorted(TIMES, np.arange(TIMES[-1] + 1), "right")
FOLLOWERS = (0.1, 0.25, 0.45, 0.65, 0.8, 0.9, 0.99)
TEXT_GATES = (len(TIMES) + 1) * (len(FOLLOWERS) + 1)
TEXT_PART = 1 << 16
#: Log probability of a token below which it is kept apart, as numbers end there.
LEAST_LOG = -600.0
#: Scored words that a task packs together, and their columns.
PLACES, FORMS = 1 << 20, ("place", "c", "score", "bytes")
TEXTS = ("doc_id array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base_score array<double>, "
         "bytes array<long>, ids binary, alone binary, counts binary, pairs binary, triples binary")
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double, bits_per_byte double")


def packed(values: np.ndarray, form: str = "<u4") -> bytes:
    """Numbers by byte planes: the high ones of small numbers are zero and compress away."""
    return np.ascontiguousarray(values, form).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpacked(raw: bytes, form: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(form).itemsize, -1).T).view(form).ravel()


def pressed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed by byte planes; as many planes as the largest one needs."""
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return bytes([planes]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpressed(raw: bytes) -> np.ndarray:
    planes, size = raw[0], int.from_bytes(raw[1:9], "little")
    data = np.frombuffer(pa.decompress(raw[9:], size, "zstd", asbytes=True), np.uint8).reshape(planes, -1)
    values = np.zeros((data.shape[1], 8), np.uint8)
    values[:, :planes] = data.T
    return values.view("<i8").ravel()


def _bits_of(scores: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(scores, "<f4").view("<u4")


def _tokenise(folds: int, held: int):
    schema = pa.schema([
        ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())),
        ("ids", pa.binary()), ("words", pa.list_(pa.string())), ("train", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            doc_ids, column = values_of(batch, "doc_id"), batch.column(batch.schema.get_field_index("text"))
            for low, high in ranges(pc.fill_null(pc.binary_length(column), 0).to_pylist(), BLOCK):
                split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.slice(low, high - low), "")))
                words = split.flatten()
                # A text that begins or ends with a blank has an empty word there.
                real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
                owner = np.repeat(np.arange(high - low), pc.list_value_length(split).to_numpy(zero_copy_only=False))
                lengths = np.bincount(owner[real], minlength=high - low) + 1
                coded = words.filter(pa.array(real)).dictionary_encode()
                number = len(coded.dictionary)
                ids, inner = np.full(int(lengths.sum()), number, np.uint32), np.ones(int(lengths.sum()), bool)
                inner[np.cumsum(lengths) - 1] = False
                ids[inner] = coded.indices.to_numpy(zero_copy_only=False)
                held_out = [fold(i, folds) == held for i in doc_ids[low:high]]
                train = np.bincount(ids[np.repeat(~np.array(held_out), lengths)], minlength=number + 1)
                words = pa.concat_arrays([coded.dictionary, pa.array(["\n"], coded.dictionary.type)])
                row = (block, doc_ids[low:high], held_out, lengths, pressed(ids), words, train)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays([0, len(c)], pa.array(c).cast(f.type.value_type)) if isinstance(c, (np.ndarray, pa.Array))
                    else pa.array([c], f.type) for c, f in zip(row, schema)], schema=schema)
                block += 1
    return run


class Events:
    """All (byte, bit) events of a sorted list of tokens as arrays, in stream order of their
    bytes. The list holds whole groups of tokens with the same first PREFIX bytes."""

    def __init__(self, tokens: list[bytes], counts: np.ndarray):
        stream = [t if t == b"\n" else t + b" " for t in tokens]
        self.length = np.array([len(t) for t in stream], np.int64)
        buf = np.frombuffer(b"".join(stream), np.uint8)
        self.first = np.cumsum(self.length) - self.length
        self.token = np.repeat(np.arange(len(tokens)), self.length)
        place = np.arange(len(buf)) - self.first[self.token]
        self.byte = buf.astype(np.int64)
        self.weight = counts[self.token]
        self.depth = np.minimum(place, 7)
        context, self.context = np.zeros(len(buf), np.uint64), []
        for k in range(1, max(BYTES) + 1):
            shifted = np.zeros(len(buf), np.uint64)
            shifted[k:] = buf[:-k].astype(np.uint64) + np.uint64(1)
            shifted[place < k] = 0
            context = context * np.uint64(257) + shifted
            if k in BYTES:
                self.context.append(mixed(context + np.uint64(k << 60)))
        self._share(self._beginnings(counts))

    def _share(self, common: np.ndarray) -> None:
        """Bytes of a beginning that the token before has too are the same events: they are worked
        on once, at the first token (``kept``), with the sum of the weights (``mass``)."""
        shared = np.append(0, common // 8)
        owner, alive = np.arange(len(self.byte)), np.arange(len(self.length))
        for k in range(int(shared.max(initial=0))):
            alive = alive[self.length[alive] > k]
            at = self.first[alive] + k
            owner[at] = at[np.maximum.accumulate(np.where(shared[alive] <= k, np.arange(len(at)), 0))]
        first = owner == np.arange(len(owner))
        self.kept = np.flatnonzero(first)
        self.owner = (np.cumsum(first) - 1)[owner]
        self.mass = np.bincount(self.owner, self.weight, len(self.kept))

    def _beginnings(self, counts: np.ndarray) -> np.ndarray:
        """``alike`` and ``same``, by bit and byte: training occurrences of tokens that begin
        alike up to this bit, and those among them that go on with the same bit. A beginning
        that only one token has is that token's count; shorter ones than PREFIX are left out. Gives
        the number of bits that each token has in common with the next."""
        n, byte, first, length = len(self.length), self.byte, self.first, self.length
        common = np.zeros(max(0, n - 1), np.int64)
        pair, k = np.arange(n - 1), 0
        while len(pair):
            a, b = byte[first[pair] + k], byte[first[pair + 1] + k]
            differ = a ^ b
            ends = differ > 0
            common[pair[ends]] = 8 * k + 8 - np.frexp(differ[ends].astype(np.float64))[1]
            k += 1
            pair = pair[~ends]
            over = np.minimum(length[pair], length[pair + 1]) <= k
            common[pair[over]] = 8 * k
            pair = pair[~over]
        self.alike = np.tile(np.where(np.arange(len(byte)) - first[self.token] >= PREFIX, self.weight, 0).astype(np.float32), (8, 1))
        self.same = self.alike.copy()
        share = np.maximum(np.append(common, 0), np.append(0, common))
        k, alive = PREFIX, np.arange(n)
        while True:
            alive = alive[(length[alive] > k) & (share[alive] >= 8 * k)]
            if not len(alive):
                break
            at, c = first[alive] + k, counts[alive]
            value = byte[at]
            apart = np.diff(alive) > 1
            for b in range(8):
                new = np.append(True, apart | (common[alive[1:] - 1] < 8 * k + b))
                start = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                one = np.where((value >> (7 - b)) & 1, c, 0.0)
                total, ones = np.add.reduceat(c, start)[group], np.add.reduceat(one, start)[group]
                self.alike[b, at] = total
                self.same[b, at] = np.where((value >> (7 - b)) & 1, ones, total - ones)
            k += 1
        return common

    def bits(self):
        """For each bit of the kept bytes, from the highest: (node, bit, slots of the tables, counts
        of 0 and 1 after the same beginning)."""
        node, byte, context = np.ones(len(self.kept), np.int64), self.byte[self.kept], [c[self.kept] for c in self.context]
        for b in range(8):
            bit = (byte >> (7 - b)) & 1
            slots = []
            turned = node.astype(np.uint64) * NODE
            for k, size in enumerate(SLOTS):
                slots.append(((context[k] + turned) >> np.uint64(64 - size)).view(np.int64))
            same = self.same[b, self.kept]
            other = self.alike[b, self.kept] - same
            yield b, node, bit, slots, np.where(bit == 1, other, same), np.where(bit == 1, same, other)
            node = 2 * node + bit

    def gate(self, b: int, seen: np.ndarray) -> np.ndarray:
        return np.searchsorted(LEVELS, seen, "right") * 64 + self.depth[self.kept] * 8 + b


@dataclass
class Model:
    odds: list[np.ndarray]
    weight: np.ndarray
    ones: np.ndarray
    total: np.ndarray

    def refine(self, node: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mean of the mixed one and of the map's at this place."""
        p = 1 / (1 + np.exp(-z))
        at = node * STEPS + step_of(z)
        return (p + (self.ones[at] + 2 * p) / (self.total[at] + 2)) / 2

    def costs(self, tokens: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        e = Events(tokens, counts)
        columns = np.ascontiguousarray(self.weight.T)
        total = np.zeros(len(e.kept))
        for b, node, bit, slots, n0, n1 in e.bits():
            gate = e.gate(b, n0 + n1)
            z = columns[-1][gate] + columns[len(SLOTS)][gate] * np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))
            for k, s in enumerate(slots):
                z += columns[k][gate] * self.odds[k][s]
            p = np.clip(self.refine(node, np.clip(z, -12, 12)), 1e-6, 1 - 1e-6)
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return np.bincount(e.token, total[e.owner], minlength=len(tokens))


def step_of(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((z + 12) * ((STEPS - 1) / 24)), 0, STEPS - 1).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]):
    """(tokens, counts) of about PART bytes each; tokens with the same first PREFIX bytes stay
    together."""
    words, counts, size = [], [], 0
    for batch in batches:
        for word, c in zip(texts_of(batch, "word"), values_of(batch, "c")):
            if size > PART and word[:PREFIX] != words[-1][:PREFIX]:
                yield words, np.array(counts, np.float64)
                words, counts, size = [], [], 0
            words.append(word)
            counts.append(c)
            size += len(word) + 1
    if words:
        yield words, np.array(counts, np.float64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's counts, as used slots of each chunk of each table."""
    both = [np.zeros(2 << s) for s in SLOTS]
    for words, counts in _parts(batches):
        e = Events(words, counts)
        for _, _, bit, slots, _, _ in e.bits():
            for k, s in enumerate(slots):
                np.add.at(both[k], s * 2 + bit, e.mass)
    zeros, ones = [x[::2] for x in both], [x[1::2] for x in both]
    rows = []
    for k, size in enumerate(SLOTS):
        for at in range(0, 1 << size, 1 << CHUNK):
            n0, n1 = zeros[k][at: at + (1 << CHUNK)], ones[k][at: at + (1 << CHUNK)]
            used = np.flatnonzero(n0 + n1)
            if len(used):
                rows.append((k, at >> CHUNK, used.astype("<u2").tobytes(), n0[used].astype("<f4").tobytes(), n1[used].astype("<f4").tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], names=["t", "chunk", "at", "n0", "n1"])


def _sum_chunk(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((2, 1 << CHUNK))
    for at, n0, n1 in zip(parts["at"], parts["n0"], parts["n1"]):
        where = np.frombuffer(at, "<u2")
        total[0, where] += np.frombuffer(n0, "<f4")
        total[1, where] += np.frombuffer(n1, "<f4")
    return pd.DataFrame({"t": [key[0]], "chunk": [key[1]], "n": [total.astype("<f4").tobytes()]})


def count_tables(vocabulary: DataFrame, tasks: int) -> list[np.ndarray]:
    """Counts of zeros and ones for every slot of every table."""
    rows = (
        vocabulary.where("c > 0").coalesce(tasks).mapInArrow(_count, "t int, chunk int, at binary, n0 binary, n1 binary")
        .groupBy("t", "chunk").applyInPandas(_sum_chunk, "t int, chunk int, n binary").collect()
    )
    tables = [np.zeros((2, 1 << s), np.float32) for s in SLOTS]
    for r in rows:
        low = r.chunk << CHUNK
        tables[r.t][:, low: low + (1 << CHUNK)] = np.frombuffer(r.n, "<f4").reshape(2, -1)
    return tables


def _learn(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Both counts of a slot lie side by side, as the parts of a complex number.
        counts_of = [np.ascontiguousarray(t.T).view(np.complex64).ravel() for t in tables.value]
        inputs = len(SLOTS) + 2
        weight, pace = np.zeros((GATES, inputs)), np.full((GATES, inputs), 1e-4)
        weight[:] = START
        seen, mass = np.zeros((256, STEPS, 2)), np.zeros(GATES)
        for words, counts in _parts(batches):
            e = Events(words, counts)
            for b, node, bit, slots, n0, n1 in e.bits():
                zero, one = (bit == 0).astype(np.float32), bit.astype(np.float32)
                found = [counts_of[k][s] for k, s in enumerate(slots)]
                pairs = [(c.real, c.imag) for c in found] + [(n0, n1)]
                x = np.ones((inputs, len(node)), np.float32)
                less = np.float32(PRIOR)
                for k, (a, c) in enumerate(pairs):
                    x[k] = np.log((np.maximum(c - one, 0) + less) / (np.maximum(a - zero, 0) + less))
                gate = e.gate(b, np.maximum(n0 + n1 - 1, 0))
                z = np.zeros(len(node), np.float32)
                columns = weight.T.astype(np.float32)
                for k in range(inputs):
                    z += x[k] * columns[k][gate]
                z = np.clip(z, -12, 12)
                error = e.mass * (bit - 1 / (1 + np.exp(-z)))
                total = np.bincount(gate, e.mass, minlength=GATES)
                used = total > 0
                for k in range(inputs):
                    g = np.bincount(gate, error * x[k], minlength=GATES)[used] / total[used]
                    pace[used, k] += g * g
                    weight[used, k] += RATE * g / np.sqrt(pace[used, k])
                mass += total
                seen += np.bincount((node * STEPS + step_of(z)) * 2 + bit, e.mass, minlength=256 * STEPS * 2).reshape(seen.shape)
        if mass.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in (mass, weight, seen)], names=["mass", "weight", "seen"])
    return run


def train(vocabulary: DataFrame, tasks: int) -> Model:
    tables = count_tables(vocabulary, tasks)
    shared = vocabulary.sparkSession.sparkContext.broadcast(tables)
    learned = vocabulary.where("c > 0").coalesce(tasks).mapInArrow(_learn(shared), "mass binary, weight binary, seen binary").collect()
    weight, seen, mass = np.zeros((GATES, len(SLOTS) + 2)), np.zeros((256, STEPS, 2)), np.full((GATES, 1), 1e-9)
    weight += np.multiply(START, 1e-9)
    for r in learned:
        own = np.frombuffer(r.mass).reshape(-1, 1)
        weight += np.frombuffer(r.weight).reshape(weight.shape) * own
        seen += np.frombuffer(r.seen).reshape(seen.shape)
        mass += own
    weight /= mass
    odds = [np.log((t[1] + PRIOR) / (t[0] + PRIOR)).astype(np.float32) for t in tables]
    return Model(odds, weight.astype(np.float32), seen[:, :, 1].ravel(), seen.sum(2).ravel())


def _score(model):
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("score", pa.float64()), ("bytes", pa.int64())])

    def run(batches):
        for words, counts in _parts(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array([w.decode() for w in words], pa.string()), pa.array(counts.astype(np.int64)),
                pa.array(model.value.costs(words, counts)), pa.array([len(w) + (w != b"\n") for w in words], pa.int64())], schema=schema)
    return run


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scored words of a block, packed: few large rows take a fraction of the shuffle. Holds about
    PLACES words at a time."""
    def rows(held):
        part, *columns = (np.concatenate([np.asarray(b.column(b.schema.get_field_index(c))) for b in held]) for c in ("part", *FORMS))
        order = np.lexsort((columns[0], part))
        part = part[order]
        start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        columns[2] = _bits_of(columns[2])
        packs = [[pressed(x) for x in np.split(c[order], start[1:])] for c in columns]
        packs[0] = [pressed(np.diff(x, prepend=0)) for x in np.split(columns[0][order], start[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[start]), *(pa.array(x, pa.binary()) for x in packs)], names=["part", *FORMS])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= PLACES:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of unsigned ``keys`` below 2^bits, sorted, and the place of each key among
    them. Keys and their places are sorted as one number where 64 bits hold both."""
    n = len(keys)
    low = max(1, n - 1).bit_length()
    if bits + low > 64:
        return np.unique(keys, return_inverse=True)
    both = keys << np.uint64(low)
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << low) - 1)).view(np.int64)
    both >>= np.uint64(low)
    new = np.append(True, both[1:] != both[:-1])[:n]
    rank = np.cumsum(new)
    rank -= 1
    at = np.empty(n, np.int64)
    at[order] = rank
    return both[new], at


def earlier(lengths: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The token before each one; before a text's first it is the end of another."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = tokens[lengths[0] - 1]
    return before


def gram_bits(n: int) -> int:
    """Bits of the hash of pairs and triples of a corpus of ``n`` tokens: about one in 4,096 shares
    its hash with another, at any size."""
    return min(64, max(32, (2 * n).bit_length() + 12))


def _word_keys(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words) + 1]
    low = int(offsets[0])
    size = int(offsets[-1]) - low
    buf = np.frombuffer(words.buffers()[2] or b"", np.uint8)[low: low + size]
    up, down = powers(1 << max(20, size.bit_length()))
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
    return mixed((sums[offsets[1:] - low] - sums[offsets[:-1] - low]) * down[offsets[:-1] - low])


def _grams(words, lengths: np.ndarray, ids: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token with the one before it, and with the two before it where it is not a
    text's first, in ``bits`` bits; equal tokens have equal hashes in all blocks."""
    key = _word_keys(words if isinstance(words, pa.Array) else pa.array(words, pa.large_string()))[ids]
    pair = mixed(earlier(lengths, key) * PAIR + key)
    later = np.ones(len(ids), bool)
    later[np.cumsum(lengths) - lengths] = False
    grams = np.concatenate([pair, mixed(pair[np.flatnonzero(later) - 1] * TRIPLE + key[later])])
    grams >>= np.uint64(64 - bits)
    return grams, later


def _count_grams(parts: int, bits: int):
    """A block's different pairs and triples, sorted, with their training counts, by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                lengths = np.array(row["n_tokens"].as_py())
                keys, later = _grams(row["words"].values, lengths, unpressed(row["ids"].as_py()), bits)
                row |= {"block": row["block"].as_py(), "held_out": row["held_out"].as_py()}
                known = np.repeat(~np.array(row["held_out"]), lengths)
                keys, at = distinct(keys, bits)
                n = np.bincount(at, np.concatenate([known, known[later]]), len(keys))
                part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                start = np.flatnonzero(np.diff(part, prepend=-1))
                cut = start[1:]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["block"]] * len(start)), pa.array(part[start]),
                    pa.array([pressed(np.diff(k, prepend=np.uint64(0))) for k in np.split(keys, cut)], pa.binary()),
                    pa.array([pressed(c) for c in np.split(n, cut)], pa.binary())], names=["block", "deal", "keys", "n"])
    return run


def _sum_grams(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each block its pairs' and triples' counts in all blocks, in its order."""
    keys = [np.cumsum(unpressed(k).view(np.uint64)) for k in rows["keys"]]
    keys = [k - min(x[0] for x in keys) for k in keys]
    _, at = distinct(np.concatenate(keys), int(max(k[-1] for k in keys)).bit_length())
    total = np.bincount(at, np.concatenate([unpressed(n) for n in rows["n"]]))[at]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    return pd.DataFrame({"part": rows["block"], "deal": key[0], "total": [pressed(x) for x in np.split(total, cut)]})


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a block as one compressed value, a line each: few bytes to shuffle. The last word of a
    block is the end, which is a line break itself."""
    for batch in batches:
        joined = pc.binary_join(batch.column("words"), "\n").cast(pa.binary()).to_pylist()
        packs = [len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True) for text in joined]
        at = batch.schema.get_field_index("words")
        yield batch.set_column(at, "words", pa.array(packs, pa.binary()))


def _documents(n: int, v: int, bits: int):
    """Documents of a block as one row, with the log10 probability and the count of each word alone
    and, for each token, the counts of its pair and its triple."""
    denominator = n + 0.5 * (v + 1)

    def run(key: tuple, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        words, grams = found[found["total"].isna()], found[found["total"].notna()].sort_values("deal")
        place, c, score, size = (np.concatenate([unpressed(x) for x in words[name]]) for name in FORMS)
        place = np.concatenate([np.cumsum(unpressed(x)) for x in words["place"]])
        score = score.astype("<u4").view("<f4")
        order = np.argsort(place)
        c, score, size = c[order], score[order], size[order]
        base = np.log10((c + 0.5) / denominator)
        doc = docs.iloc[0]
        lengths, ids = np.array(doc["n_tokens"]), unpressed(doc["ids"])
        text = pa.decompress(doc["words"][8:], int.from_bytes(doc["words"][:8], "little"), "zstd", asbytes=True)
        lines = pc.split_pattern(pa.array([text], pa.large_binary()).cast(pa.large_string()), "\n").values
        keys, later = _grams(pa.concat_arrays([lines[:-2], pa.array(["\n"], pa.large_string())]), lengths, ids, bits)
        total = np.concatenate([unpressed(x) for x in grams["total"]])[distinct(keys, bits)[1]]
        # No pair is more frequent than its tokens, no triple than its pairs, whatever shares a hash.
        pairs, triples = np.minimum(total[: len(ids)], c[ids]), np.zeros(len(ids), np.int64)
        pairs = np.minimum(pairs, c[earlier(lengths, ids)])
        triples[later] = np.minimum(np.minimum(total[len(ids):], pairs[later]), pairs[np.flatnonzero(later) - 1])
        # Ids come as text: pandas would turn a column with NULLs into floats.
        plain = [[None if x is None else int(x) for x in doc["doc_id"]], list(doc["held_out"]), lengths.tolist()]
        sums = [np.add.reduceat(x[ids], np.cumsum(lengths) - lengths).tolist() for x in ((c > 0).astype(np.int64), base, size.astype(np.int64))]
        return pd.DataFrame([[*plain, *sums, doc["ids"], pressed(_bits_of(score)), pressed(c), pressed(pairs), pressed(triples)]],
                            columns=[x.split()[0] for x in TEXTS.split(", ")])
    return run


def corpus_contexts(lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray, pairs: np.ndarray, triples: np.ndarray,
                    own: int = 0) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For one and two earlier tokens, the places whose context is in the training texts, the share of
    their token among what followed it there, and their gate. ``own`` occurrences are left out."""
    first = np.cumsum(lengths) - lengths
    once, twice = counts[earlier(lengths, ids)] - own, np.empty_like(pairs)
    twice[1:] = pairs[:-1] - own
    twice[first] = 0
    one, two = np.flatnonzero(once > 0), np.flatnonzero(twice > 0)
    gate = np.minimum(np.log2(twice[two]).astype(np.int64), len(TIMES)) * (len(FOLLOWERS) + 1) + np.minimum(
        np.log2(once[two]).astype(np.int64) // 3, len(FOLLOWERS))
    return [(one, (pairs[one] - own) / once[one], np.minimum((4 * np.log2(once[one])).astype(np.int64), TEXT_GATES - 1)),
            (two, (triples[two] - own) / twice[two], gate)]


def _numbered(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by pair and place, number of the pair, how often it came before) for each place."""
    n = len(ids)
    if n <= 1 << 20 and group.max() < 1 << 21 and ids.max() < 1 << 23:
        key = np.sort((group.astype(np.uint64) << np.uint64(43)) | (ids.astype(np.uint64) << np.uint64(20)) | np.arange(n, dtype=np.uint64))
        order = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
        key >>= np.uint64(20)
    else:
        key = (group.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    start = np.flatnonzero(new)
    rank = np.cumsum(new) - 1
    number, before = np.empty(n, np.int64), np.empty(n, np.int64)
    number[order] = rank
    before[order] = np.arange(n) - start[rank]
    return order, number, before


def own_contexts(lengths: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, the places whose context came before in the same text, the share of their
    token among what followed it, and their gate. A text's first contexts are new by its number."""
    n = len(ids)
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    last = np.zeros(n, bool)
    last[first + lengths - 1] = True
    group, seen, by_context, result = doc, np.arange(n) - first[doc], np.arange(n), []
    for k in range(ORDERS):
        order, number, same = _numbered(group, ids)
        other = (same[by_context] == 0).astype(np.int64)
        count = np.cumsum(other) - other
        begin = np.maximum.accumulate(np.where(seen[by_context] == 0, np.arange(len(by_context)), 0))
        followers = np.zeros(n, np.int64)
        followers[by_context] = count - count[begin]
        at = np.flatnonzero(seen)
        times = seen[at]
        gate = LEVEL_OF[np.minimum(times, TIMES[-1])] * (len(FOLLOWERS) + 1) + np.searchsorted(FOLLOWERS, (followers[at] - 0.5) / times)
        result.append((at, same[at] / times, gate))
        by_context = order[~last[order]] + 1
        group, earlier = np.empty(n, np.int64), np.zeros(n, np.int64)
        group[1:], earlier[1:] = number[:-1], same[:-1]
        group[first], earlier[first] = n + np.arange(len(lengths)), 0
        seen = earlier
    return result


def mix_in_text(alone: np.ndarray, contexts: list, weight: np.ndarray, learn: bool = False) -> np.ndarray:
    """Natural log probabilities of tokens in their text. If ``learn``, ``weight`` (orders, gates, 2:
    weight, tokens) moves by the error, as for a bit: the share of the context in the mixture less
    the one that the weight gives it, by its slope. Steps shrink as a gate has seen more tokens."""
    floor = np.maximum(alone, LEAST_LOG)
    p = np.exp(floor)
    for k, (at, share, gate) in enumerate(contexts):
        part = 1 / (1 + np.exp(-weight[k, :, 0]))
        own = part[gate]
        before = p[at]
        share = own * share
        both = share + (1 - own) * before
        p[at] = both
        if learn:
            total = np.bincount(gate, minlength=TEXT_GATES)
            used = total > 0
            error = np.bincount(gate, share / both, TEXT_GATES)[used] / total[used] - part[used]
            weight[k, :, 1] += total
            step = error / (part[used] * (1 - part[used])) * np.sqrt(total[used] / weight[k, used, 1])
            weight[k, used, 0] = np.clip(weight[k, used, 0] + np.clip(step, -1, 1), -8, 8)
    # Below LEAST_LOG a token's own probability counts only where no context has seen it.
    return np.log(p) + np.where(p > 2 * np.exp(LEAST_LOG), 0, alone - floor)


def first_weights(start: tuple = TEXT_START) -> np.ndarray:
    weight = np.zeros((len(start), TEXT_GATES, 2))
    weight[:, :, 0] = np.reshape(start, (-1, 1))
    return weight


def _blocks_of(batches: Iterator[pa.RecordBatch]):
    """Each block's row, with the lengths of its texts, their tokens, the counts of these tokens' pairs
    and triples, and the words' log probabilities and counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            tokens = (unpressed(row["ids"]).astype(np.uint32), unpressed(row["pairs"]), unpressed(row["triples"]))
            alone = unpressed(row["alone"]).astype("<u4").view("<f4").astype(np.float64) * np.log(10)
            yield row, np.array(row["n_tokens"]), tokens, alone, unpressed(row["counts"])


def _text_parts(lengths: np.ndarray, tokens: tuple, alone: np.ndarray, counts: np.ndarray, own: int = 0):
    """(low, high, lengths, log probabilities, contexts) of about TEXT_PART tokens; a longer text is a
    part of its own."""
    bounds, low = np.append(0, np.cumsum(lengths)), 0
    while low < len(lengths):
        high = max(low + 1, np.searchsorted(bounds, bounds[low] + TEXT_PART, "right") - 1)
        ids, pairs, triples = (x[bounds[low]: bounds[high]] for x in tokens)
        part = lengths[low:high]
        yield low, high, part, alone[ids], corpus_contexts(part, ids, counts, pairs, triples, own) + own_contexts(part, ids)
        low = high


def _learn_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = first_weights(CORPUS_START + TEXT_START)
    for row, lengths, tokens, alone, counts in _blocks_of(batches):
        known = ~np.array(row["held_out"])
        kept = np.repeat(known, lengths)
        for _, _, _, p, contexts in _text_parts(lengths[known], tuple(x[kept] for x in tokens), alone, counts, 1):
            mix_in_text(p, contexts, weight, learn=True)
    if weight[:, :, 1].any():
        yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary())], names=["weight"])


def text_weights(texts: DataFrame, tasks: int) -> np.ndarray:
    """Weights of the contexts of tokens: the mean of the tasks', by the tokens that each saw."""
    rows = texts.select("held_out", "n_tokens", "ids", "alone", "counts", "pairs", "triples").coalesce(tasks).mapInArrow(_learn_texts, "weight binary").collect()
    start = first_weights(CORPUS_START + TEXT_START)
    mass = np.full(start.shape[:2], 1e-9)
    total = start[:, :, 0] * 1e-9
    for r in rows:
        own = np.frombuffer(r.weight).reshape(start.shape)
        total += own[:, :, 0] * own[:, :, 1]
        mass += own[:, :, 1]
    start[:, :, 0] = total / mass
    return start


def _score_texts(weight: np.ndarray, n: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, lengths, tokens, alone, counts in _blocks_of(batches):
            score = np.zeros(len(lengths))
            for low, high, own, p, contexts in _text_parts(lengths, tokens, alone, counts):
                score[low:high] = np.add.reduceat(mix_in_text(p, contexts, weight), np.cumsum(own) - own) / np.log(10)
            columns = [row["doc_id"], row["held_out"], row["n_tokens"], row["n_known"], [n] * len(score), row["base_score"],
                       score, -score / np.log10(2) / np.array(row["bytes"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _saved(df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """As ``saved``; the shuffle files behind it are removed at once, as the later steps do not read them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return saved(df, purpose, compression)
    finally:
        conf.set(key, before)


def scores(docs: DataFrame, folds: int = 5, held: int = 1, tasks: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = prepared(docs.sparkSession)
    # Larger blocks have fewer words and pairs in all; BLOCK bounds them.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6000")
    tasks = tasks or spark.sparkContext.defaultParallelism
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = saved(docs.mapInArrow(_tokenise(folds, held), TOKENS), "tokens")
    counted = tokens.select(F.inline(F.arrays_zip("words", "train"))).groupBy(F.col("words").alias("word")).agg(F.sum("train").alias("c"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = F.substring(F.col("word").cast("binary"), 1, PREFIX)
    vocabulary = _saved(counted.repartition(partitions, head).sortWithinPartitions("word"), "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    bits = gram_bits(n)
    model = spark.sparkContext.broadcast(train(vocabulary, tasks))
    scored = vocabulary.mapInArrow(_score(model), "word string, c long, score double, bytes long")
    places = tokens.select(F.col("block").alias("part"), F.posexplode("words").alias("place", "word")).join(scored.hint("shuffle_hash"), "word").select("part", "place", "c", F.col("score").cast("float").alias("score"), "bytes")
    places = _saved(places.mapInArrow(_by_block, "part long, place binary, c binary, score binary, bytes binary"), "places", "uncompressed")
    grams = tokens.select("block", "held_out", "n_tokens", "ids", "words").mapInArrow(
        _count_grams(max(partitions, 2 * n // DEALT), bits), "block long, deal long, keys binary, n binary")
    totals = _saved(grams.groupBy("deal").applyInPandas(_sum_grams, "part long, deal long, total binary"), "grams", "uncompressed")
    found = places.unionByName(totals, allowMissingColumns=True)
    documents = tokens.select("block", F.col("doc_id").cast("array<string>").alias("doc_id"), "held_out", "n_tokens", "ids", "words").mapInArrow(
        _pack_words, "block long, doc_id array<string>, held_out array<boolean>, n_tokens array<long>, ids binary, words binary")
    texts = _saved(documents.groupBy("block").cogroup(found.groupBy("part")).applyInPandas(_documents(n, v, bits), TEXTS), "texts", "uncompressed")
    return texts.mapInArrow(_score_texts(text_weights(texts, tasks), n), SCORES)
