"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and shingles of ``width``
words; a fingerprint bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
Documents whose fingerprints differ in at most 4 of 64 bits are linked.

Search. The fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a word of
the perfect binary Golay code (23, 12, 7), whose decoder maps every word to the one codeword
within 3 bits. The *near indices* of a segment are the codeword indices of itself and of its
one-bit neighbours (1 to 6 of them): two segments at most 2 bits apart always share one, for
they share a neighbour; and of two that are at most 1 bit apart, each one's own index is among
the near indices of the other. By pigeonhole, 4 errors over three segments leave

* a segment without error, and then another one with at most 2: the keys are the exact bits
  of one segment with a near index of another, 6 ordered choices, on both sides;
* or no such segment, and then at least two with exactly 1 error: the keys are two near
  indices on one side and two own indices on the other, 3 choices.

Equal keys are joined and verified by the number of differing bits inside the join, so no pair
is lost and no unverified pair is written.

Copies are collapsed first: the search runs over different fingerprints. NULL and empty texts
have fingerprint zero and are linked like any other. Rows of one doc_id take part one by one;
a NULL doc_id never becomes a component's id while the component has another one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import prepared, saved, texts_of, values_of
from promptsieve.llm.components import components

SEED = 42
DISTANCE = 4
#: (lowest bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
KEY_ROWS = 4096


def fingerprint(text: bytes, width: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    hashes = np.array([
        xxhash.xxh64_intdigest(b" ".join(words[i: i + width]), SEED)
        for i in range(max(1, len(words) - width + 1))
    ], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 8192)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, digests: bool = False) -> DataFrame:
    """(doc_id, fingerprint as signed long, and if asked for SHA-256 of the text) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values_of(batch, "doc_id"), pa.int64()), pa.array(fps.view(np.int64)),
                 pa.array([hashlib.sha256(t).hexdigest() if digests else None for t in texts], pa.string())], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(run, "doc_id long, fp long, digest string")
    return found if digests else found.drop("digest")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words by the generator polynomial."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= ((words >> bit) & 1) * (GOLAY << (bit - 11))
    return words


@lru_cache(maxsize=1)
def _errors() -> np.ndarray:
    """Error pattern of up to 3 bits for each of the 2,048 syndromes."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], np.int64)
    table = np.zeros(2048, np.int64)
    table[_remainder(patterns)] = patterns
    return table


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ _errors()[_remainder(words)]) >> 11


def _near(words: np.ndarray, bits: int) -> np.ndarray:
    """Sorted near indices of segments, one row each, with -1 in place of repetitions."""
    flips = np.array([0, *(1 << b for b in range(bits))], np.int64)
    found = np.sort(codeword_index((words[:, None] ^ flips[None, :]).ravel()).reshape(len(words), -1), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found = -np.sort(-found, axis=1)
    return found[:, : max(1, (found >= 0).sum(1).max(initial=1))]


def _keys(fps: np.ndarray, near_side: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key) rows of one side."""
    parts = [((fps >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    near = [_near(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    rows, keys, tag = [], [], 0

    def add(left, right, shift):
        valid = (left[:, :, None] >= 0) & (right[:, None, :] >= 0)
        made = (np.int64(tag) << 40) | (left[:, :, None] << shift) | right[:, None, :]
        rows.append(np.nonzero(valid)[0])
        keys.append(made[valid])

    for a in range(3):
        for b in range(3):
            if a != b:
                add(parts[a][:, None], near[b], 12)
                tag += 1
    own = near if near_side else [codeword_index(p)[:, None] for p in parts]
    for a, b in combinations(range(3), 2):
        add(own[a], own[b], 12)
        tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(near_side: bool):
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), KEY_ROWS):
                part = fps[at: at + KEY_ROWS]
                rows, keys = _keys(part.view(np.uint64), near_side)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], schema=schema)
    return run


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints, column ``fp``, at most DISTANCE bits apart.

    Spark takes the key rows (up to 150 a fingerprint) for as many as the fingerprints, so it would
    send those of some hundred MB of texts through the driver: the join is always a sort merge join.
    """
    left = fps.select("fp").mapInArrow(_key_rows(True), "key long, fp long").toDF("key", "a")
    right = fps.select("fp").mapInArrow(_key_rows(False), "key long, fp long").toDF("key", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    met = left.hint("merge").join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & close)
    return met.select("a", "b").distinct()


def _classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) of every different fingerprint of ``prints`` (doc_id, fp)."""
    different = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(fingerprint_links(different)).toDF("fp", "root")
    owned = saved(different.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    component = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    return saved(owned.join(component, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    prepared(docs.sparkSession)
    prints = saved(fingerprints(docs, width), "prints")
    return prints.join(_classes(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = 4) -> DataFrame:
    """One row of each component stays, with all its columns as they are: the one with the smallest
    doc_id, rows without one last, then with the smallest digest of its text. Of repeated rows one
    stays."""
    prepared(docs.sparkSession)
    prints = saved(fingerprints(docs, width, True), "prints")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    stay = prints.join(_classes(prints).select("fp", "root"), "fp").groupBy("root").agg(F.min(rank).alias("rank"))
    name = F.concat_ws(":", F.coalesce(F.col("rank.doc_id").cast("string"), F.lit("-")), "rank.digest")
    own = F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("long").cast("string"), F.lit("-")),
                      F.sha2(F.coalesce(F.col("row.text").cast("string"), F.lit("")), 256))
    rows = docs.select(F.struct("*").alias("row")).select("row", own.alias("key"))
    return rows.join(stay.select(name.alias("key")), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
