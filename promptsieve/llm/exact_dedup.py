"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when they are the same bytes after all white space (\\x20, \\x09-\\x0D) is
deleted; NULL counts as empty. Every text has a 64-bit hash; a bucket of the index owns the
hashes with one prefix. The directory starts as a single bucket and is doubled until no bucket
holds more than ``capacity`` different hashes. Owner tasks each take whole buckets, in hash
order: equal hashes form a chain, in which bytes are compared, so a collision makes a second
chain entry. The index (bucket, depth, hash, chain, digest, keeper, size) is written to the
shared folder, and every document finds its entry there.

Copies are collapsed per Arrow batch, by bytes, before they are shuffled: a group of copies
that holds a third of all rows reaches its owner as one entry per batch.

Nulls and ties: a NULL doc_id sorts last. Of rows with equal texts and lengths the smallest
doc_id stays; rows that also share the doc_id are one document and share its verdict (the
pipeline's stage keeps one of them). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import SPACE, prepared, saved, texts_of, values_of

KEYS = "doc_id long, n_chars long, hash long, text_sha256 string"
ENTRIES = ("bucket int, depth int, hash long, text_sha256 string, body binary, rows long, "
           "best_chars long, best_id long")
INDEX = "bucket int, depth int, hash long, chain int, text_sha256 string, keep_id long, group_size long"
TOP = 1 << 63


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _hash(body: bytes) -> int:
    return xxhash.xxh64_intdigest(body)


def _read(batch: pa.RecordBatch):
    lengths = pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index("text"))), 0)
    bodies = [t.translate(None, SPACE) for t in texts_of(batch)]
    return values_of(batch, "doc_id"), lengths.to_pylist(), bodies


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(KEYS)
    for batch in batches:
        ids, lengths, bodies = _read(batch)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
            pa.array(np.array([_hash(b) for b in bodies], np.uint64).view(np.int64)),
            pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
        ], schema=schema)


def build_directory(keys: DataFrame, capacity: int | None = None) -> list[tuple[int, int]]:
    """(smallest hash, local depth) of every bucket, in hash order.

    One histogram serves several doublings; only prefixes that are still overfull are counted
    again, deeper. The directory has a few buckets for each shuffle partition (or as many as
    ``capacity`` asks for), so it stays small on the driver.
    """
    spark = keys.sparkSession
    hashes = saved(keys.select("hash").distinct(), "hashes")
    total = hashes.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    capacity = capacity or max(1, -(-total // (4 * partitions)))
    step = max(4, (total // capacity).bit_length() + 2)
    buckets, depth, open_ = [], 0, [(0, 0)] if total > capacity else []
    if not open_:
        return [(0, 0)]
    while open_:
        deeper = min(64, depth + step)
        prefix = F.shiftrightunsigned("hash", 64 - deeper)
        rows = hashes
        if depth:
            parents = spark.createDataFrame([(p,) for p, _ in open_], "parent long")
            rows = rows.withColumn("parent", F.shiftrightunsigned("hash", 64 - depth)).join(parents, "parent")
        found = {r.p % (1 << 64): r.n for r in rows.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
        sums = {deeper: found}
        for d in range(deeper - 1, depth - 1, -1):
            level: dict[int, int] = {}
            for p, n in sums[d + 1].items():
                level[p >> 1] = level.get(p >> 1, 0) + n
            sums[d] = level
        todo, open_ = [(p % (1 << 64), depth) for p, _ in open_], []
        while todo:
            p, d = todo.pop()
            if sums[d].get(p, 0) <= capacity or d == 64:
                buckets.append((p << (64 - d), d))
            elif d == deeper:
                open_.append((p, d))
            else:
                todo += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        depth = deeper
        step = 8
    return sorted(buckets)


def _entries(lows: np.ndarray, depths: np.ndarray):
    schema = _schema(ENTRIES)

    def run(batches):
        for batch in batches:
            found: dict[bytes, list] = {}
            for i, n, body in zip(*_read(batch)):
                rank = (-n, i is None, i or 0)
                entry = found.get(body)
                if entry is None:
                    found[body] = [1, rank]
                else:
                    entry[0] += 1
                    entry[1] = min(entry[1], rank)
            hashes = np.array([_hash(b) for b in found], np.uint64)
            bucket = np.searchsorted(lows, hashes, "right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket.astype(np.int32)), pa.array(depths[bucket]),
                pa.array(hashes.view(np.int64)),
                pa.array([hashlib.sha256(b).hexdigest() for b in found], pa.string()),
                pa.array(list(found), pa.binary()), pa.array([n for n, _ in found.values()], pa.int64()),
                pa.array([-r[0] for _, r in found.values()], pa.int64()),
                pa.array([None if r[1] else r[2] for _, r in found.values()], pa.int64()),
            ], schema=schema)
    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of one hash after another; the rows come in (bucket, hash) order."""
    schema = _schema(INDEX)
    at, chain, out = None, [], []

    def closed():
        bucket, depth, h = at
        return [(bucket, depth, h, k, sha, None if r[1] else r[2], n)
                for k, (_, sha, n, r) in enumerate(chain)]

    for batch in batches:
        columns = [values_of(batch, f) for f in batch.schema.names]
        for bucket, depth, h, sha, body, n, chars, i in zip(*columns):
            if at != (bucket, depth, h):
                if chain:
                    out += closed()
                at, chain = (bucket, depth, h), []
            rank = (-chars, i is None, i or 0)
            for entry in chain:
                if entry[0] == body:
                    entry[2] += n
                    entry[3] = min(entry[3], rank)
                    break
            else:
                chain.append([body, sha, n, rank])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if chain:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*closed()), schema)], schema=schema)


def build_index(docs: DataFrame, directory: list[tuple[int, int]]) -> DataFrame:
    """One row per different text, written to the shared folder by the owners of its bucket."""
    lows = np.array([low for low, _ in directory], np.uint64)
    depths = np.array([d for _, d in directory], np.int32)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = (
        docs.select("doc_id", "text").mapInArrow(_entries(lows, depths), ENTRIES)
        .repartition(partitions, "bucket").sortWithinPartitions("bucket", "hash")
    )
    return saved(owned.mapInArrow(_own, INDEX), "index")


def exact_dedup(docs: DataFrame, capacity: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = saved(docs.mapInArrow(_keys, KEYS), "keys")
    index = build_index(docs, build_directory(keys, capacity))
    return (
        keys.join(index.select("text_sha256", "keep_id", "group_size"), "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are; of repeated rows one."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), "text_sha256")
    stay = exact_dedup(docs).where("kept").select(key.alias("key")).distinct()
    body = F.translate(F.coalesce(F.col("row.text").cast("string"), F.lit("")), SPACE.decode(), "")
    own = F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("long").cast("string"), F.lit("-")), F.sha2(body, 256))
    rows = docs.select(F.struct("*").alias("row")).select("row", own.alias("key"))
    return rows.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), k as (
  select text_sha256, first(doc_id order by n desc, doc_id nulls last) as keep_id, count(*) as group_size
  from d group by text_sha256
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256
from d join k using (text_sha256)
"""
