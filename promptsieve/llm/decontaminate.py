"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is
13 consecutive words of an item; an item of fewer words, but not none, is one window.

Of every 9 consecutive 5-gram hashes of a text the smallest is kept (the last one on ties), so
two texts that share 13 words share a kept fingerprint at the same place. Documents'
fingerprints are joined with the benchmark's, each hit is extended to all 13-word windows
around it, and these are joined with the items' windows by their text, so the result is exact.
For items below 13 words the guarantee does not hold; their one window is a fingerprint of its
own, looked up at every position of the documents.

Before documents' fingerprints leave their task they pass a bit map of the benchmark's, of a
fixed size (2^22 bits) whatever the size of the benchmark; false positives only cost rows.

Rows are told apart by a digest of doc_id and text, so repeated rows get equal results and a
doc_id with several texts gets one result for each. NULL has no words. Items with equal ids
count once. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.llm.common import ALNUM, Words, blocks, mixed, prepared, saved, texts_of, values_of

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
BITS = 22
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
FOUND = "key binary, doc_id long, n_words long, fp long, start long, size int, words array<string>"
ITEMS = "item_id long, fp long, size int, window string"


def gram_hashes(words: Words, size: int) -> np.ndarray:
    """Hash of ``size`` words from each position; those that leave their text are not valid."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(size))
    for j in range(size):
        h = h * STEP + words.hash[j: j + n]
    return mixed(h)


def winnowed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept fingerprints."""
    h = gram_hashes(words, GRAM)
    n = len(words.hash) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), h[:0]
    whole = words.doc[:n] == words.doc[WINDOW - 1:]
    ring = np.lib.stride_tricks.sliding_window_view(h, SPAN)[:, ::-1]
    at = (np.arange(n) + SPAN - 1 - ring.argmin(1))[whole]
    at = np.unique(at)
    return at, h[at]


def _bit(fps: np.ndarray) -> np.ndarray:
    return (fps >> np.uint64(64 - BITS)).astype(np.int64)


def _documents(bitmap: np.ndarray, sizes: list[int]):
    """Base rows (fp NULL) and rows of fingerprints that pass the bit map, with the words
    around them."""
    schema = pa.schema([
        ("key", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("fp", pa.int64()),
        ("start", pa.int64()), ("size", pa.int32()), ("words", pa.list_(pa.string()))])

    def passing(fps):
        return (bitmap[_bit(fps) >> 6] >> (_bit(fps) & 63).astype(np.uint64)) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = values_of(batch, "doc_id"), texts_of(batch)
            for low, high in blocks(texts):
                part = texts[low:high]
                words = Words(part, ALNUM)
                count = np.bincount(words.doc, minlength=len(part))
                first = np.cumsum(count) - count
                keys = [hashlib.sha256(b"%s|%s" % (b"-" if i is None else b"%d" % i, t)).digest()[:16]
                        for i, t in zip(ids[low:high], part)]
                rows = [(k, i, int(n), None, None, None, None) for k, i, n in zip(keys, ids[low:high], count)]
                at, fps = winnowed(words)
                hit = passing(fps)
                found = [(p, f, WINDOW) for p, f in zip(at[hit], fps[hit])]
                for size in sizes:
                    fps = gram_hashes(words, size)
                    hit = np.flatnonzero(passing(fps))
                    hit = hit[words.doc[hit] == words.doc[hit + size - 1]]
                    found += [(p, fps[p], size) for p in hit]
                for p, f, size in found:
                    d = words.doc[p]
                    a, b = p, p + size
                    if size == WINDOW:
                        a, b = max(first[d], p - SPAN + 1), min(first[d] + count[d], p + WINDOW)
                    rows.append((keys[d], None, None, int(np.uint64(f).view(np.int64)), int(a - first[d]), size,
                                 [words.text(w).decode("utf-8", "replace") for w in range(a, b)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of the items (fp NULL), and their fingerprints (window NULL)."""
    schema = pa.schema([("item_id", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("window", pa.string())])
    for batch in batches:
        ids, texts = values_of(batch, "item_id"), texts_of(batch)
        for low, high in blocks(texts):
            words = Words(texts[low:high], ALNUM)
            count = np.bincount(words.doc, minlength=high - low)
            first = np.cumsum(count) - count
            rows = []
            for k, n in enumerate(count):
                size = min(int(n), WINDOW)
                own = [words.text(w).decode("utf-8", "replace") for w in range(first[k], first[k] + n)]
                rows += [(ids[low + k], None, size, " ".join(own[a: a + size])) for a in range(n - size + 1) if n]
            _, fps = winnowed(words)
            rows += [(None, int(f), WINDOW, None) for f in fps.view(np.int64)]
            for size in {int(n) for n in count if 0 < n < WINDOW}:
                fps = gram_hashes(words, size).view(np.int64)
                rows += [(None, int(fps[first[k]]), size, None) for k, n in enumerate(count) if n == size]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _bitmap(fps: DataFrame) -> np.ndarray:
    """The fixed-size bit map, as 2^16 words: at most so many rows reach the driver."""
    bit = F.shiftrightunsigned("fp", 64 - BITS)
    found = fps.groupBy(F.shiftright(bit, 6).alias("at")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITS}) & 63 as int)))").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint64)


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per document: key, doc_id, n_words; and every occurrence: key, start, size,
    item_id)."""
    prepared(docs.sparkSession)
    texts = F.col("text").cast("string").alias("text")
    items = saved(benchmark.select(F.col("item_id").cast("long").alias("item_id"), texts)
                  .mapInArrow(_windows, ITEMS), "items")
    fps = items.where("fp is not null").select("fp", "size").distinct()
    sizes = sorted(r["size"] for r in fps.where(F.col("size") < WINDOW).select("size").distinct().collect())
    found = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts)
                  .mapInArrow(_documents(_bitmap(fps), sizes), FOUND), "fingerprints")
    hits = found.where("fp is not null").join(fps, ["fp", "size"], "left_semi")
    near = hits.select("key", "size", F.col("start").alias("base"), "words").select(
        "key", "size", "base", "words", F.explode(F.expr("sequence(0, size(words) - size)")).alias("at"))
    near = near.select(
        "key", (F.col("base") + F.col("at")).alias("start"), "size",
        F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("window")).distinct()
    windows = items.where("window is not null").select("item_id", "size", "window").distinct()
    return (found.where("fp is null").select("key", "doc_id", "n_words"),
            near.join(windows, ["size", "window"]).select("key", "start", "size", "item_id"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    base, found = occurrences(docs, benchmark)
    found = saved(found, "occurrences")
    items = (
        found.select("key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key")
        .agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"), F.count("*").alias("n_items"))
    )
    before = Window.partitionBy("key").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        found.select("key", "start", "size").distinct()
        .withColumn("reach", F.coalesce(F.max(F.col("start") + F.col("size")).over(before), F.lit(0)))
        .groupBy("key").agg(F.sum(F.greatest(
            F.lit(0), F.col("start") + F.col("size") - F.greatest("start", "reach"))).alias("n_hit"))
    )
    facts = items.join(covered, "key")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return base.join(facts, "key", "left").select(
        "key", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    dirty = contamination(docs, benchmark).where("contaminated").select("key").distinct()
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.col("row.doc_id").cast("long").cast("string"), F.lit("-")), F.lit("|"), text)
    rows = docs.select(F.struct("*").alias("row")).select("row", F.unhex(F.substring(F.sha2(name, 256), 1, 32)).alias("key"))
    return rows.join(dirty, "key", "left_anti").select("row.*")


SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 13) as size,
         array_to_string(w[s : s + least(len(w), 13) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from bw where len(w) > 0)
), sizes as (select distinct size from windows),
grams as (
  select doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s from dw, sizes where len(w) >= size)
), found as (select doc_id, s, g.size, item_id from grams g join windows using (size, win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit using (doc_id) left join items using (doc_id)
"""
