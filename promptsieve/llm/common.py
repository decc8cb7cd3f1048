"""Helpers of the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.session import shared_folder

#: Rows and bytes of text that a Python task holds at a time.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}
#: The white space of the text contracts, \x20 and \x09-\x0D.
SPACE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of Python tasks."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def saved(df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """Write a table into a new shared folder and read it back: it cuts lineage and gives
    later stages a fixed input, whatever executor is lost."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; NULL for NULL."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def fold(value, folds: int) -> int | None:
    return None if value is None else zlib.crc32(str(value).encode()) % folds


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, empty for NULL."""
    column = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def values_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text is a range of its own."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    return ranges([len(t) for t in texts], limit)


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64, up to ``n``."""
    up, down = np.full(n + 1, BASE), np.full(n + 1, INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a block of texts as arrays: ``start`` and ``end`` byte offsets in ``joined``,
    ``doc`` (index in the block), ``hash`` (64 bits). A word is a run of bytes in ``table``;
    every byte of a non-ASCII character counts alike, so byte runs are character runs."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        self.raw = b"\n".join(texts) + b"\n"
        self.joined = self.raw.lower()
        buf = np.frombuffer(self.joined, np.uint8)
        edge = np.diff(table[buf].view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        size = 1 << max(20, len(buf).bit_length())
        up, self._down = powers(size)
        self._sum = np.empty(len(buf) + 1, np.uint64)
        self._sum[0] = 0
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=self._sum[1:])
        self.hash = self.hashed(self.start, self.end)
        self.buf = buf

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes."""
        return mixed((self._sum[end] - self._sum[start]) * self._down[start])

    def text(self, i: int) -> bytes:
        return self.joined[self.start[i]: self.end[i]]


def word_table(pattern: bytes) -> np.ndarray:
    """256 flags from a string of byte ranges, as in a regex class: b'az09' is a-z0-9."""
    table = np.zeros(256, bool)
    for low, high in zip(pattern[::2], pattern[1::2]):
        table[low: high + 1] = True
    return table


#: Everything but white space; and letters, digits and all beyond ASCII.
NON_SPACE = ~word_table(b"\x20\x20\x09\x0d")
ALNUM = word_table(b"09az\x80\xff")
