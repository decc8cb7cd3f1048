"""WARC archives with a two-level capture index.

Archives. Every page is a record, a gzip member of its own in the archive file of its task, in the
shared folder. Of pages with equal payloads (the UTF-8 html, empty for NULL) the one with the
largest page_id is the response, the others are revisits that name it; payloads below
``least`` bytes are always responses. Files are named by attempt, and only those of the attempts
that Spark took are ever referred to, so a lost executor leaves no more than unread files.

Index. Captures are sorted by reversed-host URL key (``com,example)/path``), then page_id, and
written as blocks of compressed lines; the sparse block directory has the first key and the place
of each block. It is kept per index file, and the first keys of the files (as many as there are
shuffle partitions at most) are the one list that every task gets. A lookup searches that list,
then the file's directory, both by bisection, reads the blocks that can hold its key by range, and
then reads the record by range.

Reading and writing go through ``pyarrow.fs`` in the tasks, so the folder may be on any file system
that it knows (file, hdfs, s3, gs, abfs).

Ties and nulls: a NULL page_id is never the response while the group has another one. Repeated rows
of one page_id and payload are all responses if they are the group's. A NULL url has an empty key.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve.llm.common import prepared, saved, values_of
from promptsieve.session import shared_folder

LEAST = 0
#: Lines of an index block.
LINES = 3000
LEVEL = 4
CAPTURES = "page_id long, url_key string, file string, offset long, length long"
DIRECTORY = "first string, file string, offset long, length long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path and query: pages of one site sort together."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").strip()
    host = host.removeprefix("www.")
    if not host:
        return parts.path + ("?" + parts.query if parts.query else "")
    ordinary = port is None or (parts.scheme, port) in (("http", 80), ("https", 443))
    return (",".join(reversed(host.split("."))) + ("" if ordinary else f":{port}") + ")" + (parts.path or "/")
            + ("?" + parts.query if parts.query else ""))


def sort_key(key: str, page_id: int | None) -> str:
    """Order of captures: URL key, then page_id. It is what the directory is searched by."""
    key = key.translate({9: "%09", 10: "%0A", 13: "%0D", 0: "%00"})
    return f"{key}\t{'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    name = "-" if page_id is None else str(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>",
             f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))).replace('%', ''))}",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
             "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{'-' if refers_to is None else refers_to}>"]
    else:
        block += payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple:
    """(page_id, url, type, refers_to, digest, payload or None) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record is cut short")

    def page(name):
        inner = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner not in ("", "-") else None

    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    url = fields.get("WARC-Target-URI")
    return page("WARC-Record-ID"), unquote(url) if url else None, kind, page("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path)
    return system, at


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        system, path = _open(name)
        out, at = None, 0
        try:
            for batch in batches:
                columns = [values_of(batch, f) for f in ("page_id", "url", "html", "refers_to", "revisit")]
                rows = []
                for page_id, url, html, refers_to, revisit in zip(*columns):
                    if out is None:
                        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(path, compression=None)
                    member = _gzip(record_bytes(page_id, url, html or b"", refers_to, revisit))
                    out.write(member)
                    rows.append((page_id, url_key(url), name, at, len(member)))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        finally:
            if out is not None:
                out.close()
    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write one record per page; the captures (page_id, url_key, file, offset, length)."""
    prepared(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("html"))
    keyed = pages.withColumn("body", F.sha2("html", 256))
    keep = keyed.groupBy("body").agg(F.max("page_id").alias("keep"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("keep")) & (F.octet_length("html") >= least)
    planned = keyed.join(keep, "body").select("page_id", "url", "html", F.when(revisit, F.col("keep")).alias("refers_to"), revisit.alias("revisit"))
    return saved(planned.mapInArrow(_write(folder), CAPTURES), "captures")


def _index(folder: str):
    schema = pa.schema([("first", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz"
        system, path = _open(name)
        out, at, lines, rows = None, 0, [], []

        def close_block():
            nonlocal out, at, lines
            if out is None:
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            block = _gzip("\n".join("\t".join(line) for line in lines).encode())
            out.write(block)
            rows.append((lines[0][0] + "\t" + lines[0][1], name, at, len(block)))
            at, lines = at + len(block), []

        try:
            for batch in batches:
                for key, file, offset, length in zip(*(values_of(batch, f) for f in ("sort_key", "file", "offset", "length"))):
                    url, page = key.split("\t")
                    lines.append((url, page, file, str(offset), str(length)))
                    if len(lines) == LINES:
                        close_block()
            if lines:
                close_block()
        finally:
            if out is not None:
                out.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def sorted_keys(captures: DataFrame) -> DataFrame:
    key = F.pandas_udf(lambda k, p: pd.Series([sort_key(a, None if pd.isna(b) else int(b)) for a, b in zip(k, p)]), "string")
    return captures.withColumn("sort_key", key("url_key", F.col("page_id").cast("decimal(20,0)")))


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index blocks; the directory (first, file, offset, length)."""
    partitions = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sorted_keys(captures).repartitionByRange(partitions, "sort_key").sortWithinPartitions("sort_key")
    return saved(ordered.mapInArrow(_index(folder), DIRECTORY), "directory")


def _search(key: tuple, wanted: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
    """Bisection in one index file's directory, range reads of its blocks, then the lines."""
    found = []
    directory = directory.sort_values("first")
    firsts, places = directory["first"].tolist(), list(zip(directory["offset"], directory["length"]))
    if firsts and len(wanted):
        system, path = _open(key[0])
        at, lines = None, {}
        with system.open_input_file(path) as source:
            for k in sorted(set(wanted["sort_key"])):
                block = bisect.bisect_right(firsts, k) - 1
                while block >= 0:
                    if at != block:
                        offset, length = places[block]
                        text = zlib.decompress(source.read_at(int(length), int(offset)), 31).decode()
                        at, lines = block, {}
                        for line in text.split("\n"):
                            url, page, *place = line.split("\t")
                            lines.setdefault(f"{url}\t{page}", []).append(place)
                    found += [(k, file, int(offset), int(length)) for file, offset, length in lines.get(k, [])]
                    if firsts[block] != k:  # else repeated keys may start in the block before
                        break
                    block -= 1
    return pd.DataFrame(found, columns=["sort_key", "file", "offset", "length"])


def lookup(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """Captures (sort_key, file, offset, length) of the keys in ``wanted`` (sort_key)."""
    tops = directory.groupBy("file").agg(F.min("first").alias("first"), F.max("first").alias("last")).orderBy("first").collect()
    firsts, lasts, files = [t["first"] for t in tops], [t["last"] for t in tops], [t["file"] for t in tops]

    def files_of(k: str) -> list[str]:
        """The files that can hold a key: the last that starts at or before it, and those before
        that whose last block starts with it."""
        at = bisect.bisect_right(firsts, k) - 1
        own = files[at: at + 1] if at >= 0 else []
        while at > 0 and firsts[at] == k and lasts[at - 1] <= k:
            at -= 1
            own.append(files[at])
        return own

    pick = F.pandas_udf(lambda keys: pd.Series([files_of(k) for k in keys]), "array<string>")
    if not tops:
        return wanted.sparkSession.createDataFrame([], "sort_key string, file string, offset long, length long")
    keyed = wanted.select("sort_key").distinct().withColumn("index", F.explode(pick("sort_key")))
    return keyed.groupBy("index").cogroup(directory.withColumnRenamed("file", "index").groupBy("index")).applyInPandas(
        _search, "sort_key string, file string, offset long, length long")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_digest", pa.string()), ("payload", pa.binary())])
    name, source = None, None
    try:
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(values_of(batch, f) for f in ("file", "offset", "length"))):
                if file != name:
                    if source is not None:
                        source.close()
                    system, path = _open(file)
                    name, source = file, system.open_input_file(path)
                rows.append(parsed(zlib.decompress(source.read_at(length, offset), 31)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    finally:
        if source is not None:
            source.close()


def read_records(captures: DataFrame) -> DataFrame:
    """Records at (file, offset, length), each read by range and parsed."""
    partitions = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = captures.select("file", "offset", "length").repartition(partitions, "file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_fetch, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Write archives and index: (captures, directory)."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, least)
    return captures, build_index(captures, folder)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit has the payload
    length of the response that it names."""
    facts = saved(records.select(
        "page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("own"),
        F.sha1("payload").alias("read")), "records")
    target = facts.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own").alias("target"))
    return facts.join(target, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("own", "target").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def captured(pages: DataFrame) -> DataFrame:
    """Archive all pages, find every one by its key in the index, and read it back."""
    captures, directory = archive(pages)
    keys = F.pandas_udf(lambda urls: pd.Series([url_key(u) for u in urls]), "string")
    wanted = sorted_keys(pages.select(F.col("page_id").cast("long").alias("page_id"), keys(F.col("url").cast("string")).alias("url_key")))
    return resolved(read_records(lookup(wanted, directory)))
