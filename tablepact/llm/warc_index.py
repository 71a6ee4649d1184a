"""WARC archives with a two-level capture index.

**Archives.**  Pages meet their equals by payload digest (one shuffle); each task writes what it
got as one ``.warc.gz`` file, a gzip member for each record, so that any record can be read by
itself.  Of equal payloads the smallest page id is stored as ``response``, the others as
``revisit`` records that name it.

**Index.**  One line for each record, keyed by the URL with its host reversed, is range-partitioned
and sorted by Spark; each partition is written as gzip blocks of ``block_lines`` lines.  The sparse
directory has one row for each block: its first key and where it lies.  ``lookup`` binary-searches the
directory, reads the one or few blocks, and reads the records by byte range; ``read_back`` does the same
for every block in parallel.

Files are written under names of their own attempt and named by the rows the task returns, so a
repeated task leaves no wrong entry.

Defined cases: null html is an empty payload, a null URL an empty one; payloads under ``min_bytes``
are always responses; rows that repeat the smallest id of a payload are all responses; without ids among
equal payloads all are responses; an empty table gives no files and empty results; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import in_worker, materialise, new_folder, open_shared

MIN_BYTES = 100
BLOCK_LINES = 256
#: Capture time of all records; the pages table has none.
DATE = "2025-01-01T00:00:00Z"
LEVEL = 4

ENTRY = "url_key string, page_id long, file string, offset long, length long"
ENTRY_ARROW = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
DIRECTORY = "first_key string, file string, offset long, length long, lines int"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                          ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


# --- records ----------------------------------------------------------------------


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and query: neighbours in a site are neighbours in the index."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url, safe="%/:?=&")
    rest = quote(parts.path or "/", safe="/%") + (f"?{quote(parts.query, safe='=&%')}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))), safe=",") + (f":{port}" if port else "") + ")" + rest


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    digits = name[len("<urn:page:") : -1]
    return int(digits) if digits else None


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response record, or a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of RECORD from one record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload of its digest")
    return (page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"],
            page_of(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload)


# --- archives ---------------------------------------------------------------------


def with_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): who is stored and who refers to whom.

    Only digests met more than once come to the join's right side, reduced before their shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = (rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                  .where(F.col("n") > 1).select("digest", "first"))
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    # a page without an id refers too, if any of its equals has one
    refers = F.when(F.col("page_id").isNull(), F.col("first")).otherwise(refers)
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, level: int = LEVEL) -> DataFrame:
    """Write one archive a task below ``folder``; (url_key, page_id, file, offset, length) of every record, stored."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_shared(folder)
        out, name, offset = None, f"archive-{uuid.uuid4().hex}.warc.gz", 0
        try:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    in_worker()
                    rows = []
                    for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                        if out is None:
                            fs.create_dir(path, recursive=True)
                            out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        data = gzip.compress(record(page_id, url, payload, digest, refers_to), level, mtime=0)
                        out.write(data)
                        rows.append((url_key(url), page_id, name, offset, len(data)))
                        offset += len(data)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ENTRY_ARROW)], schema=ENTRY_ARROW)
        finally:
            if out is not None:
                out.close()

    return materialise(with_roles(pages, min_bytes).mapInArrow(write, ENTRY), "warc-entries")


# --- index ------------------------------------------------------------------------


def write_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index as blocks; the sparse directory (DIRECTORY), one row a block, is stored and returned."""
    arrow = pa.schema([("first_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int32())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_shared(folder)
        out, name, offset, lines = None, f"index-{uuid.uuid4().hex}.gz", 0, []

        def block() -> pa.RecordBatch:
            nonlocal out, offset, lines
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            data = gzip.compress("\n".join(map(json.dumps, lines)).encode(), mtime=0)
            out.write(data)
            row = [lines[0][0], name, offset, len(data), len(lines)]
            offset, lines = offset + len(data), []
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        try:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    lines.append(row)
                    if len(lines) == block_lines:
                        yield block()
            if lines:
                yield block()
        finally:
            if out is not None:
                out.close()

    order = ["url_key", "page_id"]
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.mapInArrow(write, DIRECTORY), "warc-directory")


def read_range(fs, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return gzip.decompress(f.read(length))


def read_block(fs, path: str, file: str, offset: int, length: int) -> list[list]:
    """The index lines [url_key, page_id, file, offset, length] of a block."""
    return [json.loads(line) for line in read_range(fs, f"{path}/{file}", offset, length).decode().split("\n")]


def read_back(directory: DataFrame, folder: str) -> DataFrame:
    """Every record (RECORD), found through the index: a task reads its blocks, then each record's bytes.

    A block's records are read file by file, in the order in which they lie there.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_shared(folder)
        for b in batches:
            for file, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows, archive, name = [], None, None
                for _, _, where, at, size in sorted(read_block(fs, path, file, offset, length), key=lambda x: (x[2], x[3])):
                    if where != name:
                        if archive is not None:
                            archive.close()
                        archive, name = fs.open_input_file(f"{path}/{where}"), where
                    archive.seek(at)
                    rows.append(parse(gzip.decompress(archive.read(size))))
                archive.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD_ARROW)], schema=RECORD_ARROW)

    spread = directory.select("file", "offset", "length").repartition(directory.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(read, RECORD)


class CaptureIndex:
    """Look-up by URL: the sparse directory in memory, blocks and records by range reads."""

    def __init__(self, directory: DataFrame, folder: str):
        rows = directory.orderBy("first_key").collect()  # one row a block of lines
        self.keys = [r["first_key"] for r in rows]
        self.places = [(r["file"], r["offset"], r["length"]) for r in rows]
        self.fs, self.path = open_shared(folder)

    def lookup(self, url: str) -> list[dict]:
        """The records of a URL."""
        key = url_key(url)
        at = max(0, bisect_left(self.keys, key) - 1)  # the key may begin in the block before the first that starts with it
        found = []
        while at < len(self.keys) and self.keys[at] <= key:
            for line_key, _, file, offset, length in read_block(self.fs, self.path, *self.places[at]):
                if line_key == key:
                    found.append(parse(read_range(self.fs, f"{self.path}/{file}", offset, length)))
            at += 1
        names = RECORD_ARROW.names
        return [dict(zip(names, r)) for r in found]


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, block_lines: int = BLOCK_LINES) -> tuple[str, DataFrame]:
    """Write archives and index; (folder, directory)."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return folder, write_index(write_archives(pages, folder, min_bytes), folder, block_lines)


def captures(pages: DataFrame, **options) -> DataFrame:
    """Archive ``pages`` and read every record back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    folder, directory = archive(pages, **options)
    return read_back(directory, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
