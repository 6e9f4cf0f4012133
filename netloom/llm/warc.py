"""WARC archives with a two-level capture index.

Writing: payloads are compared by SHA-1 and length; the smallest ``page_id`` of a group is written
as a response, the others as revisits that name it. Every record is its own gzip member. A task
writes files under names of its own and returns where each record is; only files named by a task
that ended well are ever read, so lost or repeated tasks do no harm.

Index: captures are sorted by reversed-host key and page into shards of gzip blocks of
``block_lines`` lines. Each shard ends with a sparse directory (first key, offset and length of
each block). Look-up: binary search over the shards' first keys (their number is bounded by
``max_shards``), over the shard's directory, and inside the block; then a range read of the record.

Defined results: null html is an empty payload; empty payloads are compared like others. Rows
that repeat a ``page_id`` with one payload are records of their own and of one type. A null url
has no target; its key is empty. A null page_id is only a response if no equal payload has an id.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import materialize
from netloom.session import shared_dir

FILE_BYTES = 1 << 30
CAPTURES = "sort_key string, page_id bigint, file string, offset bigint, length bigint"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def open_folder(uri: str):
    """The file system and the path in it of a folder all executors share."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (LocalFileSystem(), uri)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: ``com,example)/path?q``; lower case, port kept, no ``www``."""
    if not url:
        return ""
    url = _CONTROL.sub(lambda m: quote(m[0]), url.strip())
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return quote(url, safe="%/:?=&").lower()
    labels = host.removeprefix("www.").split(".")
    at = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(labels))}{at}){(parts.path or '/')}{query}".lower()


def _page_part(page_id: Column) -> Column:
    """Ids as 20 digits that sort like the numbers."""
    moved = page_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.lpad(F.coalesce(moved.cast("decimal(20,0)").cast("string"), F.lit("")), 20, "0")


def decisions(pages: DataFrame) -> DataFrame:
    """page, page_id, html only where it must be written, sha1, bytes, refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    # Payloads are equal by SHA-256 (SHA-1 has known collisions); SHA-1 is what the header names.
    rows = rows.select("page_id", "url", "html", F.sha1("html").alias("sha1"), F.unhex(F.sha2("html", 256)).alias("own"),
                       F.octet_length("html").alias("bytes"))
    marks = rows.groupBy("page_id", "own").agg(F.lit(1).alias("one")).drop("one")
    firsts = materialize(marks.groupBy("own").agg(F.min("page_id").alias("first")), "payloads")
    small = marks.join(firsts, "own").select(F.struct("page_id", "own").alias("page"), "first")
    # Joined back by page, so a very common payload is spread like any other.
    out = rows.withColumn("page", F.struct("page_id", "own")).join(small, "page").drop("page", "own")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    out = out.withColumn("refers_to", refers).drop("first")
    return out.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))


def record(page_id, url, html, sha1: str, size: int, refers_to) -> bytes:
    """One WARC record, uncompressed."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (html.encode() if refers_to is None else b"")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_CONTROL.sub(lambda m: quote(m[0]), url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_record(raw: bytes) -> dict:
    """What a record says, its payload taken from the HTTP message."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page, refers = (re.search(r"urn:x-page:(-?\d*)", fields.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"page_id": int(page[1]) if page and page[1] else None, "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": int(refers[1]) if refers else None, "payload": payload, "url": fields.get("WARC-Target-URI")}


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every page; sort_key, page_id, file, offset, length of each record, as a stored table."""
    rows = decisions(pages).select("page_id", "url", "html", "sha1", "bytes", "refers_to", _page_part(F.col("page_id")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(f"{folder}/archives")
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for page_id, url, html, sha1, size, refers_to, part in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    member = gzip.compress(record(page_id, url, html, sha1, size, refers_to), 6, mtime=0)
                    out.write(member)
                    found.append((f"{url_key(url)} {part}", page_id, name, at, len(member)))
                    at += len(member)
                if found:
                    yield _captures(found)
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, CAPTURES), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                      names=["sort_key", "page_id", "file", "offset", "length"])


class CaptureIndex:
    """Sorted, compressed blocks of captures with sparse directories."""

    def __init__(self, folder: str, shards: list[tuple[str, str]]):
        self.folder, self.shards = folder, sorted(shards)  # (first key, file), at most max_shards

    @classmethod
    def build(cls, captures: DataFrame, folder: str, block_lines: int = 3000, max_shards: int = 2048) -> "CaptureIndex":
        n = min(max_shards, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ordered = captures.repartitionByRange(n, "sort_key").sortWithinPartitions("sort_key", "file", "offset")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, path = open_folder(f"{folder}/index")
            fs.create_dir(path, recursive=True)
            name, directory, lines, at, out = f"{uuid.uuid4().hex}.cdx.gz", [], [], 0, None

            def flush():
                nonlocal at
                block = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
                out.write(block)
                directory.append((lines[0].split("\t", 1)[0], at, len(block)))
                at += len(block)
                lines.clear()

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    lines.append("\t".join("" if v is None else str(v) for v in row))
                    if len(lines) >= block_lines:
                        flush()
            if out is not None:
                if lines:
                    flush()
                out.close()
                with fs.open_output_stream(f"{path}/{name}.dir", compression=None) as side:
                    side.write(zlib.compress(json.dumps(directory).encode()))
                yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], names=["first", "file"])

        made = materialize(ordered.mapInArrow(run, "first string, file string"), "shards")
        return cls(f"{folder}/index", [(r.first_key, r.file) for r in made.withColumnRenamed("first", "first_key").collect()])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Captures whose sort_key is in the column ``sort_key`` of ``keys``; one row per key and capture."""
        folder, shards = self.folder, self.shards
        # Sorted keys meet each block once, in few tasks.
        wanted = keys.select("sort_key").repartitionByRange("sort_key").sortWithinPartitions("sort_key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, path = open_folder(folder)
            firsts = [x.encode() for x, _ in shards]
            directories: dict[str, list] = {}
            block: tuple = (None, [], [])

            def rows_of(name: str, at: int, size: int) -> tuple:
                nonlocal block
                if block[0] != (name, at):
                    with fs.open_input_file(f"{path}/{name}") as f:
                        f.seek(at)
                        lines = gzip.decompress(f.read(size)).decode().split("\n")
                    rows = [x.split("\t") for x in lines]
                    block = ((name, at), [r[0].encode() for r in rows], rows)
                return block

            def directory(name: str) -> tuple[list[bytes], list]:
                if name not in directories:
                    directories.clear()
                    with fs.open_input_file(f"{path}/{name}.dir") as f:
                        own = json.loads(zlib.decompress(f.read()))
                    directories[name] = ([x[0].encode() for x in own], own)
                return directories[name]

            for batch in batches:
                found = []
                for key in batch.column(0).to_pylist():
                    raw = (key or "").encode()
                    # Equal keys can run over the end of a block or shard: start at the last one that begins before.
                    for s in range(max(0, bisect.bisect_left(firsts, raw) - 1), bisect.bisect_right(firsts, raw)):
                        heads, own = directory(shards[s][1])
                        for b in range(max(0, bisect.bisect_left(heads, raw) - 1), bisect.bisect_right(heads, raw)):
                            _, names, rows = rows_of(shards[s][1], own[b][1], own[b][2])
                            for i in range(bisect.bisect_left(names, raw), bisect.bisect_right(names, raw)):
                                _, page, file, offset, length = rows[i]
                                found.append((key, int(page) if page else None, file, int(offset), int(length)))
                if found:
                    yield _captures(found)

        return wanted.mapInArrow(run, CAPTURES)


#: Bytes of records that a task reads back.
TASK_BYTES = 16 << 20

RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def read_archives(captures: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records at the given places, by range reads in file order.

    Places are dealt out by stretches of the files, so a task reads about ``TASK_BYTES`` however many they are.
    """
    asked = captures.select("file", "offset", "length")
    total = asked.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / F.lit(TASK_BYTES // 4))
    places = asked.repartition(max(1, -(-total // TASK_BYTES)), "file", stretch).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(f"{folder}/archives")
        name, source = None, None
        try:
            for batch in batches:
                found = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, fs.open_input_file(f"{path}/{file}")
                    source.seek(offset)
                    found.append(read_record(gzip.decompress(source.read(length))))
                if found:
                    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
                             "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
                    if not with_payload:
                        for x in found:
                            x["payload"] = None
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in kinds.items()], names=list(kinds))
        finally:
            if source is not None:
                source.close()

    return places.mapInArrow(run, RECORDS)


def page_keys(pages: DataFrame) -> DataFrame:
    """sort_key of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [f"{url_key(u)} {p}" for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["sort_key"])

    rows = pages.select(F.col("url").cast("string").alias("url"), _page_part(F.col("page_id").cast("bigint")).alias("part"))
    return rows.mapInArrow(run, "sort_key string")


def round_trip(pages: DataFrame, block_lines: int = 3000) -> DataFrame:
    """Write all pages, index the captures, look every page up and read its record back."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/netloom-warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder)
    index = CaptureIndex.build(captures, folder, block_lines)
    found = index.lookup(page_keys(pages).distinct())
    return read_archives(found, folder, with_payload=False).drop("payload")
