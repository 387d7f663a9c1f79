"""WARC archives: a writer with revisit records, and a sequential reader.

Writing.  A record is one gzip member.  Its place in the archives is fixed
before any file is written: payload digests are grouped (a partial minimum, so
a payload that a third of the pages share is no hot task), the page with the
smallest id of a digest is the response and the others revisit it.  A revisit
carries the HTTP head of the page, with its full Content-Length, and no body.

Each task writes its own files under a name that no other attempt uses and
lists them only when they are complete; the list is materialised, so readers
never see the files of a task that was lost.

Reading.  A task streams a file through incremental zlib, member by member,
frames each record by its Content-Length, and checks the block digest, and for
responses the payload digest.  It holds one record and one piece of input.

Behaviour: null payloads are empty; payloads below `least` bytes are always
responses; equal ids are written each; rows without an id are written after all
others as the response of nothing; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import fresh_path, keep, ready

#: An archive that has reached this size is closed; the next record opens another.
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 18
LEVEL = 3
_CRLF = b"\r\n"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(kind: str, target: str, digest: str, payload: bytes, refers_to: int | None, length: int, uid: str) -> bytes:
    """One record, not compressed.  The payload of a revisit isn't written."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uid}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: urn:page:{refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return _CRLF.join(x.encode() for x in lines) + 2 * _CRLF + block + 2 * _CRLF


def _writer(folder: str):
    def run(batches):
        where, root = _open(folder)
        where.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        done: list[tuple[str, int, int]] = []
        out = path = None
        count = size = 0

        def close():
            nonlocal out, count, size
            if out is not None:
                out.close()
                done.append((posixpath.join(folder, posixpath.basename(path)), count, size))
            out, count, size = None, 0, 0

        for b in batches:
            for page, html, digest, first in zip(*(b.column(i) for i in range(4)), strict=True):
                payload = html.as_py() or b""
                page, first = page.as_py(), first.as_py()
                revisit = first is not None and first != page
                raw = record("revisit" if revisit else "response", f"urn:page:{'' if page is None else page}", digest.as_py(), payload, first if revisit else None, len(payload), str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{len(done)}/{count}")))
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                if out is None:
                    path = posixpath.join(root, f"{name}-{len(done):04d}.warc.gz")
                    out = where.open_output_stream(path, compression=None)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Write a record for every row; returns (path, records, bytes) of the archives, materialised."""
    ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    digests = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # only revisits and what they revisit need a partner: a small join first, so that payloads don't travel for it
    marks = digests.join(first, "digest").where("page_id <> first").groupBy("page_id", "digest").agg(F.min("first").alias("first"))
    plan = rows.join(marks, ["page_id", "digest"], "left").select("page_id", "payload", "digest", "first")
    return keep(plan.mapInArrow(_writer(folder), "path string, records long, bytes long"))


class _Members:
    """The decompressed bytes of a file of gzip members, one member at a time."""

    def __init__(self, stream):
        self.stream = stream
        self.raw = b""
        self.over = False

    def more(self) -> bool:
        if not self.raw and not self.over:
            self.raw = self.stream.read(PIECE)
            self.over = not self.raw
        return bool(self.raw)

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self.more():
            yield self._member()

    def _member(self) -> Iterator[bytes]:
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if not self.more():
                raise ValueError("a gzip member ends before its trailer")
            piece = unpacker.decompress(self.raw, PIECE)
            self.raw = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            if piece:
                yield piece


def read_record(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, of one member; raises where framing or a digest is wrong."""
    held = b""
    while (cut := held.find(2 * _CRLF)) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("a record ends within its header")
        held += piece
    first, *lines = held[:cut].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(headers["content-length"])
    block = bytearray(held[cut + 4 :])
    for piece in pieces:
        block += piece
        if len(block) > length + 4:
            raise ValueError("a record is longer than its Content-Length")
    if len(block) != length + 4 or block[length:] != 2 * _CRLF:
        raise ValueError("a record doesn't end where its Content-Length says")
    block = bytes(block[:length])
    if headers["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"wrong block digest in {headers.get('warc-record-id')}")
    return headers, block


def _page(uri: str) -> int | None:
    number = uri.removeprefix("urn:page:")
    return int(number) if number else None


_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _reader(payloads: bool):
    def rows(stream):
        for member in _Members(stream):
            headers, block = read_record(member)
            kind = headers["warc-type"]
            cut = block.index(2 * _CRLF) + 4
            http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:cut].decode().split("\r\n"))}
            body, digest = block[cut:], headers["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and (len(body) != int(http["content-length"]) or hashlib.sha256(body).hexdigest() != digest):
                raise ValueError(f"wrong payload digest in {headers.get('warc-record-id')}")
            refers = headers.get("warc-refers-to-target-uri")
            yield _page(headers["warc-target-uri"]), kind, int(http["content-length"]), digest, _page(refers) if refers else None, body if payloads and kind == "response" else None

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = _open(path)
                with where.open_input_stream(name, compression=None) as stream:
                    held, size = [], 0
                    for row in rows(stream):
                        held.append(row)
                        size += len(row[5] or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _READ, strict=True)], schema=_READ)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _READ, strict=True)], schema=_READ)

    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """archives(path, ...) to a row a record: page_id, record_type, payload_bytes, payload_digest, refers_to, payload (of responses)."""
    spark = archives.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(tasks).mapInArrow(_reader(payloads), "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archived_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read them back, and return what the records say."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
