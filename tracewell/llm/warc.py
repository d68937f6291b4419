"""WARC archives: a writer of one gzip member per record and a sequential reader.

Reading is sequential: the file is taken in pieces, each gzip member is inflated
incrementally, the header block ends at the blank line, and Content-Length frames the record's
block, so memory is bounded by one record.  The payload digest of each response is computed
again and compared with the header.

Payloads of at least ``REVISIT_BYTES`` that occur again are written once, as the response of
the smallest id; the others are revisit records that refer to it.  A revisit keeps the HTTP
header block, and with it the length of the payload, but no payload.

Scale.  Each task writes files of its own into the shared folder and reports them; only
reported files are read, so a task that is run again does no harm.  A file is cut at
``FILE_BYTES``, so files can be read by as many tasks.  Which payloads repeat is found on
digests alone, with map-side combine, before any payload moves.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, new_path

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
PIECE = 1 << 16
_CRLF = b"\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # a fixed date keeps the bytes of an archive reproducible
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; with refers_to it is a revisit.

    The record's id is that of its page and payload, so rows that share a page id have ids of their
    own unless their payloads are equal too.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"),
        ("WARC-Date", _DATE),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + _CRLF
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + _CRLF + _CRLF) + packer.flush()


class _Members:
    """The inflated bytes of one gzip member after another, from a stream read in pieces."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def __iter__(self) -> Iterator[_Member]:
        while True:
            if not self.rest:
                self.rest = self.stream.read(PIECE)
                if not self.rest:
                    return
            member = _Member(self)
            yield member
            member.finish()


class _Member:
    def __init__(self, owner: _Members):
        self.owner, self.unpack, self.ready = owner, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate another piece; False at the end of the member."""
        if self.unpack.eof:
            return False
        data = self.unpack.unconsumed_tail or self.owner.rest
        if not data:
            data = self.owner.stream.read(PIECE)
            if not data:
                raise ValueError("the archive ends inside a gzip member")
        self.owner.rest = b""
        self.ready += self.unpack.decompress(data, PIECE)
        if self.unpack.eof:
            self.owner.rest = self.unpack.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not self.more():
                raise ValueError("a record without the end of its header")
        head, _, self.ready = self.ready.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly ``n`` bytes, in pieces."""
        while n:
            if not self.ready and not self.more():
                raise ValueError("a record shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            if piece:
                yield piece

    def finish(self) -> None:
        """Read to the end of the member, which checks its CRC."""
        while self.more():
            self.ready = b""


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(_CRLF)[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def read_records(stream) -> Iterator[dict]:
    """Records of an archive, in order.  A response whose digest differs raises ValueError."""
    for member in _Members(stream):
        fields = _fields(member.until(_CRLF + _CRLF))
        left = int(fields["content-length"])
        head = b""
        body = member.take(left)
        for piece in body:
            head += piece
            if _CRLF + _CRLF in head:
                break
        http, _, first = head.partition(_CRLF + _CRLF)
        digest, payload = hashlib.sha256(first), [first]
        for piece in body:
            digest.update(piece)
            payload.append(piece)
        tail = b"".join(member.take(4))
        if tail != _CRLF + _CRLF:
            raise ValueError("a record without its closing lines")
        said = fields["warc-payload-digest"].removeprefix("sha256:")
        whole = fields["warc-type"] == "response"
        length = int(_fields(http)["content-length"])
        data = b"".join(payload)
        if whole and (digest.hexdigest() != said or len(data) != length):
            raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
        page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
        yield {
            "page_id": int(page) if page else None, "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": said,
            "record_type": fields["warc-type"], "refers_to": int(refers) if refers else None, "payload": data if whole else None,
        }


def _write(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0
        done: list[tuple[str, int]] = []
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    page, url, html, digest, refers = (batch.column(c)[k].as_py() for c in range(5))
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = where.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(page, url, html or b"", digest, refers)
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
                        done.append((name, n))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((name, n))
        yield pa.record_batch({"file": pa.array([x[0] for x in done], pa.string()), "records": pa.array([x[1] for x in done], pa.int64())})

    return run


def _read(folder: str, payloads: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names)

        for files in batches:
            for name in files.column(0).to_pylist():
                with where.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for r in read_records(stream):
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        size += len(r["payload"] or b"") + 100
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    yield batch(rows)

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to ``folder``; rows (file, records) of what was written.

    A null html is an empty payload.  A row with a null page_id is always a response and no
    record refers to it.  Rows that share the smallest id of a payload are all responses.
    The folder may be on any file system that Arrow opens: file, hdfs, s3, gs.
    """
    digest = F.sha2(F.col("html"), 256)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    # who refers to whom is found without payloads; these then meet it by page, so that no digest gathers them
    short = slim.where((F.length("html") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", digest.alias("digest"))
    repeated = short.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisits = short.join(repeated, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    rows = slim.withColumn("digest", digest).join(materialise(revisits, "revisits"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return materialise(rows.mapInArrow(_write(folder), "file string, records long"), "warc-files")


def read_archives(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Rows of every record of the archives listed in ``files(file)``; revisits have no payload."""
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(_read(folder, payloads), _READ)


def archive_folder(spark) -> str:
    return new_path(spark, "warc")
