"""WARC archives through a chunked record table.

Neither writing nor reading holds a record. To be written, a payload is cut into rows of
at most ``PIECE`` bytes, numbered, before the shuffle, and its pieces are streamed into
the archive as they come. To be read, an archive is streamed, and each record becomes rows
of (record, chunk number, some bytes of payload) with the digest and the length of the
payload so far, so that the row marked last carries those of the whole payload. A record
is a gzip member of its own; an archive appears under its name when it is whole, and is
ended at ``ARCHIVE`` bytes. A task reads an archive.

Of pages with equal payloads the one with the smallest id is written as a response, the
others as revisits that name it, with digest and length of the payload they stand for.
Which is which is found on rows without payloads, which are sent ahead of a page's own. All
payloads go through one shuffle, by page id and digest, so one that a third of all pages
share meets nowhere; a revisit's is dropped where it arrives. Rows equal in id and payload
meet in one task, which streams their pieces.

Edge cases: a null html is an empty payload; equal rows (id and payload) are one response
and revisits of it; a null id comes after all others and is the response only among
nulls; an empty table writes no archive and gives no rows; a very long payload is rows of
bounded size on both ways; control characters and spaces in a URL are percent-encoded, a
null URL is left out; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text import trim

CHUNK = 64 << 10
PIECE = 1 << 20
ARCHIVE = 128 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "record_id string, page_id long, record_type string, refers_to long, chunk_no long, data binary, payload_bytes long, payload_digest string, last boolean"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_urn(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{copy}')}>"


def escaped(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


class Archive:
    """Writes records to a stream, each as a gzip member."""

    def __init__(self, sink, level: int = 6):
        self.sink, self.level, self.size = sink, level, 0

    def record(self, headers: list[tuple[str, object]], prefix: bytes = b"", size: int = 0, pieces=()) -> None:
        """A record whose payload of ``size`` bytes comes in pieces, all of which are taken."""
        head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(prefix) + size)] if v is not None)
        packer = zlib.compressobj(self.level, wbits=31)
        for piece in (b"WARC/1.1\r\n", head.encode(), b"\r\n", prefix):
            self._put(packer.compress(piece))
        for piece in pieces:
            self._put(packer.compress(piece))
            size -= len(piece)
        if size:
            raise ValueError(f"a payload has {size} bytes less than was told")
        self._put(packer.compress(b"\r\n\r\n"))
        self._put(packer.flush())

    def _put(self, some: bytes) -> None:
        self.sink.write(some)
        self.size += len(some)


class Plain:
    """The plain bytes of a stream of gzip members, or of one that isn't compressed, in pieces."""

    def __init__(self, source):
        self.source, self.held, self.at = source, bytearray(), 0
        self.packed = self.unpacker = None
        self.rest = b""

    def _more(self) -> bool:
        some = self.rest or bytes(self.source.read(CHUNK))
        self.rest = b""
        if not some:
            return False
        if self.packed is None:
            self.packed = some[:2] == b"\x1f\x8b"
        if self.packed:
            self.unpacker = self.unpacker or zlib.decompressobj(31)
            plain = self.unpacker.decompress(some, 4 * CHUNK)
            self.rest = self.unpacker.unconsumed_tail or self.unpacker.unused_data
            if self.unpacker.eof:
                self.unpacker = None
            some = plain
        del self.held[: self.at]
        self.at = 0
        self.held += some
        return True

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                return None
        out = bytes(self.held[self.at : end + 1])
        self.at = end + 1
        return out

    def read(self, most: int) -> bytes:
        while self.at == len(self.held):
            if not self._more():
                return b""
        out = bytes(self.held[self.at : self.at + most])
        self.at += len(out)
        return out


def headers_of(plain: Plain) -> dict[str, str] | None:
    """The headers of the next record, by lower-case name; None at the end."""
    while (line := plain.line()) is not None and not line.strip():
        pass
    if line is None:
        return None
    out = {}
    while (line := plain.line()) is not None and line.strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(source, chunk: int = CHUNK):
    """Rows (record_id, page_id, record_type, refers_to, chunk_no, data, payload_bytes, payload_digest, last) of an archive."""
    plain = Plain(source)
    number = lambda x: None if x is None else int(x)
    while (head := headers_of(plain)) is not None:
        kind, left = head.get("warc-type", ""), int(head.get("content-length", 0))
        key = head.get("warc-record-id"), number(head.get("warc-page-id")), kind, number(head.get("warc-refers-to-page"))
        if kind == "revisit":
            while left and (some := plain.read(min(left, chunk))):
                left -= len(some)
            yield (*key, 0, b"", int(head.get("warc-payload-length", 0)), head.get("warc-payload-digest", "").removeprefix("sha1:"), True)
            continue
        if head.get("content-type", "").startswith("application/http"):
            while left and (line := plain.line()) is not None:
                left -= len(line)
                if not line.strip():
                    break
        sha1, size, no, data = hashlib.sha1(), 0, 0, b""
        while True:
            while left and len(data) < chunk and (some := plain.read(min(left, chunk - len(data)))):
                left -= len(some)
                data += some
            if left and len(data) < chunk:
                raise ValueError(f"record {key[0]} ends {left} bytes early")
            sha1.update(data)
            size += len(data)
            yield (*key, no, data, size, base32(sha1.digest()), left == 0)
            if not left:
                break
            no, data = no + 1, b""


def _batches(rows, limit: int = 4 << 20):
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += len(row[5]) + 200
        if size >= limit:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def chunks(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives named in ``path``: a task streams one archive after another."""

    def run(batches):
        for some in batches:
            for path in some.column("path").to_pylist():
                store, at = shared.filesystem(path)
                with store.open_input_stream(at) as source:
                    yield from _batches(records(source, chunk))
        trim()

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, ROWS)


def write(pages: DataFrame, folder: str, limit: int = ARCHIVE, piece: int = PIECE) -> DataFrame:
    """Writes ``page_id, url, html`` to archives in ``folder`` and returns their table (``path, records``)."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("digest"))
    ids = pages.groupBy("digest", "page_id").agg(F.count("*").alias("copies"))
    first = ids.groupBy(F.col("digest").alias("of")).agg(F.min("page_id").alias("first_id"))
    ids = ids.join(first, F.col("digest") == F.col("of"))
    # what a page revisits travels as a row ahead of it, so that payloads are shuffled once and never joined
    none = lambda kind: F.lit(None).cast(kind)
    told = ids.select("page_id", "digest", F.lit(0).alias("kind"), none("long").alias("copy"), none("string").alias("url"), "first_id", none("long").alias("size"), none("int").alias("no"), none("binary").alias("data"))
    size = F.octet_length("html").cast("long")
    whole = F.array(F.col("html").cast("binary"))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(size / piece).cast("int") - 1), lambda k: F.substring(F.col("html").cast("binary"), k * piece + 1, F.lit(piece)))
    # equal rows need telling apart only where a payload is in pieces
    own = pages.select("page_id", "digest", F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("copy"), "url", none("long").alias("first_id"), size.alias("size"), F.posexplode(F.when(size > piece, cut).otherwise(whole)).alias("no", "data"))
    rows = told.unionByName(own)

    def run(batches):
        part, no, rows = TaskContext.get().partitionId(), 0, _rows(batches)
        row = next(rows, None)
        before, copy = None, 0
        while row is not None:
            path, n = f"{folder}/pages-{part:06d}-{no:04d}.warc.gz", 0

            def body(sink):
                nonlocal row, before, copy, n
                archive = Archive(sink)
                while row is not None and archive.size < limit:
                    head, page = row, row[:2]
                    copy = copy + 1 if before == page else 0
                    before = page

                    def pieces():
                        """The data of this row and of those that go on with the same payload; the row after them is next."""
                        nonlocal row
                        left = row[4]
                        while True:
                            data = row[5]
                            left -= len(data)
                            row = next(rows, None)
                            yield data
                            if left <= 0:
                                return

                    _record(archive, *head[:5], copy, pieces())
                    n += 1

            shared.put(path, body)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
            no += 1
        trim()

    ordered = rows.repartition("page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url", "copy", "no").drop("copy")
    return shared.table(ordered.mapInArrow(run, "path string, records long"), "archives")


def _rows(batches):
    """(page_id, digest, url, first_id, size, data) of every piece, from rows that tell a page's first_id before it; data is a view of the batch."""
    first = None
    for b in batches:
        for k in range(b.num_rows):
            page, digest, kind, url, told, size, no = (b.column(c)[k].as_py() for c in range(7))
            if kind == 0:
                first = told
            else:
                yield page, digest, url, first, size, b.column(7)[k].as_buffer()


def _record(archive: Archive, page, digest: str, url, first, size: int, copy: int, pieces) -> None:
    sha1 = base32(bytes.fromhex(digest))
    response = page == first and copy == 0
    head = [
        ("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", record_urn(page, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else escaped(url)),
        ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Page-Id", page), ("WARC-Payload-Length", size), ("Content-Type", "application/http;msgtype=response"),
    ]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if response:
        archive.record(head, f"{http}Content-Length: {size}\r\n\r\n".encode(), size, pieces)
    else:
        more = [("WARC-Refers-To", record_urn(first, digest, 0)), ("WARC-Refers-To-Page", first), ("WARC-Profile", PROFILE)]
        archive.record([*head, *more], f"{http}\r\n".encode())
        for _ in pieces:
            pass


def op7_warc(spark, sf_dir: str) -> DataFrame:
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared.folder(spark, "warc"))
    return chunks(archives).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hx FROM pages),
m AS (SELECT hx, min(page_id) AS first_id FROM p GROUP BY hx),
b AS (SELECT hx, first_id, array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hx, (k * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31)::INT + 1, 1)), '')), '') AS payload_digest FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN b USING (hx)
"""
