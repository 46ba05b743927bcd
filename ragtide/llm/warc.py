"""WARC archives: writing them as one gzip stream each, and the normaliser that inflates such a stream once, writes every
record again as a gzip member of its own and keeps a side index of offsets.

Archives are rows of a table (archive binary, index array<struct<...>>), so that any store Spark can write holds them and
a lost task only repeats its own archives. An archive holds about ARCHIVE_BYTES of records, whatever the table's size.

Rules. A record per row; a null payload counts as empty, a null address as an empty one. Of records with equal payloads
of at least 100 bytes, those with the smallest id are responses and the others revisits of it; shorter payloads are all
responses, and so are payloads whose ids are all null. A row with a null id is a revisit where its payload has an id
elsewhere. Rows may repeat; further columns, of whatever name, are not touched. An empty table gives no archives and no
records. An archive that ends inside a gzip member or a record is an error.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm._store import Store

LEAST_BYTES = 100
ARCHIVE_BYTES = 4 << 20
#: Repeated digests (40 bytes each) that are sent to all tasks.
MAX_BROADCAST_ROWS = 200_000
_DATE = "2000-01-01T00:00:00Z"
_UNSAFE = re.compile(rb"[^\x21-\x7e]")
INDEX = "array<struct<offset:long,length:long,record_id:string>>"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: bytes, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. refers_to: the response's id, of a revisit."""
    target = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url).decode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Payload-Length: {len(payload)}"]
        block = head
    else:
        block = head + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class RecordCutter:
    """Cuts a stream of WARC bytes, fed in pieces, into whole records. Pieces are joined only once there are as many bytes
    as the record at hand needs, or twice as many as were searched for its head, so the time is linear in the stream."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = self.needed = 0

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.parts.append(piece)
        self.size += len(piece)
        if self.size >= self.needed:
            yield from self._cut()

    def _cut(self) -> Iterator[bytes]:
        rest, at = b"".join(self.parts), 0
        self.needed = 0
        while (head := rest.find(b"\r\n\r\n", at)) >= 0:
            m = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", rest[at : head + 2])
            if not m:
                raise ValueError("a record without Content-Length")
            end = head + 8 + int(m[1])
            if end > len(rest):
                self.needed = end - at
                break
            yield rest[at:end]
            at = end
        self.parts = [rest[at:]]
        self.size = len(rest) - at
        self.needed = self.needed or 2 * self.size

    def end(self) -> Iterator[bytes]:
        """What the last pieces hold; an error if they end inside a record."""
        yield from self._cut()
        if b"".join(self.parts).strip():
            raise ValueError("the archive ends inside a record")


def inflate(archive: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in pieces of about step; an error if it ends inside a member."""
    at = 0
    while at < len(archive):
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            feed = unzip.unconsumed_tail
            if not feed:
                feed = archive[at : at + step]
                at += len(feed)
            if out := unzip.decompress(feed, step):
                yield out
            elif not feed:
                raise ValueError("the archive ends inside a gzip member")
        at -= len(unzip.unused_data)


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise(archive: bytes) -> tuple[bytes, list[dict]]:
    """The archive with a gzip member for each record, and the side index of the members."""
    cutter, members, index, offset = RecordCutter(), [], [], 0

    def records() -> Iterator[bytes]:
        for piece in inflate(archive):
            yield from cutter.feed(piece)
        yield from cutter.end()

    for rec in records():
        member = gzip_member(rec)
        name = re.search(rb"\r\nWARC-Record-ID: ([^\r]*)", rec[: rec.find(b"\r\n\r\n") + 2])
        index.append({"offset": offset, "length": len(member), "record_id": name[1].decode() if name else ""})
        members.append(member)
        offset += len(member)
    return b"".join(members), index


def _write(batches):
    """Rows (page_id, url, html, digest, refers_to) to archives that are one gzip stream each."""
    z, size, parts = None, 0, []
    for batch in batches:
        for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
            z = z or zlib.compressobj(1, zlib.DEFLATED, 31)
            data = record(page_id, url or b"", html or b"", digest, refers)
            parts.append(z.compress(data))
            size += len(data)
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, z.flush()])], pa.binary())], ["archive"])
                z, size, parts = None, 0, []
    if z:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join([*parts, z.flush()])], pa.binary())], ["archive"])


def _normalise(batches):
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]))
    for batch in batches:
        for archive in batch.column(0):
            data, index = normalise(archive.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([index], kind)], ["archive", "index"])


def parse(rec: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page id, payload bytes, digest, type, refers_to; a response's length and digest are taken from its payload."""
    head, _, block = rec.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])

    def page(urn: bytes) -> int | None:
        return None if urn == b"<urn:page:null>" else int(urn[10:-1])

    kind = fields[b"WARC-Type"].decode()
    if kind == "revisit":
        return page(fields[b"WARC-Record-ID"]), int(fields[b"WARC-Payload-Length"]), fields[b"WARC-Payload-Digest"][7:].decode(), kind, page(fields[b"WARC-Refers-To"])
    payload = block[block.index(b"\r\n\r\n") + 4 : -4]
    return page(fields[b"WARC-Record-ID"]), len(payload), hashlib.sha256(payload).hexdigest(), kind, None


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches):
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for archive, index in zip(batch.column(0), batch.column(1)):
            data = archive.as_py()
            rows = [parse(zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31)) for x in index.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(archive) rows, each one gzip stream. pages: page_id, url, html and any further columns.

    Copies are found on digests alone. Digests that repeat are counted first: up to max_broadcast_rows of them go to all
    tasks and no payload is moved; beyond that, a join deals payloads out by digest, and Spark splits its hot keys."""
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("binary"), F.col("html").cast("binary")).withColumn(
        "digest", F.sha2(F.coalesce("html", F.lit(b"")), 256)
    )
    twins = (
        src.where(F.octet_length("html") >= least_bytes)
        .groupBy(F.unhex("digest").alias("twin"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("twin", "first")
    )
    twins = Store(pages.sparkSession, "warc").put(twins, "twins")
    if twins.count() <= max_broadcast_rows:
        twins = F.broadcast(twins)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = src.join(twins, F.unhex("digest") == F.col("twin"), "left")
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(_write, "archive binary")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(archive, index) rows from (archive) rows of any gzip WARC files."""
    return archives.select("archive").mapInArrow(_normalise, f"archive binary, index {INDEX}")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record, found by the side index."""
    return archives.select("archive", "index").mapInArrow(_read, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to monolithic archives, normalised, stored in the shared folder and read back."""
    store = Store(pages.sparkSession, "warc")
    return read_archives(store.put(normalise_archives(write_archives(pages)), "archives"))
