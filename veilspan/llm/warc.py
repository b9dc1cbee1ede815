"""WARC archives: a writer, and a sequential reader.

An archive is a run of records, each one gzip member. The reader walks an archive
once: it feeds the inflater small pieces, starts a new inflater where a member ends,
frames the block by Content-Length and takes the payload's digest piece by piece. Of a
record it holds two pieces or so, and the payload only where it is asked for.

Archives are rows (name, content) of a table that Spark writes to the shared folder,
so any store that Spark reads will do and a lost executor costs its tasks only.
``read_archives`` takes Spark's ``binaryFile`` source as well, for .warc.gz files of
other makers; a row is an archive, so these have to stay below the 2 GB of a binary
column, and a worker holds the compressed bytes of one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, slices, wrote

#: Bytes after which a task begins the next archive.
ARCHIVE_BYTES = 4 << 20
#: Payloads below this are never revisits.
REVISIT_BYTES = 1000
LEVEL = 4
#: Winners of repeated payloads are broadcast up to this many rows (about 60 bytes
#: each), else joined by a shuffle.
BROADCAST_ROWS = 50_000
_PIECE = 1 << 16
#: What has a longer header is no record.
HEADER_BYTES = 1 << 20
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    length: int
    digest: str
    payload: bytes | None


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(record_id: str | None) -> int | None:
    tail = (record_id or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int = LEVEL) -> bytes:
    """One record as one gzip member: a response, or a revisit without payload."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": _REVISIT_PROFILE, "WARC-Refers-To": _id(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


class _Member:
    """What one gzip member inflates to, as a stream of which at most about two pieces
    are held. ``at`` is where the next member begins once this one has been read."""

    def __init__(self, content: bytes, at: int):
        self.content, self.at, self.z, self.held = content, at, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate some more; False at the end of the member."""
        while not self.z.eof:
            left = self.z.unconsumed_tail
            if not left:
                left = self.content[self.at : self.at + _PIECE]
                self.at += len(left)
            out = self.z.decompress(left, _PIECE)
            if self.z.eof:
                self.at -= len(self.z.unused_data)
            elif not left and not out:
                raise ValueError("an archive ends within a member")
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes, limit: int) -> bytes | None:
        """What comes before ``mark``, which is taken as well; None if it doesn't come
        within ``limit`` bytes, which stay."""
        while True:
            end = self.held.find(mark)
            if end >= 0:
                out, self.held = self.held[:end], self.held[end + len(mark) :]
                return out
            if len(self.held) > limit or not self.more():
                return None

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces; fewer if the member ends."""
        while n > 0 and (self.held or self.more()):
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def records(content: bytes, payload: bool = False) -> Iterator[Record]:
    """The records of an archive, one after the other. A block is read in pieces, of
    which digest and length are taken; the payload is only held where it is asked for."""
    at = 0
    while at < len(content):
        m = _Member(content, at)
        head = m.until(b"\r\n\r\n", HEADER_BYTES)
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError("a member is no WARC record")
        lines = head.decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers.get("content-length", "-1"))
        if size < 0:
            raise ValueError("a record has no length")
        # the payload of an HTTP block is what follows its header
        read, http, inside, digest, length, kept = 0, b"", False, hashlib.sha1(), 0, []
        for piece in m.take(size):
            read += len(piece)
            if not inside:
                http += piece
                end = http.find(b"\r\n\r\n")
                if end < 0:
                    http = http[-3:]  # a mark may begin there
                    continue
                inside, piece = True, http[end + 4 :]
            digest.update(piece)
            length += len(piece)
            if payload:
                kept.append(piece)
        if read != size or m.until(b"\r\n\r\n", 4) != b"" or m.held or m.more():
            raise ValueError("a record's block has not the length of its header")
        yield Record(headers, length, digest.hexdigest(), b"".join(kept) if payload else None)
        at = m.at


def _declared(headers: dict[str, str]) -> str | None:
    name, _, value = headers.get("warc-payload-digest", "").partition(":")
    if name.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
    except ValueError:
        return None


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, payload binary"


def read_archives(archives: DataFrame, content_col: str = "content", payload: bool = False) -> DataFrame:
    """A row for each response and revisit record of the archives in ``content_col``.

    verified: the payload of a response has its declared digest; of a revisit, which has
    no payload here, that it declares one (``check_revisits`` looks at the response that
    it refers to). A broken member, block length or record raises an error rather than
    losing records. ``payload`` adds the bytes. Null or empty contents have no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda rows: pa.RecordBatch.from_pylist([dict(zip(_READ.names, r)) for r in rows], _READ)
        for batch in slices(batches, "content", rows=1):
            rows, size = [], 0
            for content in batch.column(0):
                for r in records(content.as_py() or b"", payload):
                    kind, told = r.headers.get("warc-type"), _declared(r.headers)
                    if kind == "response":
                        found = (r.length, r.digest, told is None or told == r.digest, r.payload)
                    elif kind == "revisit":
                        length = r.headers.get("x-payload-length", "")
                        found = (int(length) if length.isdigit() else None, told, told is not None, None)
                    else:
                        continue
                    rows.append((_page(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), kind, _page(r.headers.get("warc-refers-to")), *found))
                    size += len(r.payload or b"")
                    if len(rows) >= 1024 or size >= 16 * _PIECE:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)

    return archives.select(archives[content_col].alias("content")).mapInArrow(run, READ)


def check_revisits(found: DataFrame) -> DataFrame:
    """The rows of ``read_archives``, where a revisit is verified when the response that
    it refers to was read, has been verified and has its digest and length. Only ids and
    digests meet, and revisits of one response count as one there."""
    found = materialize(found, "warc-read")
    keys = ["refers_to", "payload_digest", "payload_bytes"]
    told = found.where("record_type = 'revisit' AND verified").groupBy(*keys).agg(F.count(F.lit(1)).alias("revisits"))
    there = found.where("record_type = 'response' AND verified").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
    good = told.join(there, keys, "left_semi").select(*keys, F.lit(True).alias("met"))
    met = (F.col("record_type") == "response") & F.col("verified") | F.coalesce("met", F.lit(False))
    return found.join(good, keys, "left").withColumn("verified", met).select(*found.columns)


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("payload", pa.binary()),
])


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(id, url, html, digest, winner): winner is the largest id among the pages with
    the same payload of ``least`` bytes or more, where there are several; else null."""
    rows = pages.select(
        pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    several = materialize(
        rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "winner"),
        "warc-winners",
    )
    small = several.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(several) if small else several.hint("shuffle_hash"), "digest", "left").select("id", "url", "html", "digest", "winner")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """The archives of pages as rows (name, content), lazily.

    One record per row: of equal payloads of ``least`` bytes or more the largest id
    is a response, the rest are revisits of it; smaller payloads are all responses.
    A null html is an empty payload, a null url an empty one, a null id is written as
    none; rows that repeat the winning id are responses too. An empty table has no
    archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{k:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["name", "content"])

        for batch in slices(batches, "html"):
            for page_id, url, html, digest, winner in zip(*(c.to_pylist() for c in batch.columns)):
                refers = winner if winner is not None and winner != page_id else None
                held.append(write_record(page_id, url, html.encode(), digest, refers, date, level))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    k, held, size = k + 1, [], 0
        if held:
            yield out()

    return with_revisits(pages, id_col, url_col, html_col, least).mapInArrow(run, "name string, content binary")


def save_archives(archives: DataFrame, tag: str = "warc") -> DataFrame:
    """Write the archives as a table in the shared folder, uncompressed as they are
    compressed already, and read it again."""
    import uuid

    spark = archives.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    archives.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)
    wrote(path)
    return spark.read.schema(archives.schema).parquet(path)
