"""WARC archives as a chunked record table.

An archive is the byte string of its rows in order of (position, chunk): gzip members, one
per WARC record. A row stands for at most ``CHUNK_BYTES`` of payload, however well they
compress, and carries the record's identifier, the chunk number and the SHA-1 of the payload
so far. So a record of any length is written and read piece by piece: neither side holds more
than one chunk of it beside the input row. The reader parses the decompressed stream:
headers to the blank line, then as many bytes as Content-Length says. It inflates at most a
chunk at once and holds every row against its number and its running digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fillsight.llm.common import text_buffer
from fillsight.session import materialize

CHUNK_BYTES = 64 * 1024
ARCHIVE_BYTES = 64 * 1024 * 1024  # an archive is closed when it has this many
# Smallest payload for which a later record may refer to an earlier one.
MIN_REVISIT_BYTES = 0
_FLUSH_BYTES, _FLUSH_ROWS = 2_000_000, 20_000
CHUNKS = "archive string, position bigint, record_id string, chunk int, data binary, sha1 string"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, sha1, refers_to: of equal payloads the largest page_id is kept whole.

    Rows that repeat this page_id are all kept whole; so are payloads of rows that all lack
    a page_id. A row without one refers to the largest of its equals.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(
        "page_id", "url", "html", F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("size")
    )
    last = (
        keyed.where(F.col("size") >= min_bytes).groupBy("sha1", "size")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").drop("n")
    )
    both = keyed.join(materialize(last), ["sha1", "size"], "left")
    return both.select(
        "page_id", "url", "html", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    )


def write_archives(planned: DataFrame) -> DataFrame:
    """The chunk table (see ``CHUNKS``) of the records of ``plan_records``, as one archive or more per task."""

    def run(batches):
        task = TaskContext.get().partitionId()
        roll = position = written = size = 0
        rows: list[tuple] = []

        def table():
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string())
            names = ("archive", "position", "record_id", "chunk", "data", "sha1")
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            flat, offsets = text_buffer(batch.column("html"))
            meta = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "refers_to")))
            for i, (page, url, sha1, refers_to) in enumerate(meta):
                archive = f"{task:06d}-{roll:04d}"
                record = f"<urn:page:{page}>" if page is not None else f"<urn:none:{archive}-{position}>"
                length = int(offsets[i + 1] - offsets[i])
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {length}\r\n\r\n".encode()
                head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record}"]
                if url is not None:
                    head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
                if refers_to is not None:
                    head += [
                        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        f"WARC-Refers-To: <urn:page:{refers_to}>",
                    ]
                block = len(http) + (length if refers_to is None else 0)
                head += [f"WARC-Payload-Digest: sha1:{_base32(sha1)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
                gz, digest = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1()
                data = gz.compress(("\r\n".join(head) + "\r\n\r\n").encode() + http)
                end = int(offsets[i + 1])
                chunk = 0
                for a in range(int(offsets[i]), end, CHUNK_BYTES) if refers_to is None else ():
                    part = memoryview(flat[a : min(a + CHUNK_BYTES, end)])
                    digest.update(part)
                    data += gz.compress(part)
                    if a + CHUNK_BYTES < end:
                        # the row ends where its chunk does, so the running digest can be held against it
                        data += gz.flush(zlib.Z_SYNC_FLUSH)
                        rows.append((archive, position, record, chunk, data, digest.hexdigest()))
                        size += len(data)
                        data, chunk = b"", chunk + 1
                    if size - written >= _FLUSH_BYTES or len(rows) >= _FLUSH_ROWS:
                        written = size
                        yield table()
                        rows = []
                data += gz.compress(b"\r\n\r\n") + gz.flush()
                rows.append((archive, position, record, chunk, data, digest.hexdigest()))
                size += len(data)
                position += 1
                if size >= ARCHIVE_BYTES:
                    roll, position, size, written = roll + 1, 0, 0, 0
            yield table()
            rows = []

    return planned.mapInArrow(run, CHUNKS)


class RecordReader:
    """Parses one archive from its bytes as they come; holds headers and counters only."""

    def __init__(self):
        self.gz = zlib.decompressobj(31)
        self.found: list[tuple] = []
        self.most = 0  # bytes inflated at once
        self.chunk = 0
        self._begin()

    def _begin(self):
        self.part, self.head, self.left, self.trailer = "warc", b"", 0, b""
        self.warc: dict[str, str] = {}
        self.http: dict[str, str] = {}
        self.size, self.digest = 0, hashlib.sha1()

    def feed(self, data: bytes) -> None:
        while data:
            plain = self.gz.decompress(data, CHUNK_BYTES)
            self.most = max(self.most, len(plain))
            self._parse(plain)
            data = self.gz.unconsumed_tail or self.gz.unused_data
            if self.gz.eof:
                self._close()
                self.gz = zlib.decompressobj(31)

    def feed_row(self, record: str, chunk: int, data: bytes, sha1: str) -> None:
        """One row of the table: the next chunk of its record, with the digest of the payload so far."""
        done = len(self.found)
        if chunk != self.chunk:
            raise ValueError(f"chunk {chunk} of {record} follows {self.chunk - 1}")
        try:
            self.feed(data)
        except zlib.error as damage:
            raise ValueError(f"chunk {chunk} of {record} is damaged") from damage
        if len(self.found) > done:
            self.chunk = 0  # the record is whole; its digest was held against its header
            return
        self.chunk += 1
        if self.digest.hexdigest() != sha1 or self.warc.get("warc-record-id") != record:
            raise ValueError(f"chunk {chunk} of {record} does not have its digest")

    @staticmethod
    def _fields(head: bytes) -> dict[str, str]:
        lines = head.decode().split("\r\n")
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def _parse(self, data: bytes) -> None:
        while data:
            if self.part in ("warc", "http"):
                seen = len(self.head)
                self.head += data
                end = self.head.find(b"\r\n\r\n", max(seen - 3, 0))
                if end < 0:
                    return
                data, head = self.head[end + 4 :], self.head[:end]
                self.head = b""
                if self.part == "warc":
                    self.warc, self.part = self._fields(head), "http"
                    self.left = int(self.warc["content-length"])
                else:
                    self.http, self.part = self._fields(head), "payload"
                    self.left -= end + 4
            elif self.left:
                take = data[: self.left]
                self.digest.update(take)
                self.size += len(take)
                self.left -= len(take)
                data = data[len(take) :]
            else:
                self.trailer += data
                return

    def _close(self) -> None:
        if self.part != "payload" or self.left or self.trailer != b"\r\n\r\n":
            raise ValueError(f"damaged record {self.warc.get('warc-record-id')}")
        named = self.warc["warc-payload-digest"].removeprefix("sha1:")
        response = self.warc["warc-type"] == "response"
        if response and (_base32(self.digest.hexdigest()) != named or self.size != int(self.http["content-length"])):
            raise ValueError(f"payload of {self.warc['warc-record-id']} does not have its digest")
        page, other = (_PAGE.fullmatch(self.warc.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
        size = int(self.http["content-length"])
        self.found.append((int(page[1]) if page else None, size, named, self.warc["warc-type"], int(other[1]) if other else None))
        self._begin()


def read_archives(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record.

    Rows are sorted within their archives by Spark (spilling where needed) and streamed, about
    one archive a task. A record that is cut short, a row that is missing, and a payload that
    does not have its digest are errors.
    """

    def run(batches):
        archive, reader = None, None
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def closed():
            if reader is not None and (reader.head or reader.chunk):
                raise ValueError(f"archive {archive} ends within a record")

        for batch in batches:
            out = []
            columns = ("archive", "record_id", "chunk", "sha1")
            for name, record, chunk, sha1, data in zip(*(batch.column(c).to_pylist() for c in columns), batch.column("data")):
                if name != archive:
                    closed()
                    archive, reader = name, RecordReader()
                reader.feed_row(record, chunk, data.as_buffer(), sha1)
                out += reader.found
                reader.found = []
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
        closed()

    archives = max(1, chunks.select("archive").distinct().count())
    ordered = chunks.repartitionByRange(archives, "archive").sortWithinPartitions("archive", "position", "chunk")
    return ordered.select("archive", "record_id", "chunk", "sha1", "data").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write one record per row of ``pages``, read the archives back and list the records.

    NULL html is an empty payload, a NULL url leaves out its header, a NULL page_id comes
    back as NULL. Other columns are not read.
    """
    return read_archives(materialize(write_archives(plan_records(pages))))
