"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Archives are real files in the shared folder. A task writes its own archives under names nobody
else uses and reports them; only reported archives of tasks that ended count, so a task that is
run again leaves at most an unread file behind. Readers inflate piece by piece and frame records by
their content length, holding one record's payload at most.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import plain_columns, shuffle_partitions
from tonearm.session import shared_folder, written

# Payloads shorter than this are always stored.
LEAST_SHARED = 100
# Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_CHUNK = 256 << 10
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
# An id that refers to a page of the table; a row without an id has the empty one.
_NAME = re.compile(r"<urn:page:(-?\d*)>")


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes | None,
           digest: str, length: int, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record, uncompressed. Blanks and control characters of the address are percent-encoded."""
    head = _HTTP + f"Content-Length: {length}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
              ("WARC-Date", date)]
    if url is not None:
        plain = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        fields.append(("WARC-Target-URI", plain))
    if kind == "revisit":
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                   ("X-Payload-Length", str(length))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"),
               ("WARC-Block-Digest", f"sha256:{_digest(block)}"),
               ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """The bytes as one gzip member, without a time stamp."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class Framing(ValueError):
    """An archive that ends early or whose members and lengths disagree."""


class _Members:
    """Sequential reading of gzip members through a bounded buffer."""

    def __init__(self, raw):
        self.raw, self.ahead, self.buffer, self.used = raw, b"", b"", 0

    def begin(self) -> bool:
        """Go to the next member; False at the end of the file."""
        self.ahead = self.ahead or self.raw.read(_CHUNK)
        self.inflate, self.buffer = zlib.decompressobj(31), b""
        return bool(self.ahead)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        self.ahead = self.ahead or self.raw.read(_CHUNK)
        if not self.ahead:
            raise Framing("the archive ends within a member")
        try:
            self.buffer += self.inflate.decompress(self.ahead, _CHUNK)
        except zlib.error as error:
            raise Framing(f"not a gzip member: {error}") from error
        self.ahead = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                raise Framing("a header ends early")
        line, self.buffer = self.buffer[:end], self.buffer[end + 2:]
        return line

    def parts(self, size: int) -> Iterator[bytes]:
        """Exactly ``size`` bytes, piece by piece."""
        while size:
            if not self.buffer and not self._more():
                raise Framing("a block is shorter than its content length")
            piece, self.buffer = self.buffer[:size], self.buffer[size:]
            size -= len(piece)
            if piece:
                yield piece

    def end(self) -> None:
        """Two line ends and then the end of the member."""
        while self._more():
            pass
        if self.buffer != b"\r\n\r\n":
            raise Framing("a record does not end with its member")


def records(raw) -> Iterator[dict]:
    """Records of one archive: headers, payload of responses, and whether all digests hold."""
    source = _Members(raw)
    while source.begin():
        if source.line() != b"WARC/1.1":
            raise Framing("a member does not begin with a WARC version")
        fields = {}
        while line := source.line():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        whole, body, pieces, head = hashlib.sha256(), hashlib.sha256(), [], b""
        in_head = True
        for piece in source.parts(int(fields["content-length"])):
            whole.update(piece)
            if in_head:  # the HTTP header comes before the payload
                head += piece
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                in_head, piece = False, head[at + 4:]
            body.update(piece)
            pieces.append(piece)
        source.end()
        good = fields["warc-block-digest"] == f"sha256:{whole.hexdigest()}"
        if fields["warc-type"] == "response":
            good = good and fields["warc-payload-digest"] == f"sha256:{body.hexdigest()}"
        yield {"fields": fields, "payload": b"".join(pieces), "verified": good}


def _page(name: str | None) -> int | None:
    found = _NAME.fullmatch(name or "")
    return int(found[1]) if found and found[1] else None


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row; ``archive, records, bytes`` of each archive, stored.

    Null html is an empty payload. Among rows with equal payloads of at least ``LEAST_SHARED``
    bytes the one of smallest id is a response and the others revisit it; rows that repeat that id
    are responses too, and so are rows without an id. ``folder`` must be seen by all executors.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = plain_columns(pages, page_id=page_id, url=url, html=html).withColumn(
        "digest", F.unhex(F.sha2(payload, 256)))
    # payloads that occur again; summed up in every task first, and without the texts
    least = (
        pages.where(F.octet_length(payload) >= LEAST_SHARED).groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "refers_to"))
    again = written(
        pages.where(F.octet_length(payload) >= LEAST_SHARED).select("page_id", "digest")
        .join(written(least, "repeated"), "digest").where("page_id <> refers_to").distinct(),
        "revisits")
    # joined by id as well: a payload's many copies are not one key
    roles = pages.join(again, ["page_id", "digest"], "left")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                key, address, text, digest, refers = (x.as_py() for x in row)
                data = (text or "").encode()
                kind = "response" if refers is None else "revisit"
                if out is None:
                    name = f"{root}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(name, compression=None), 0, 0
                own = member(record(kind, key, address, data, digest.hex(), len(data), refers))
                out.write(own)
                count, size = count + 1, size + len(own)
                if size >= archive_bytes:
                    out.close()
                    out = done.append((name, count, size))
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))],
                names=["archive", "records", "bytes"])

    return written(roles.mapInArrow(run, "archive string, records bigint, bytes bigint"), "archives")


def read_archives(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives, each read by one task from beginning to end.

    ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, verified`` and, if asked,
    ``payload`` (null for revisits, whose length and digest are those of the full payload they stand
    for). ``verified`` says whether all digests of a record hold; broken framing is an error.
    """
    spark = archives.sparkSession
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(),
             "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(),
             "verified": pa.bool_(), "payload": pa.binary()}
    if not payload:
        kinds.pop("payload")

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)

        def send(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in kinds.items()], names=list(kinds))

        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(archive, compression=None) as raw:
                    for found in records(raw):
                        fields, data = found["fields"], found["payload"]
                        response = fields["warc-type"] == "response"
                        rows.append({
                            "page_id": _page(fields["warc-record-id"]),
                            "url": fields.get("warc-target-uri"),
                            "record_type": fields["warc-type"],
                            "payload_bytes": len(data) if response else int(fields["x-payload-length"]),
                            "payload_digest": _digest(data) if response else
                            fields["warc-payload-digest"].removeprefix("sha256:"),
                            "refers_to": _page(fields.get("warc-refers-to")),
                            "verified": found["verified"],
                            "payload": data if payload and response else None})
                        held += len(data) if payload else 100
                        if held >= 4 << 20:
                            yield send(rows)
                            rows, held = [], 0
                if rows:
                    yield send(rows)

    schema = ("page_id bigint, url string, record_type string, payload_bytes bigint, "
              "payload_digest string, refers_to bigint, verified boolean")
    parts = max(1, shuffle_partitions(spark))
    return (archives.select("archive").repartition(parts, "archive")
            .mapInArrow(run, schema + (", payload binary" if payload else "")))


def archive_folder(pages: DataFrame) -> str:
    """A fresh folder for archives where every executor can read them."""
    return shared_folder(pages.sparkSession, "warc")
