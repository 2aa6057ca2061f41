"""WARC archives: writing them in tasks, and a sequential reader.

Every record is a gzip member of its own. The reader takes one member after the
other from a stream, inflates it piece by piece, finds the block's end by
Content-Length and checks the block's and the payload's digests. Nothing larger
than a record's payload is held.

A page's record is a ``response`` with an HTTP message whose body is the
payload. Records with equal payloads of ``min_bytes`` or more refer to the one
of the smallest id: they are ``revisit`` records of the profile
identical-payload-digest and hold the HTTP header alone.

Archives of others are read as well: digests are verified where a record has them
and their algorithm is known, in base32 or hexadecimal; a body in chunks may have
the digest of either form; a truncated record isn't held against its HTTP length.
Of ``resource``, ``metadata`` and other records without an HTTP message the whole
block is the payload. What a record doesn't state is null.

Defined results: a null payload is an empty one; a null url has no target URI;
control characters and blanks in a url are percent-encoded; rows that repeat the
smallest id are responses all; rows without an id refer to the smallest id of
their payload if there is one, and are responses otherwise; other columns are
left alone, whatever their names; an empty table gives no records. A payload of
any length is held whole by the task that writes or reads it, and nothing else is.
A record's id names its page, so responses of a repeated page id share it; revisits
and pages without an id, to which nothing refers, have the place of writing in it.
A task that runs again writes the same file under the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, shared_folder, stored

CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"  # a fixed capture date, so that a rewritten file is the same


class Record(NamedTuple):
    """``http``: the fields of the HTTP header, none where the block isn't an HTTP
    message. ``payload`` is None in a revisit."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes | None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page: int | None, url: str | None, payload: bytes, label: str, refers_to: int | None, place: str = "0") -> bytes:
    """A whole record, compressed as one gzip member."""
    own = f"{'' if page is None else page}{'' if page is not None and refers_to is None else ':' + place}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{own}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode()).encode("latin-1").decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{label}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class Inflated:
    """The bytes of one gzip member after the other of a stream."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.raw, self.data, self.member = stream, b"", bytearray(), None

    def more(self) -> bool:
        """Inflate another piece of this member into ``data``; False at its end."""
        if self.member is None or self.member.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                raise ValueError("the archive ends within a record")
        self.data += self.member.decompress(self.raw, CHUNK)
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def next_member(self) -> bool:
        self.raw = self.raw or self.stream.read(CHUNK)
        self.member, self.data = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.data.find(mark, seen)) < 0:
            seen = max(0, len(self.data) - len(mark))
            if not self.more():
                raise ValueError("a record without the end of its header")
        out = bytes(self.data[:at])
        del self.data[: at + len(mark)]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data and not self.more():
                raise ValueError("a record shorter than its Content-Length")
            piece = bytes(self.data[:n])
            del self.data[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece


def _fields(lines: list[str]) -> dict[str, str]:
    """Names in lower case; a line that starts with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _hasher(label: str | None):
    """What computes a digest like ``sha1:...``; None without one or where its algorithm isn't known."""
    name = (label or "").partition(":")[0].lower().replace("-", "")
    return hashlib.new(name) if name in ("md5", "sha1", "sha256", "sha384", "sha512") else None


def _agrees(label: str, hasher) -> bool:
    value = label.partition(":")[2].strip()
    return value.upper().rstrip("=") == base64.b32encode(hasher.digest()).decode().rstrip("=") or value.lower() == hasher.hexdigest()


def _payload_agrees(label: str, payload: bytes) -> bool:
    hasher = _hasher(label)
    if hasher is None:
        return True
    hasher.update(payload)
    return _agrees(label, hasher)


def _without_chunks(body: bytes) -> bytes | None:
    """A body of the chunked transfer coding as one piece; None if it isn't one."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return None


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive, in order; raises ValueError where one is broken."""
    source = Inflated(stream)
    while source.next_member():
        version, *lines = source.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = _fields(lines)
        name, stated = headers.get("warc-record-id"), headers.get("warc-block-digest")
        if not headers.get("content-length", "").isdecimal():
            raise ValueError(f"no Content-Length in {name}")
        whole, block = _hasher(stated), bytearray()
        for piece in source.exactly(int(headers["content-length"])):
            if whole:
                whole.update(piece)
            block += piece
        while source.more():
            pass
        if source.data != b"\r\n\r\n":
            raise ValueError("a record longer than its Content-Length")
        if whole and not _agrees(stated, whole):
            raise ValueError(f"block digest of {name}")
        http, at = {}, 0
        if headers.get("content-type", "").lower().startswith("application/http"):
            end = block.find(b"\r\n\r\n")
            at = end + 4 if end >= 0 else len(block)
            http = _fields(block[: at - 4 if end >= 0 else at].decode("latin-1").split("\r\n")[1:])
        if headers.get("warc-type") == "revisit":
            yield Record(headers, http, None)
            continue
        payload = bytes(memoryview(block)[at:])
        length, chunked = http.get("content-length", ""), "chunked" in http.get("transfer-encoding", "").lower()
        if "warc-truncated" not in headers and not chunked and headers.get("warc-type") == "response" and length.isdecimal() and len(payload) != int(length):
            raise ValueError(f"payload length of {name}")
        if label := headers.get("warc-payload-digest"):
            joined = _without_chunks(payload) if chunked else None
            if not _payload_agrees(label, payload) and (joined is None or not _payload_agrees(label, joined)):
                raise ValueError(f"payload of {name}")
        yield Record(headers, http, payload)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, file_bytes: int = 256 << 20, hot_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per row below ``folder``; returns ``(path, records, bytes)``.

    Payload digests, few bytes a row, are grouped first; the pages then meet the
    ids that they refer to. A payload that many pages share is one pre-aggregated
    row, and its pages are never gathered: digests whose pages have over
    ``hot_bytes`` together, fewer than all bytes over ``hot_bytes``, are broadcast,
    and their pages are dealt by page and url in the join that serves the others.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page"), pages[url_col].alias("url"), F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload")
    )
    keyed = rows.select("page", F.sha1("payload").alias("digest"), F.length("payload").alias("size"))
    shared = keyed.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = stored(shared, "warc-shared").withColumn("hot", F.col("n") * (F.col("size") + 256) > hot_bytes)
    hot = shared.where("hot").select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    key = F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.xxhash64("page", "url").cast("string"))
    cold = shared.where("not hot").select(F.col("digest").alias("key"), F.col("first").alias("cold_first"))
    rows = rows.withColumn("key", key).join(cold, "key", "left").withColumn("first", F.coalesce("hot_first", "cold_first"))
    refers = F.when((F.length("payload") >= min_bytes) & F.coalesce(F.col("page") > F.col("first"), F.col("page").isNull()), F.col("first"))
    rows = rows.select("page", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        part, number, written = TaskContext.get().partitionId(), 0, 0
        attempt = TaskContext.get().taskAttemptId()
        out, done = None, []

        def close() -> None:
            """A file gets its name when it is whole."""
            nonlocal out, number
            stream, name, records, size = out
            stream.close()
            final = f"part-{part:05d}-{number:05d}.warc.gz"
            system.move(name, f"{inner}/{final}")
            done.append((f"{folder}/{final}", records, size))
            out, number = None, number + 1

        for batch in batches:
            for page, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name = f"{inner}/_part-{part:05d}-{number:05d}-{attempt}"
                    out = (system.open_output_stream(name, compression=None), name, 0, 0)
                data = record_bytes(page, url, payload, digest(payload), refers_to, f"{part}-{written}")
                written += 1
                out[0].write(data)
                out = (out[0], out[1], out[2] + 1, out[3] + len(data))
                if out[3] >= file_bytes:
                    close()
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


def read(files: DataFrame, payloads: bool = False, keep: int = 1000) -> DataFrame:
    """Records of the archives in the column ``path``: ``page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, record_id, refers_to_id``
    and, if asked for, ``payload``. ``page_id`` and ``refers_to`` are null for
    records whose ids ``write`` hasn't made. A digest that isn't stated is computed.
    Each file is a task's; ``keep`` records make a batch."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "record_id", "refers_to_id", *["payload"] * payloads]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * payloads]

    def number(uri: str | None) -> int | None:
        found = re.match(r"<urn:page:(-?\d+)[:>]", uri or "")
        return int(found[1]) if found else None

    def described(r: Record) -> tuple:
        h, length = r.headers, r.http.get("content-length", "")
        size = len(r.payload) if r.payload is not None else int(length) if length.isdecimal() else None
        label = h.get("warc-payload-digest")
        if label is None and r.payload is not None:
            label = digest(r.payload)
        own, other = h.get("warc-record-id"), h.get("warc-refers-to")
        return number(own), h.get("warc-target-uri"), h.get("warc-type"), number(other), size, label and label.removeprefix("sha1:"), own, other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for path in (p for b in batches for p in b.column(0).to_pylist()):
            system, inner = file_system(path)
            rows, held = [], 0
            with system.open_input_stream(inner, compression=None) as stream:
                for r in read_records(stream):
                    rows.append(described(r) + ((r.payload,) if payloads else ()))
                    held += len(r.payload or b"") if payloads else 0
                    if len(rows) >= keep or held > 16 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    kind = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, refers_to_id string" + ", payload binary" * payloads
    paths = files.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, kind)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder, and read the archives back."""
    return read(write(pages, shared_folder(spark, "warc")))
