"""WARC archives as chunked record tables.

On the way out and back a payload is a run of rows (record, chunk number, chunk, length and digest of
the payload so far): the last one's digest is the payload's. Going out, chunks are views of the row that
a payload came in, never a copy of it; coming back, no more than a chunk is held. Payloads stored once
already are written as revisit records that refer to the response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AT, Scratch, file_system, partitions, place, rooted, task_stamp

LEAST_REVISIT = 1000
CHUNK_BYTES = 262_144
READ_BYTES = 1 << 20
FILE_BYTES = 1 << 30
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page"

CHUNK = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()),
    ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])
CHUNK_DDL = "record_id string, record_type string, page_id long, uri string, refers_to long, chunk_no long, chunk binary, bytes_so_far long, sha1_so_far string, last boolean, payload_bytes long, payload_digest string"


OUT = pa.schema([
    ("_at", pa.struct([("file", pa.int64()), ("row", pa.int64())])), ("page_id", pa.int64()), ("url", pa.string()), ("again", pa.bool_()), ("to_page", pa.int64()), ("to_at", pa.struct([("file", pa.int64()), ("row", pa.int64())])),
    ("size", pa.int64()), ("sha1", pa.string()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()),
])
OUT_DDL = f"_at {AT}, page_id long, url string, again boolean, to_page long, to_at {AT}, size long, sha1 string, chunk_no long, chunk binary, bytes_so_far long, sha1_so_far string, last boolean"


def _view(text) -> memoryview:
    """The bytes of a string in an Arrow column, where they are."""
    return memoryview(text.as_buffer() if text.is_valid else b"")


def _cut(payload: memoryview) -> Iterator[memoryview]:
    """Views of a payload's chunks; an empty one has an empty chunk."""
    for a in range(0, max(1, len(payload)), CHUNK_BYTES):
        yield payload[a : a + CHUNK_BYTES]


def _digest(payload: memoryview, *kinds) -> list[str]:
    """Digests, chunk by chunk."""
    sums = [k() for k in kinds]
    for chunk in _cut(payload):
        for x in sums:
            x.update(chunk)
    return [x.hexdigest() for x in sums]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        views = [_view(x) for x in b.column("html")]
        digests = [_digest(v, hashlib.sha1, hashlib.sha256) for v in views]
        columns = [pa.array([len(v) for v in views], pa.int64()), *(pa.array([d[k] for d in digests], pa.string()) for k in range(2))]
        yield pa.record_batch([b.column("_at"), b.column("page_id"), *columns], names=["_at", "page_id", "size", "sha1", "sha2"])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages to rows of chunks. A revisit has size and digest already and one empty chunk."""
    names = ["_at", "page_id", "url", "again", "to_page", "to_at", "size", "sha1"]
    for b in batches:
        rows, held = [], 0
        for row, html in zip(b.select(names).to_pylist(), b.column("html")):
            payload = _view(html)
            if not row["again"]:
                row |= {"size": len(payload), "sha1": _digest(payload, hashlib.sha1)[0]}
            sha, total = hashlib.sha1(), 0
            about = tuple(row[k] for k in names)
            for no, chunk in enumerate(_cut(payload)):
                sha.update(chunk)
                total += len(chunk)
                rows.append((*about, no, chunk, total, sha.hexdigest(), total == len(payload)))
                held += 300 + len(chunk)
                if held >= BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), OUT)], schema=OUT)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), OUT)], schema=OUT)


def records(pages: DataFrame, scratch: Scratch, least: int = LEAST_REVISIT) -> DataFrame:
    """Chunk rows of pages (OUT), with the decision which record holds each payload.

    pages has page_id, url and html. Of rows with equal payloads of at least least bytes, that with the
    largest page_id (null: smallest; of repeated rows one) is the response.
    """
    pages = rooted(scratch, pages)
    base = pages.select(place(pages).alias("_at"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keys = scratch.table(base.select("_at", "page_id", "html").mapInArrow(_keys, f"_at {AT}, page_id long, size long, sha1 string, sha2 string"), "keys")
    same = ["size", "sha1", "sha2"]
    held = keys.filter(F.col("size") >= least).groupBy(*same).agg(F.max(F.struct("page_id", "_at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = scratch.table(held, "shared")  # stored, so that the join can split a payload of very many pages
    again = keys.join(held, same).filter("_at != first._at")
    revisits = scratch.table(again.select("_at", F.lit(True).alias("again"), F.col("first.page_id").alias("to_page"), F.col("first._at").alias("to_at"), "size", "sha1"), "revisits")
    rows = base.join(revisits, "_at", "left").withColumns({"again": F.coalesce("again", F.lit(False)), "html": F.when(F.col("again").isNull(), F.col("html"))})
    return rows.mapInArrow(_chunked, OUT_DDL)


def _urn(page_id, at: dict) -> str:
    return f"<{URN}:{'' if page_id is None else page_id}:{at['file'] % (1 << 64):016x}{at['row'] % (1 << 64):016x}>"


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{URN}:(-?\d*):[0-9a-f]{{32}}>", urn or "")
    return int(m[1]) if m and m[1] else None


def _head(row: dict) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), row["url"] or "urn:x-none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if row['again'] else 'response'}",
        f"WARC-Record-ID: {_urn(row['page_id'], row['_at'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode(),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if row['again'] else row['size'])}",
    ]
    if row["again"]:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(row['to_page'], row['to_at'])}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _writer(folder: str, file_bytes: int, level: int):
    """Appends records, each a gzip member of its own; yields the names of whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        stamp, k, out, member, name, size = task_stamp(), 0, None, None, None, 0

        def named() -> pa.RecordBatch:
            return pa.record_batch([pa.array([name]), pa.array([size], pa.int64())], names=["file", "bytes"])

        def end_record() -> None:
            nonlocal member, size
            if member:
                size += out.write(member.compress(b"\r\n\r\n") + member.flush())
                member = None

        for b in batches:
            meta = b.drop_columns(["chunk"]).to_pylist()
            for row, chunk in zip(meta, b.column("chunk")):
                if row["chunk_no"] == 0:
                    end_record()
                    if out and size >= file_bytes:
                        out.close()
                        yield named()
                        out = None
                    if not out:
                        name, size, k = f"part-{stamp}-{k:04d}.warc.gz", 0, k + 1
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    size += out.write(member.compress(_head(row)))
                size += out.write(member.compress(memoryview(chunk.as_buffer())))
                if row["last"] and not row["again"] and (row["sha1_so_far"], row["bytes_so_far"]) != (row["sha1"], row["size"]):
                    raise ValueError(f"chunks of {row['page_id']} differ from the digest in its head")
        if out:
            end_record()
            out.close()
            yield named()

    return run


def write_archives(pages: DataFrame, folder: str, scratch: Scratch | None = None, file_bytes: int = FILE_BYTES, level: int = 3) -> DataFrame:
    """Write one record per row into gzipped archives in a shared folder; file and bytes of each archive.

    Attempts of a task write files of their own, and only those of the attempt that ended count.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    return scratch.table(records(pages, scratch).mapInArrow(_writer(folder, file_bytes, level), "file string, bytes long"), "archives")


class _Reader:
    """Bytes of an archive in order, gzipped by record or plain, a buffer at a time."""

    def __init__(self, source):
        self.source, self.buffer, self.unzip, self.raw, self.ended = source, b"", None, b"", False
        self.raw = source.read(READ_BYTES)
        self.zipped = self.raw[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        if not self.zipped:
            got, self.raw = self.raw or self.source.read(READ_BYTES), b""
            self.buffer += got
            return bool(got)
        while True:
            if not self.raw:
                self.raw = self.source.read(READ_BYTES)
            if not self.raw and not (self.unzip and self.unzip.unconsumed_tail):
                return False
            self.unzip = self.unzip or zlib.decompressobj(31)
            got = self.unzip.decompress(self.raw, READ_BYTES)
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if self.unzip.eof:
                self.unzip = None
            if got:
                self.buffer += got
                return True

    def line(self) -> bytes:
        while b"\n" not in self.buffer:
            if not self._more():
                got, self.buffer = self.buffer, b""
                return got
        got, _, self.buffer = self.buffer.partition(b"\n")
        return got + b"\n"

    def upto(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        got, self.buffer = self.buffer[:n], self.buffer[n:]
        return got

    def fields(self) -> dict[str, str]:
        found = {}
        while (line := self.line().strip()) != b"":
            k, _, v = line.decode("utf-8", "replace").partition(":")
            found[k.strip().lower()] = v.strip()
        return found


def _parsed(reader: _Reader, chunk_bytes: int, with_bytes: bool) -> Iterator[tuple]:
    while line := reader.line():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a record: {line[:80]!r}")
            continue
        f = reader.fields()
        left, kind = int(f["content-length"]), f.get("warc-type")
        said = f.get("warc-payload-digest", "").removeprefix("sha1:")
        said = base64.b32decode(said).hex() if said else None
        length = None
        if "msgtype=response" in f.get("content-type", ""):
            while left:
                line = reader.line()
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    length = int(line.split(b":")[1])
                if not line.strip():
                    break
        length = left if length is None or kind != "revisit" else length
        sha, total, no = hashlib.sha1(), 0, 0
        about = (f.get("warc-record-id"), kind, _page(f.get("warc-record-id")), f.get("warc-target-uri"), _page(f.get("warc-refers-to")))
        while True:
            chunk = reader.upto(min(left, chunk_bytes))
            if len(chunk) < min(left, chunk_bytes):
                raise ValueError(f"cut off: {about[0]}")
            left -= len(chunk)
            total += len(chunk)
            sha.update(chunk)
            if not left and kind == "response" and said and sha.hexdigest() != said:
                raise ValueError(f"digest differs: {about[0]}")
            yield (*about, no, chunk if with_bytes else None, total, sha.hexdigest(), not left, length, sha.hexdigest() if kind == "response" else said)
            no += 1
            if not left:
                break


def _reads(folder: str, chunk_bytes: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for b in batches:
            for name in b.column("file").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for row in _parsed(_Reader(source), chunk_bytes, with_bytes):
                        rows.append(row)
                        held += 200 + len(row[6] or b"")
                        if held > 8 << 20:
                            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), CHUNK)], schema=CHUNK)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), CHUNK)], schema=CHUNK)

    return run


def read_archives(archives: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_bytes: bool = True) -> DataFrame:
    """The chunk table of archives (column file): one row per record and chunk, in order within a record.

    payload_bytes and payload_digest are those of the full payload; a revisit has one chunk, empty.
    A response whose digest differs from its header, or a record cut off, raises an error.
    """
    n = partitions(archives.sparkSession)
    return archives.select("file").repartition(n).mapInArrow(_reads(folder, chunk_bytes, with_bytes), CHUNK_DDL)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages' archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, null url a placeholder; columns beyond page_id, url and html are
    ignored; every row, repeated ones too, has a record; an empty table has none.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.root}/archives-data"
    archives = write_archives(pages, folder, scratch)
    return read_archives(archives, folder, with_bytes=False).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
