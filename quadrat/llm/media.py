"""Media columns: payloads kept as deduplicated, content-defined chunks.

A payload is stored as a mono 8-bit WAV. Its bytes are cut where a rolling gear hash hits a mask, so equal
stretches give equal chunks wherever they stand. Each task appends chunks that it hasn't met to a
pack file in the shared folder; the media table keeps the ordered list of chunk digests. A Spark join
of the lists with the chunk table settles on one place for each digest, over all packs; packs with
much that no list points to are rewritten. Reading follows the lists through the packs, checks
every digest, and gives back payloads; only digests and places are shuffled, never bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, file_system, partitions, row_ids, spread_join, task_stamp

UNIT = 64
RATE = 8000
LEAST, USUAL, MOST = 1024, 4096, 16384
GEAR_WINDOW = 32
SLAB = 1 << 20
PACK_BYTES = 256 << 20
#: Bytes of media that a task rebuilds, about.
TASK_BYTES = 32 << 20
#: Digests that a task remembers, and the share of a pack without use at which it is rewritten.
MOST_KNOWN, MOST_DEAD = 500_000, 0.25

PLACE, PLACE_COLUMNS = "pack string, start long, length long", ["pack", "start", "length"]


def gear_table(seed: int = 1) -> np.ndarray:
    """256 pseudo-random 32-bit numbers, from digests of the byte values."""
    return np.array([struct.unpack("<I", hashlib.sha256(f"{seed}:{k}".encode()).digest()[:4])[0] for k in range(256)], np.uint32)


_GEAR = gear_table()


def wav(payload: bytes) -> bytes:
    """Mono, 8 bits a sample; the payload's bytes are the samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV as wav() writes it."""
    riff, _, kind, _, _, form, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (riff, kind, form, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) != 44 + n:
        raise ValueError("not an 8-bit mono WAV")
    return media[44:]


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def hits(data: bytes, usual: int = USUAL) -> list[int]:
    """Places after which the gear hash of the last 32 bytes has log2(usual) leading zero bits; slab by slab."""
    found = []
    shift = np.uint32(32 - (usual.bit_length() - 1))
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), SLAB):
        before = min(at, GEAR_WINDOW - 1)
        h = _GEAR[raw[at - before : at + SLAB]]
        width = 1
        while width < GEAR_WINDOW:  # the sum over 2 * width bytes from two over width
            step = h.copy()
            step[width:] += h[:-width] << np.uint32(width)
            h, width = step, 2 * width
        found += (np.flatnonzero((h[before:] >> shift) == 0) + at + 1).tolist()
    return found


def cuts(data: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Ends of the chunks of data, which is not empty."""
    ends, last = [], 0
    for at in hits(data, usual):
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while len(data) - last > most:
        last += most
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


class _Pack:
    """Appends compressed chunks to files of this task attempt."""

    def __init__(self, folder: str):
        self.fs, self.path = file_system(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.stamp, self.n, self.out, self.name, self.size = task_stamp(), 0, None, "", 0

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out and self.size >= PACK_BYTES:
            self.close()
        if not self.out:
            self.name, self.size, self.n = f"pack-{self.stamp}-{self.n:04d}", 0, self.n + 1
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.out.write(raw)
        self.size += len(raw)
        return self.name, self.size - len(raw), len(raw)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.out = None


def _stores(folder: str):
    chunk = pa.struct([("digest", pa.binary()), ("bytes", pa.int32()), ("pack", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, known, zip_ = _Pack(folder), OrderedDict(), zstandard.ZstdCompressor(level=3)
        for b in batches:
            sizes, lists = [], []
            for text in b.column("text"):
                raw = text.as_py()
                data = payload(raw)
                media, listed, last = wav(data), [], 0
                sizes.append((len((raw or "").encode()), len(data), len(media), hashlib.sha256(media).digest()))
                for end in cuts(media):
                    part, last = media[last:end], end
                    digest = hashlib.sha256(part).digest()
                    if digest not in known:
                        if len(known) >= MOST_KNOWN:
                            known.popitem(last=False)
                        known[digest] = pack.add(zip_.compress(part))
                    listed.append((digest, len(part), *known[digest]))
                lists.append([dict(zip(("digest", "bytes", "pack", "start", "length"), x)) for x in listed])
            columns = [pa.array(c, t) for c, t in zip(zip(*sizes), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))] if sizes else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.record_batch([b.column("_rid"), b.column("doc_id"), *columns, pa.array(lists, pa.list_(chunk))], names=["_rid", "doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256", "chunks"])
        pack.close()

    return run


def store(docs: DataFrame, folder: str, scratch: Scratch, most_dead: float = MOST_DEAD) -> tuple[DataFrame, DataFrame]:
    """Store the texts of docs (doc_id, text) as media: the media table and the chunk table.

    media: _rid, doc_id, n_bytes, payload_bytes, media_bytes, media_sha256, chunks (digests, in order).
    chunks: digest, bytes, uses (places in lists) and the one place (pack, start, length) that holds it.
    """
    base = row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    ddl = "_rid long, doc_id long, n_bytes long, payload_bytes long, media_bytes long, media_sha256 binary, chunks array<struct<digest:binary,bytes:int,pack:string,start:long,length:long>>"
    listed = scratch.table(base.select("_rid", "doc_id", "text").mapInArrow(_stores(folder), ddl), "listed")
    placed = listed.select(F.explode("chunks").alias("c")).select("c.*")
    chosen = scratch.table(placed.groupBy("digest").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("uses"), F.min(F.struct("pack", "start", "length")).alias("at")).select("digest", "bytes", "uses", "at.*"), "chunks")
    written = placed.select(*PLACE_COLUMNS).distinct().groupBy("pack").agg(F.sum("length").alias("written"))
    used = chosen.groupBy("pack").agg(F.sum("length").alias("used"))
    dead = scratch.table(
        written.join(used, "pack", "left").select("pack", "written", F.coalesce("used", F.lit(0)).alias("used")).filter(F.col("used") < (1 - most_dead) * F.col("written")), "dead"
    )
    if dead.limit(1).count():
        moved = scratch.table(chosen.join(dead.select("pack"), "pack").groupBy("pack").applyInArrow(_moves(folder), f"digest binary, bytes int, uses long, {PLACE}"), "moved")
        kept = chosen.join(dead.select("pack"), "pack", "left_anti").select("digest", "bytes", "uses", *PLACE_COLUMNS)
        chosen = scratch.table(kept.unionByName(moved), "chunks-moved")
        dead.mapInArrow(_deletes(folder), "pack string").count()
    return listed, chosen


def _moves(folder: str):
    """Copy what is in use of one pack into a new one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        out, fs_path, places = _Pack(folder), file_system(folder), []
        with fs_path[0].open_input_file(f"{fs_path[1]}/{table['pack'][0].as_py()}") as source:
            for start, length in zip(table["start"].to_pylist(), table["length"].to_pylist()):
                source.seek(start)
                places.append(out.add(source.read(length)))
        out.close()
        return pa.table({"digest": table["digest"], "bytes": table["bytes"], "uses": table["uses"], "pack": [p for p, _, _ in places], "start": [s for _, s, _ in places], "length": [n for _, _, n in places]})

    return run


def _deletes(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for b in batches:
            for name in b.column("pack").to_pylist():
                try:
                    fs.delete_file(f"{path}/{name}")
                except FileNotFoundError:  # an earlier attempt did it
                    pass
            yield b.select(["pack"])

    return run


def features(data: bytes) -> str:
    """Mean, root mean square about 128, zero crossings and a 16-bin histogram (in 1/255 of the fullest bin)."""
    x = np.frombuffer(data, np.uint8)
    total = squares = 0
    crossings, last, bins = 0, 0, np.zeros(16, np.int64)
    for at in range(0, len(x), SLAB):
        y = x[at : at + SLAB].astype(np.int64) - 128
        total += int(y.sum())
        squares += int((y * y).sum())
        sign = (y >= 0).astype(np.int8)
        crossings += int((sign[1:] != sign[:-1]).sum()) + (at > 0 and sign[0] != last)
        last = sign[-1]
        bins += np.bincount(x[at : at + SLAB] >> 4, minlength=16)
    n = len(x)
    return f"mean={total / n:.4f};rms={(squares / n) ** 0.5:.4f};zcr={crossings / n:.6f};hist={''.join(f'{int(b * 255 // bins.max()):02x}' for b in bins)}"


class _Chunks:
    """Reads chunks by place; keeps a few packs open and the last run of bytes read."""

    def __init__(self, folder: str):
        self.fs, self.path = file_system(folder)
        self.open: OrderedDict = OrderedDict()
        self.unzip = zstandard.ZstdDecompressor()

    def read(self, digest: bytes, pack: str, start: int, length: int) -> bytes:
        if pack not in self.open:
            self.open[pack] = [self.fs.open_input_file(f"{self.path}/{pack}"), 0, b""]
            if len(self.open) > 16:
                self.open.popitem(last=False)[1][0].close()
        self.open.move_to_end(pack)
        source, at, held = entry = self.open[pack]
        if not (at <= start and start + length <= at + len(held)):
            source.seek(start)
            entry[1:] = at, held = start, source.read(max(length, 1 << 17))
        raw = self.unzip.decompress(held[start - at : start - at + length])
        if hashlib.sha256(raw).digest() != digest:
            raise ValueError(f"chunk differs from its digest: {pack} {start}")
        return raw


def _reads(folder: str, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(folder)
        for b in batches:
            rows = []
            for row in b.to_pylist():
                media = b"".join(chunks.read(c["digest"], c["pack"], c["start"], c["length"]) for c in sorted(row["chunks"], key=lambda c: c["chunk_no"]))
                sha = hashlib.sha256(media).digest()
                if sha != row["media_sha256"] or len(media) != row["media_bytes"]:
                    raise ValueError(f"media of {row['doc_id']} differ from what was stored")
                data = samples(media)
                rows.append((row["_rid"], row["doc_id"], row["n_bytes"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), sha.hex(), features(data), data if with_bytes else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), READ_TYPES)], names=READ_NAMES)

    return run


READ_NAMES = ["_rid", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "payload"]
READ_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
READ_DDL = "_rid long, doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, payload binary"


def load(media: DataFrame, chunks: DataFrame, folder: str, scratch: Scratch, with_bytes: bool = False) -> DataFrame:
    """Rebuild media from their chunk lists and check them: sizes, digests, features, and payloads with with_bytes.

    A row's list is as long as its media; the lists alone are shuffled, to as many tasks as the media
    have TASK_BYTES, as a small list may stand for large media.
    """
    total = media.agg(F.sum("media_bytes")).first()[0] or 0
    n = max(partitions(media.sparkSession), -(-total // TASK_BYTES))
    listed = media.select("_rid", F.posexplode("chunks.digest").alias("chunk_no", "digest"))
    placed = spread_join(listed, chunks.select("digest", "uses", *PLACE_COLUMNS), ["digest"], "uses")
    rows = placed.repartition(n, "_rid").groupBy("_rid").agg(F.collect_list(F.struct("chunk_no", "digest", *PLACE_COLUMNS)).alias("chunks"))
    whole = media.drop("chunks").repartition(n, "_rid").join(rows.hint("merge"), "_rid")
    return whole.mapInArrow(_reads(folder, with_bytes), READ_DDL)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store the texts of docs, read them back: _rid, doc_id, sizes, digests and features of every row.

    A null text counts as empty, whose payload is 64 zero bytes. Repeated rows are media each, with
    shared chunks; an empty table gives no rows; other columns than doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession, "media")
    folder = f"{scratch.root}/packs"
    media, chunks = store(docs, folder, scratch)
    return load(media, chunks, folder, scratch).drop("payload")
