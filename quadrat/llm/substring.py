"""Removal of long repeated passages, found through difference-cover anchors.

A difference cover D modulo v holds, for every r, two members that differ by r. If two documents
share a run of at least v - 1 + a words, some place in the run is at a cover position (modulo v)
in both, and the a words from there are the same anchor. So anchors are hashed at cover positions
alone, and only the windows that contain an anchor known from another document are looked at.
Those windows are compared over their whole length, which extends a match to both sides.

Documents are held in blocks, a compressed row each. What blocks exchange are sorted lists of
distinct hashes, dealt out by ranges of the hash; a hash that is frequent in a block is sent once, so
no passage, however common, gathers in a task. Answers are bitmaps in the order that was sent.

A list costs a row for each block and range, so that ranges can't grow in number with the corpus for
ever: with more than MOST_RANGES of them, hashes are rows of their own, which Spark deals out and sorts, and
what grows is one row for each hash that a block has. The results are the same. A hash then has as many rows
as blocks that have it, at most one each, which is less than a task's share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, partitions

WINDOW = 50
#: Each residue modulo PERIOD is a difference of two members of COVER.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 4096
#: Hashes that one range holds, about.
RANGE_HASHES = 1_000_000
#: Ranges up to which blocks send a list to each: a list has some hundred hashes then.
MOST_RANGES = 1024
LAST = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolled(h: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Hash of the width words from each place on; by doubling, a few passes over the array."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, size, out, done = h, 1, None, 0
    while True:
        if width & size:
            part = run[done:]
            out = part.copy() if out is None else out[: len(part)] + _power(factor, done) * part[: len(out)]
            done += size
        if done == width:
            return _mix(out[:n])
        run = run[:-size] + _power(factor, size) * run[size:]
        size *= 2


def _power(factor: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(factor), n, 1 << 64))


def _packed(a: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes; sorted ones are small as differences."""
    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T.tobytes())


def _unpacked(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()


def _differences(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


class Block:
    """Some documents: their words, and hashes of windows of words."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int):
        self.ids, self.window = ids, window
        words = [t.split() for t in texts]  # bytes.split() parts at the six ASCII white spaces
        self.words = [w for ws in words for w in ws]
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        n = len(self.words)
        self.h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, n)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        self.left = np.repeat(self.ends, self.lengths) - np.arange(n)  # words to the document's end
        self.place = np.arange(n) - np.repeat(self.starts, self.lengths)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of anchors, for each its number among the distinct hashes, and those, sorted, 48 bits each."""
        width = self.window - PERIOD + 1
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(cover[self.place % PERIOD] & (self.left >= width))
        distinct, number = np.unique(_rolled(self.h, width, _A)[at] >> np.uint64(16), return_inverse=True)
        return at, number, distinct

    def candidates(self, elsewhere: np.ndarray) -> np.ndarray:
        """Places of windows with an anchor that is in another document here, or of which elsewhere says so."""
        at, number, distinct = self.anchors()
        doc_id = self.ids[self.doc[at]]
        low, high = np.full(len(distinct), LAST), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, number, doc_id)
        np.maximum.at(high, number, doc_id)
        shared = at[(elsewhere | (low < high))[number]]
        step = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(step, np.maximum(shared - PERIOD + 1, self.starts[self.doc[shared]]), 1)
        np.add.at(step, shared + 1, -1)
        return np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.left >= self.window))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each window its number among the distinct ones; those, sorted, as 64 and 32 bits, and their smallest doc_id."""
        a = _rolled(self.h, self.window, _A)[at]
        b = (_rolled(self.h, self.window, _B)[at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        number = np.empty(len(a), np.int64)
        number[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[self.doc[at]][order], np.flatnonzero(new)) if len(a) else np.zeros(0, np.int64)
        return number, a[new], b[new], least


def _ranges(h: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of n equal ranges of the hash begins and ends in sorted h."""
    return np.searchsorted(h, np.array([(k << bits) // n for k in range(1, n)], np.uint64)).tolist()


def _sent(block_id: int, n: int, bits: int, h: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    cuts = [0, *_ranges(h, bits, n), len(h)]
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if a < z:
            yield (block_id, k, [_packed(_differences(h[a:z])), *(_packed(x[a:z]) for x in more)])


def _first(window: int, n_ranges: int, block_bytes: int, block_docs: int):
    """Documents to blocks with their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block_id = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        nulls: list[bool] = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            made = Block(np.array(ids, np.int64), texts, window)
            sent = [{"range": k, "data": d[0]} for _, k, d in _sent(block_id, n_ranges, 48, made.anchors()[2])]
            row = [block_id, ids, nulls, [len(t) for t in texts], zstandard.ZstdCompressor(level=3).compress(b"".join(texts)), sent]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, BLOCK_TYPES)], names=BLOCK_NAMES)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids.append(LAST if doc_id is None else doc_id)
                nulls.append(doc_id is None)
                texts.append((text.as_py() or "").encode())
                held += len(texts[-1])
                if held >= block_bytes or len(ids) >= block_docs:
                    yield block()
                    block_id, ids, nulls, texts, held = block_id + 1, [], [], [], 0
        if ids:
            yield block()

    return run


BLOCK_NAMES = ["block_id", "ids", "nulls", "lengths", "texts", "anchors"]
BLOCK_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.struct([("range", pa.int32()), ("data", pa.binary())]))]
BLOCK_DDL = "block_id long, ids array<long>, nulls array<boolean>, lengths array<long>, texts binary, anchors array<struct<range:int,data:binary>>"
ANSWER_DDL = "block_id long, range int, bits binary"


def _bits(flags: np.ndarray, sizes: list[int]) -> list[bytes]:
    return [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]


def _answer(table: pa.Table, bits: list[bytes]) -> pa.Table:
    return pa.table({"block_id": table["block_id"], "range": table["range"], "bits": pa.array(bits, pa.binary())})


def _known_elsewhere(table: pa.Table) -> pa.Table:
    """For each anchor hash, whether another block has it."""
    parts = [np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table["data"]]
    h = np.concatenate(parts)
    _, number, count = np.unique(h, return_inverse=True, return_counts=True)
    return _answer(table, _bits(count[number] > 1, [len(p) for p in parts]))


def _earlier_elsewhere(table: pa.Table) -> pa.Table:
    """For each window hash, whether another block has it in a document with a smaller doc_id."""
    columns = [[_unpacked(x.as_py(), t) for x in table[c]] for c, t in (("data", np.uint64), ("check", np.uint32), ("least", np.int64))]
    sizes = [len(p) for p in columns[0]]
    a, b, least = np.concatenate([np.cumsum(p, dtype=np.uint64) for p in columns[0]]), np.concatenate(columns[1]), np.concatenate(columns[2])
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    first = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    flags = np.empty(len(a), bool)
    flags[order] = first < least[order]
    return _answer(table, _bits(flags, sizes))


def _opened(row: dict, window: int) -> Block:
    raw = zstandard.ZstdDecompressor().decompress(row["texts"])
    ends = np.cumsum(row["lengths"]).tolist()
    texts = [raw[a:z] for a, z in zip([0, *ends], ends)]
    return Block(np.array(row["ids"], np.int64), texts, window)


def _flags(answers: list[dict] | None, h: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The answers' bits in the order of the sorted hashes."""
    cuts = [0, *_ranges(h, bits, n), len(h)]
    out = np.zeros(len(h), bool)
    for x in answers or []:
        a, z = cuts[x["range"]], cuts[x["range"] + 1]
        out[a:z] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=z - a).astype(bool)
    return out


def _unpacked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of anchors to rows."""
    for b in batches:
        for block_id, data in zip(b.column("block_id").to_pylist(), b.column("data")):
            h = np.cumsum(_unpacked(data.as_py(), np.uint64), dtype=np.uint64)
            yield pa.record_batch([pa.array(np.full(len(h), block_id)), pa.array(h.view(np.int64))], names=["block_id", "h"])


def _gathered_rows(table: pa.Table) -> pa.Table:
    """The rows of a block to one, of sorted hashes."""
    h = table["h"].to_numpy().view(np.uint64)
    check = table["check"].to_numpy() if "check" in table.column_names else np.zeros(len(h), np.int32)
    order = np.lexsort((check.view(np.uint32), h))
    return pa.table({"block_id": table["block_id"][:1], "known": pa.array([h[order].tobytes()], pa.binary()), "checks": pa.array([check[order].tobytes()], pa.binary())})


def _among(row: dict, name: str, h: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """Which of the sorted hashes (with checks) are among those gathered for the block."""
    found = row[name]
    if not found:
        return np.zeros(len(h), bool)
    known = np.frombuffer(found["known"], np.uint64)
    if check is None:
        return np.isin(h, known)
    pair = np.dtype([("h", np.uint64), ("c", np.uint32)])
    mine, theirs = np.empty(len(h), pair), np.empty(len(known), pair)
    mine["h"], mine["c"], theirs["h"], theirs["c"] = h, check, known, np.frombuffer(found["checks"], np.uint32)
    # both are sorted and without repeats: equal neighbours of the merged list are met
    both = np.concatenate([mine, theirs])
    order = np.lexsort((both["c"], both["h"]))
    met = np.zeros(len(both), bool)
    met[order[:-1]] = both[order[:-1]] == both[order[1:]]
    met[order[1:]] |= met[order[:-1]]
    return met[: len(h)]


def _asked(row: dict, block: Block, n_ranges: int) -> np.ndarray:
    """Places of the windows in question, by what the block was told about its anchors."""
    distinct = block.anchors()[2]
    return block.candidates(_flags(row["about_anchors"], distinct, 48, n_ranges) if n_ranges else _among(row, "about_anchors", distinct))


def _second(window: int, n_ranges: int):
    """Blocks with answers about anchors to the windows in question: lists for each range, or rows if there are no ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = _opened(row, window)
                _, a, check, least = block.windows(_asked(row, block, n_ranges))
                if not n_ranges:
                    yield pa.record_batch([pa.array(np.full(len(a), row["block_id"])), pa.array(a.view(np.int64)), pa.array(check.view(np.int32)), pa.array(least)], names=["block_id", "h", "check", "least"])
                    continue
                sent = list(_sent(row["block_id"], n_ranges, 64, a, check, least))
                if sent:
                    yield pa.record_batch(
                        [pa.array([s[0] for s in sent], pa.int64()), pa.array([s[1] for s in sent], pa.int32()), *(pa.array([s[2][k] for s in sent], pa.binary()) for k in range(3))],
                        names=["block_id", "range", "data", "check", "least"],
                    )

    return run


def _third(window: int, n_ranges: int, with_text: bool):
    """Blocks with answers about windows to documents without their repeated words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = _opened(row, window)
                at = _asked(row, block, n_ranges)
                number, a, check, least = block.windows(at)
                elsewhere = _flags(row["about_windows"], a, 64, n_ranges) if n_ranges else _among(row, "about_windows", a, check)
                repeated = elsewhere[number] | (least[number] < block.ids[block.doc[at]])
                step = np.zeros(len(block.h) + 1, np.int64)
                np.add.at(step, at[repeated], 1)
                np.add.at(step, at[repeated] + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[block.ends] - total[block.starts]
                shas, kept_texts = [], []
                for s, e, k in zip(block.starts.tolist(), block.ends.tolist(), removed.tolist()):
                    words = block.words[s:e] if not k else [w for w, g in zip(block.words[s:e], gone[s:e].tolist()) if not g]
                    kept = b" ".join(words)
                    shas.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode() if with_text else None)
                ids = pa.array([None if null else x for x, null in zip(row["ids"], row["nulls"])], pa.int64())
                yield pa.record_batch(
                    [ids, pa.array(block.lengths), pa.array(removed), pa.array(shas, pa.string()), pa.array(kept_texts, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null unless with_text) of every row.

    A window of so many words is removed if its words also start in a document with a smaller
    doc_id. docs has doc_id and text; other columns are ignored. Null text has no words. Rows with
    one doc_id are one document to each other and don't remove words of each other; a null doc_id is
    larger than all others. Windows count as equal if 96 bits of two hashes are. An empty table gives
    no rows. A block holds block_bytes of text, or one text if that is longer.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has at least {PERIOD + 1} words")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions(spark), size // 6 // RANGE_HASHES)
    n = n if n <= most_ranges else 0
    blocks = scratch.table(base.mapInArrow(_first(window, n or 1, block_bytes, block_docs), BLOCK_DDL), "blocks")
    anchors = blocks.select("block_id", F.explode("anchors").alias("x")).select("block_id", "x.range", "x.data")
    held = blocks.select("block_id", "ids", "nulls", "lengths", "texts")

    def told(to: DataFrame, answers: DataFrame, name: str) -> DataFrame:
        """Blocks with what they were told: bitmaps by range, or a struct of gathered hashes."""
        if n:
            rows = answers.groupBy("block_id").agg(F.collect_list(F.struct("range", "bits")).alias(name))
        else:
            found = answers.groupBy("block_id").applyInArrow(_gathered_rows, "block_id long, known binary, checks binary")
            rows = found.select("block_id", F.struct("known", "checks").alias(name))
        return to.join(rows, "block_id", "left")

    if n:
        about = anchors.groupBy("range").applyInArrow(_known_elsewhere, ANSWER_DDL)
    else:
        same = Window.partitionBy("h")
        rows = anchors.select("block_id", "data").mapInArrow(_unpacked_rows, "block_id long, h long")
        about = rows.withColumns({"a": F.min("block_id").over(same), "z": F.max("block_id").over(same)}).filter("a < z").select("block_id", "h")
    held = told(held, scratch.table(about, "about-anchors"), "about_anchors")
    if n:
        sent = held.mapInArrow(_second(window, n), "block_id long, range int, data binary, check binary, least binary")
        about = sent.groupBy("range").applyInArrow(_earlier_elsewhere, ANSWER_DDL)
    else:
        same = Window.partitionBy("h", "check")
        sent = held.mapInArrow(_second(window, 0), "block_id long, h long, check int, least long")
        about = sent.withColumn("first", F.min("least").over(same)).filter("first < least").select("block_id", "h", "check")
    final = told(held, scratch.table(about, "about-windows"), "about_windows")
    return final.mapInArrow(_third(window, n, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
