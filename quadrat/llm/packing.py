"""Hierarchical best-fit packing of token pieces into sequences.

Each task tokenizes its documents and packs their pieces best-fit. Sequences that are nearly full
are final; the others, with what they hold, are items of the next round, where fewer tasks pack the
remains of several, down to one. Once a round saves next to nothing, only those that are at most half full
go on, as any two of them fit into one.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept, lean

CAPACITY = 1024
END_ID = 2
#: A sequence with at most so many free places is final.
SLACK = 3
#: Rounds merge the remains of so many tasks.
FAN_IN = 8
#: Items that one task packs at once, and words that its tokenizer remembers.
MOST_ITEMS, MOST_WORDS = 200_000, 400_000

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = "sequence_id long, used int, final boolean, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"

class Encoder:
    """Texts to little-endian 32-bit ids of a byte-level BPE vocabulary.

    A single space between two other characters always starts a new token, so what lies between
    such spaces is encoded by itself, once for each distinct string.
    """

    def __init__(self, vocabulary: str):
        ranks = Path(vocabulary).with_suffix(".tiktoken")
        if ranks.exists():  # the same vocabulary as ranks, for the faster library
            import base64

            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            own = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.ids = own.encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(vocabulary)
            tok.encode_special_tokens = True
            self.ids = lambda s: tok.encode(s, add_special_tokens=False).ids

        class Known(dict):
            def __missing__(words, word: str) -> bytes:
                if len(words) >= MOST_WORDS:
                    words.clear()
                ids = np.array(self.ids(" " + word), "<u4").tobytes()
                if len(word) < 64:
                    words[word] = ids
                return ids

        self.known = Known()

    def whole(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest:
            return self.whole(text)
        if any(x.isspace() or not x or x[0].isspace() or x[-1].isspace() for x in rest) or first[-1:].isspace() or not first:
            return self._uneven(first, rest)
        return self.whole(first) + b"".join(map(self.known.__getitem__, rest))

    def _uneven(self, first: str, rest: list[str]) -> bytes:
        """With runs of white space: spaces next to other white space don't part what is encoded."""
        parts, held = [], [first]
        for word in rest:
            last = held[-1]
            if last and word and not last[-1].isspace() and not word[0].isspace():
                parts.append(" ".join(held))
                held = [word]
            else:
                held.append(word)
        parts.append(" ".join(held))
        return self.whole(parts[0]) + b"".join(map(self.known.__getitem__, parts[1:]))


def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker, until it takes up another operator."""
    encoders = kept("packing")
    if vocabulary not in encoders:
        encoders[vocabulary] = Encoder(vocabulary)
    return encoders[vocabulary]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes; the largest items first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        if fit := rooms >> size:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room := room - size:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def _batches(bins: list[tuple[int, list[tuple]]], first_id: int, least: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """bins: room taken and members; members get their offsets here."""
    for at in range(0, len(bins), rows):
        part = bins[at : at + rows]
        flat = [m for _, members in part for m in members]
        lengths = np.fromiter((m[3] for m in flat), np.int64, len(flat))
        ends = np.cumsum(lengths)
        cuts = np.cumsum([0, *(len(members) for _, members in part)])
        starts = np.repeat((ends - lengths)[cuts[:-1]], np.diff(cuts)) if len(flat) else ends
        columns = [pa.array([m[k] for m in flat], t.type) for k, t in enumerate(list(MEMBER)[:5])]
        members = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([*columns, pa.array(ends - lengths - starts)], fields=list(MEMBER)))
        used = np.fromiter((u for u, _ in part), np.int32, len(part))
        yield pa.record_batch(
            [pa.array(np.arange(first_id + at, first_id + at + len(part))), pa.array(used), pa.array(used >= least), members], names=["sequence_id", "used", "final", "members"]
        )


def _ids(round_: int) -> int:
    from pyspark import TaskContext

    return (round_ << 57) + (TaskContext.get().partitionId() << 32)


def _first_round(vocabulary: str, capacity: int, end_id: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, next_id, items = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), _ids(0), []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, items
            bins = best_fit([m[3] for m in items], capacity)
            out = [(sum(items[i][3] for i in b), [items[i] for i in b]) for b in bins]
            yield from _batches(out, next_id, capacity - slack)
            next_id, items = next_id + len(out), []

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = enc.encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity if n > capacity else n
                cuts = [0, *range(first, n + 1, capacity)]
                items += [(doc_id, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
            if len(items) >= MOST_ITEMS:
                yield from packed()
        if items:
            yield from packed()

    return run


def _next_round(round_: int, capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id, held = _ids(round_), []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held
            bins = best_fit([u for u, _ in held], capacity)
            out = [(sum(held[i][0] for i in b), [m for i in b for m in held[i][1]]) for b in bins]
            yield from _batches(out, next_id, capacity - slack)
            next_id, held = next_id + len(out), []

        for b in batches:
            for used, members in zip(b.column("used").to_pylist(), b.column("members").to_pylist()):
                held.append((used, [tuple(m[f.name] for f in list(MEMBER)[:5]) for m in members]))
            if len(held) >= MOST_ITEMS:
                yield from packed()
        if held:
            yield from packed()

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    docs has doc_id and text; other columns are ignored. vocabulary is a tokenizer's JSON file that
    every executor can read. A null text counts as empty and is the end id alone; longer documents
    than capacity are cut into full pieces and a first one with the rest. Repeated rows are packed
    each by itself, an empty table gives no rows. Rounds end when all remains have met in one task; once a
    round saves no more than 0.5 % of the underfull sequences, those over half full, which no two of can share
    one, are left as they are: what more rounds could still gain is the short pieces among the others.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = []
    rows = scratch.table(base.mapInArrow(lean(_first_round(vocabulary, capacity, end_id, slack), "packing"), BIN), "round0")
    tasks, before, k = max(1, rows.select(F.shiftright("sequence_id", 32)).distinct().count()), None, 0
    going = "not final"
    while True:
        left = rows.filter(going).count()
        if going == "not final" and k and left > 0.995 * before:
            going = f"not final and used <= {capacity // 2}"
            left = rows.filter(going).count()
        if left < 2 or (k and tasks == 1):
            done.append(rows)
            break
        done.append(rows.filter(f"not ({going})"))
        tasks = max(1, -(-tasks // FAN_IN), -(-left // MOST_ITEMS))
        k, before = k + 1, left
        rows = scratch.table(rows.filter(going).select("used", "members").repartition(tasks).mapInArrow(lean(_next_round(k, capacity, slack), "packing"), BIN), f"round{k}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
