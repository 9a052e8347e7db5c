"""Near duplicates by consistent weighted sampling of TF-IDF shingles.

A document is the set of its five-word shingles, each weighing one plus the logarithm of its count,
times its inverse document frequency. Improved consistent weighted sampling draws shingles so that two documents draw
alike with a probability equal to their weighted Jaccard similarity. Draws are banded; documents that
share a band are compared with two centres of that band, and a link stands if the similarity,
computed from both whole texts, is high enough. Classes are the connected components. Where a
band's documents are then still in several classes, all of different classes are compared, in blocks;
so no two documents that share a band stay apart without having been compared, unless links join them.

With floor 0, as the queries ask for, the document frequency of every shingle is exact. Documents are held in blocks, a compressed row each.
A block sends a sorted list of its distinct shingles, with the number of its documents that have each, to
each range of the hash; a range adds up what its lists say and answers each list with the frequencies in
the whole, in the order that was sent. So no shingle, however common, gathers in a task, and nothing is
broadcast. From then on a document's frequencies, in the order of its shingles, go wherever its text goes.

With a floor above 0, frequencies are exact for shingles in at least that share of all documents, and all
rarer ones weigh as if at it. A shingle that frequent in the whole is as frequent in some part, so each
part names its own, and a second pass counts what was named over all documents. There are at
most (shingles per document) / floor of them, at any size of the corpus.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AT, Scratch, hand_back, lean, partitions, pick_rows, place, rooted, row_ids, spread_join
from .graph import components
from .substring import _packed, _ranges, _sent, _unpacked

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 3
#: Share of documents below which classes() by itself doesn't tell frequencies apart; the queries ask for floor 0: all are exact.
FLOOR = 0.01
#: Shingles and documents of a block of the exchange of frequencies, at most (or one longer text), and about the shingles of a range.
HELD_SHINGLES, HELD_DOCS, RANGE_SHINGLES = 1 << 19, 4096, 2_000_000
PART_DOCS, PART_SHINGLES = 4000, 4_000_000
#: Documents of a block of the last round, and shingles that a task keeps of documents it has read.
BLOCK, MOST_HELD = 256, 4_000_000
#: Up to so many named shingles are counted from a broadcast list, more by a shuffle.
MOST_NAMED = 1_000_000
#: 256 MB of common shingles; documents would have 160,000 words each on average to have as many.
MOST_COMMON = 16_000_000
SEED, TABLE_BITS, SLAB = 20_240_501, 16, 4096
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's shingles and their counts; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _P + h[k : n - width + 1 + k]
    return np.unique(_mix(out), return_counts=True)


def _words(text) -> list[bytes]:
    return (text.as_py() or "").encode().split()  # bytes.split() parts at the six ASCII white spaces


class Weights:
    """Inverse document frequency: by frequencies that come with the shingles, else exact for the common ones and one value for the others."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, docs: int, floor: float):
        order = np.argsort(common)
        self.docs = docs
        self.common, self.idf = common[order], np.log1p(docs / np.maximum(counts[order], 1))
        self.rare = math.log1p(1 / floor) if floor else float(np.log1p(np.full(1, max(docs, 1.0)))[0])

    def of(self, h: np.ndarray, counts: np.ndarray, df: bytes | None = None) -> np.ndarray:
        """Weights of sorted shingles; df has their document frequencies, packed."""
        if df is not None:
            return np.log1p(self.docs / _unpacked(df, np.uint32)) * (1 + np.log(counts))
        w = np.full(len(h), self.rare)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            known = self.common[at] == h
            w[known] = self.idf[at[known]]
        return w * (1 + np.log(counts))  # a line repeated many times shouldn't outweigh all else


class Sampler:
    """Consistent weighted samples; gamma and uniform draws come from a table that a hash of shingle and draw looks up."""

    def __init__(self, draws: int, usual: float, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        n = 1 << TABLE_BITS
        self.r, c, self.beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
        self.log_c = np.log(c)
        self.factors = rng.integers(1 << 62, size=draws, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.usual = usual
        self.usual_a = self._log_a(np.arange(n), math.log(usual))

    def _t(self, j: np.ndarray, log_w) -> np.ndarray:
        return np.floor(log_w / self.r[j] + self.beta[j])

    def _log_a(self, j: np.ndarray, log_w) -> np.ndarray:
        return self.log_c[j] - self.r[j] * (self._t(j, log_w) - self.beta[j]) - self.r[j]

    def draw(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One hash of (shingle, level) for each draw; h is sorted and not empty."""
        best, who = np.full(len(self.factors), np.inf), np.zeros(len(self.factors), np.int64)
        for at in range(0, len(h), SLAB):
            x, y = h[at : at + SLAB], w[at : at + SLAB]
            j = ((x[:, None] * self.factors) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            a = self.usual_a[j]
            odd = np.flatnonzero(y != self.usual)
            if len(odd):
                a[odd] = self._log_a(j[odd], np.log(y[odd])[:, None])
            i = a.argmin(0)
            low = a[i, np.arange(a.shape[1])]
            better = low < best
            best[better], who[better] = low[better], i[better] + at
        j = ((h[who] * self.factors) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        t = self._t(j, np.log(w[who])).astype(np.int64).astype(np.uint64)
        return _mix(h[who] * _P + t)


def _band_keys(drawn: np.ndarray, bands: int) -> np.ndarray:
    parts = drawn.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(parts.shape[1]):
        key = _mix(key * _P + parts[:, k])
    return key.view(np.int64)


def _pairs(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _named(floor: float):
    """Shingles that are frequent in a part of the documents.

    A part is half of what is held, so that what is left at a task's end is no small rest: in a
    hundred documents, every shingle would be frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent(part: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(part), return_counts=True)
            some = n >= math.ceil(floor * len(part))
            return _pairs(h[some], n[some])

        for b in batches:
            for text in b.column("text"):
                held.append(shingles(_words(text))[0])
                size += len(held[-1])
                if len(held) >= 2 * PART_DOCS or size >= 2 * PART_SHINGLES and len(held) > 1:
                    half = len(held) // 2
                    yield frequent(held[:half])
                    held = held[half:]
                    size = sum(map(len, held))
        if held:
            yield frequent(held)

    return run


def _counted(named):
    """Documents with each named shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = named.value
        n = np.zeros(len(known), np.int64)
        for b in batches:
            for text in b.column("text"):
                h = shingles(_words(text))[0]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                n[at[known[at] == h]] += 1
        some = n > 0
        if some.any():
            yield _pairs(known[some], n[some])

    return run


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text in b.column("text"):
            h = shingles(_words(text))[0]
            yield _pairs(h, np.ones(len(h)))


def weights(docs: DataFrame, scratch: Scratch, floor: float = FLOOR, most_named: int = MOST_NAMED) -> Weights:
    """Document frequencies over all rows of docs (column text)."""
    total = docs.count()
    named = scratch.table(docs.select("text").mapInArrow(lean(_named(floor)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "named")
    n = named.count()
    if not n:
        return Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), total, floor)
    if n <= most_named:
        known = np.sort(named.select("h").toArrow()["h"].to_numpy().view(np.uint64))
        counted = docs.select("text").mapInArrow(lean(_counted(docs.sparkSession.sparkContext.broadcast(known))), "h long, n long")
    else:
        counted = docs.select("text").mapInArrow(lean(_all_shingles), "h long, n long").join(named.select("h"), "h", "left_semi")
    # of these there are at most (shingles per document) / floor
    common = scratch.table(counted.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor * total), "common")
    n = common.count()
    if n > MOST_COMMON:
        raise ValueError(f"{n} shingles are in at least {floor:.2%} of all documents each, which is too many to broadcast; a higher floor names fewer")
    found = common.toArrow()
    return Weights(found["h"].to_numpy().view(np.uint64), found["n"].to_numpy(), total, floor)


def _blocks(n_ranges: int, most_shingles: int, most_docs: int):
    """Documents to blocks with the lists of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block_id = TaskContext.get().partitionId() << 32
        places, ids, texts, held, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            lists = [{"range": k, "data": data, "n": some} for _, k, (data, some) in _sent(block_id, n_ranges, 64, h, n.astype(np.uint32))]
            row = [block_id, places, ids, [len(t) for t in texts], zstandard.ZstdCompressor(level=3).compress(b"".join(texts)), lists]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, BLOCK_TYPES)], names=BLOCK_NAMES)

        for b in batches:
            for at, doc_id, text in zip(b.column("_at").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                words = _words(text)
                places.append(at)
                ids.append(doc_id)
                texts.append(b" ".join(words))
                held.append(shingles(words)[0])
                size += len(held[-1])
                if size >= most_shingles or len(ids) >= most_docs:
                    yield block()
                    block_id, places, ids, texts, held, size = block_id + 1, [], [], [], [], 0
        if ids:
            yield block()

    return run


BLOCK_NAMES = ["block_id", "at", "ids", "lengths", "texts", "lists"]
BLOCK_TYPES = [
    pa.int64(), pa.list_(pa.struct([("file", pa.int64()), ("row", pa.int64())])), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
    pa.list_(pa.struct([("range", pa.int32()), ("data", pa.binary()), ("n", pa.binary())])),
]
BLOCK_DDL = f"block_id long, at array<{AT}>, ids array<long>, lengths array<long>, texts binary, lists array<struct<range:int,data:binary,n:binary>>"
SIGNED_DDL = f"_at {AT}, doc_id long, digest binary, bands array<long>, df binary"


def _added_up(table: pa.Table) -> pa.Table:
    """For each list of a range, the documents of all blocks that have each of its shingles."""
    parts = [np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table["data"]]
    h, n = np.concatenate(parts), np.concatenate([_unpacked(x.as_py(), np.uint32) for x in table["n"]])
    ends = np.cumsum([len(p) for p in parts])
    del parts
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    df = np.empty(len(h), np.uint32)
    df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(first, append=len(h)))
    told = [_packed(d) for d in np.split(df, ends[:-1])]
    del h, n, order, first, df
    hand_back()
    return pa.table({"block_id": table["block_id"], "range": table["range"], "df": pa.array(told, pa.binary())})


def _signer(w: Weights, bands: int, rows: int):
    sampler = Sampler(bands * rows, w.rare)

    def sign(words: bytes, h: np.ndarray, n: np.ndarray, df: bytes | None) -> tuple[bytes, np.ndarray]:
        return hashlib.sha256(words).digest()[:16], _band_keys(sampler.draw(h, w.of(h, n, df)), bands) if len(h) else np.zeros(0, np.int64)

    return sign


def _signatures(at: pa.Array, ids: pa.Array, signed: list[tuple], df: list[bytes | None]) -> pa.RecordBatch:
    digests, keys = [s[0] for s in signed], [s[1] for s in signed]
    return pa.record_batch(
        [at, ids, pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(df, pa.binary())], names=["_at", "doc_id", "digest", "bands", "df"]
    )


def _signed(weighing, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _signer(weighing.value, bands, rows)
        for b in batches:
            signed = [sign(b" ".join(words), *shingles(words), None) for words in map(_words, b.column("text"))]
            yield _signatures(b.column("_at"), b.column("doc_id"), signed, [None] * b.num_rows)

    return run


def _signed_blocks(weighing, bands: int, rows: int, n_ranges: int):
    """Blocks with the answers to their lists to documents with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _signer(weighing.value, bands, rows)
        for b in batches:
            for i in range(b.num_rows):
                raw = zstandard.ZstdDecompressor().decompress(b.column("texts")[i].as_py())
                ends = np.cumsum(b.column("lengths")[i].values.to_numpy()).tolist()
                places = [slice(a, z) for a, z in zip([0, *ends], ends)]
                sets = [shingles(raw[p].split()) for p in places]
                h = np.unique(np.concatenate([x for x, _ in sets]))
                cuts = [0, *_ranges(h, 64, n_ranges), len(h)]
                df = np.zeros(len(h), np.uint32)
                for x in b.column("told")[i].as_py() or []:
                    df[cuts[x["range"]] : cuts[x["range"] + 1]] = _unpacked(x["df"], np.uint32)
                if not df.all():
                    raise ValueError("a list of shingles was left without an answer")
                each = [_packed(df[np.searchsorted(h, x)]) for x, _ in sets]
                yield _signatures(b.column("at")[i].values, b.column("ids")[i].values, [sign(raw[p], *s, d) for p, s, d in zip(places, sets, each)], each)

    return run


def _exact(base: DataFrame, scratch: Scratch, bands: int, rows: int, most_shingles: int, most_docs: int, range_shingles: int) -> tuple[Weights, DataFrame]:
    """Weights and signatures by exact frequencies of all shingles."""
    spark = base.sparkSession
    total, size = base.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    n = max(partitions(spark), (size or 0) // 6 // range_shingles)
    blocks = scratch.table(base.mapInArrow(lean(_blocks(n, most_shingles, most_docs)), BLOCK_DDL), "blocks")
    lists = blocks.select("block_id", F.explode("lists").alias("x")).select("block_id", "x.range", "x.data", "x.n")
    answers = scratch.table(lists.groupBy("range").applyInArrow(_added_up, "block_id long, range int, df binary"), "frequencies")
    # a task gets about one block: all that it gets may come to Python at once
    n_blocks = max(1, blocks.count())
    told = answers.repartition(n_blocks, "block_id").groupBy("block_id").agg(F.collect_list(F.struct("range", "df")).alias("told"))
    w = Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), total, 0.0)
    asked = blocks.drop("lists").repartition(n_blocks, "block_id").join(told, "block_id", "left")
    signed = asked.mapInArrow(lean(_signed_blocks(spark.sparkContext.broadcast(w), bands, rows, n)), SIGNED_DDL)
    return w, signed


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of sorted hashes with weights; 0 for two empty texts."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][i], y[1][j]).sum()
    either = x[1].sum() + y[1].sum() - both
    return float(both / either) if either else 0.0


def _verified(weighing, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, recent = weighing.value, OrderedDict()

        def weighed(rid: int, text, df) -> tuple[np.ndarray, np.ndarray]:
            if rid not in recent:
                h, n = shingles(_words(text))
                recent[rid] = (h, w.of(h, n, df.as_py()))
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(rid)
            return recent[rid]

        for batch in batches:
            ids = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), *(batch.column(c) for c in ("text_a", "df_a", "text_b", "df_b")))
            kept = [(a, b, s) for a, b, x, df_x, y, df_y in ids if (s := similarity(weighed(a, x, df_x), weighed(b, y, df_y))) >= least]
            if kept:
                yield pa.record_batch([pa.array(c) for c in zip(*kept)], names=["a", "b", "similarity"])

    return run


def _rest_of_buckets(found: DataFrame, centres: DataFrame, single: DataFrame, texts: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Blocks of documents that share a band and that no centre has joined, two blocks to a group (key, i, j), sorted by it.

    A bucket's centres have met all others before. Documents of its largest class are in blocks of
    their own, which meet all blocks of the others but not each other.
    """
    apart = found.join(centres, "key").filter("rep != one.rep and rep != two.rep").select("rep", "key", "class")
    apart = scratch.table(apart, "not-centres")
    sizes = apart.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "class")).alias("main"), F.sum("n").alias("all"))
    # stored sums, as above
    split = scratch.table(sizes.filter("all > main.n").select("key", F.col("main.class").alias("main"), F.ceil(F.col("main.n") / block).alias("mains"), F.ceil((F.col("all") - F.col("main.n")) / block).alias("others")), "split")
    is_main = F.col("class") == F.col("main")
    own = F.when(is_main, -1 - F.pmod(F.xxhash64("rep"), "mains")).otherwise(F.pmod(F.xxhash64("rep"), "others"))
    met = F.sequence(F.when(is_main, F.lit(0)).otherwise(-F.col("mains")), F.col("others") - 1)
    rows = apart.join(split, "key").select("rep", "key", "class", own.alias("own"), met.alias("met"))
    rows = rows.select("rep", "key", "class", "own", F.explode("met").alias("with"))
    rows = rows.select("rep", "key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") <= F.col("with")).alias("first"), "class")
    # sort-merge joins, as in links
    rows = rows.join(single.select("rep", "bands").hint("merge"), "rep").join(texts.hint("merge"), "rep")
    group = ["key", "i", "j"]
    return rows.select(*group, "rep", "class", "first", "bands", "text", "df").repartition(*group).sortWithinPartitions(*group)


def _compared(weighing, least: float):
    """Links between documents of different classes, for groups as _rest_of_buckets gives them.

    Each pair is compared in the first band that it shares; one that links of its group have joined needs no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, recent, held = weighing.value, OrderedDict(), 0

        def weighed(rep: int, text, df) -> tuple[np.ndarray, np.ndarray, float]:
            nonlocal held
            if rep not in recent:
                h, n = shingles(_words(text))
                weight = w.of(h, n, df.as_py())
                recent[rep] = (h, weight, float(weight.sum()))
                held += len(h)
                while held > MOST_HELD and len(recent) > 1:
                    held -= len(recent.popitem(last=False)[1][0])
            recent.move_to_end(rep)
            return recent[rep]

        def links(key: int, i: int, j: int, rows: list[tuple]) -> list[tuple[int, int]]:
            xs, ys = [r for r in rows if r[2]], [r for r in rows if not r[2]]
            if i == j:
                ys = xs
            if not ys:
                return []
            out, up = [], {}

            def top(c: int) -> int:
                while c in up:
                    c = up[c]
                return c

            first = len(xs) > len(ys)
            few, many = (ys, xs) if first else (xs, ys)
            known = [weighed(r[0], r[4], r[5]) for r in many]
            total = np.array([k[2] for k in known])
            bands, classes_ = np.stack([r[3] for r in many]), np.array([r[1] for r in many])
            band = int(np.flatnonzero(bands[0] == key)[0])
            for at, (rep, own, _, of, text, df) in enumerate(few):
                h, weight, mine = weighed(rep, text, df)
                # similarity is the smaller sum of weights over the larger one at most
                near = (classes_ != own) & (np.minimum(total, mine) >= (least - 1e-9) * np.maximum(total, mine))
                near &= ~(bands[:, :band] == of[:band]).any(1)
                if i == j:
                    near[: at + 1] = False
                for k in np.flatnonzero(near):
                    x, y = top(own), top(many[k][1])
                    if x != y and similarity((h, weight), known[k][:2]) >= least:
                        out.append((min(rep, many[k][0]), max(rep, many[k][0])))
                        up[x] = y
            return out

        def all_links() -> Iterator[list[tuple[int, int]]]:
            group, rows = None, []
            for b in batches:
                ids = zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "rep", "class", "first", "bands")), b.column("text"), b.column("df"))
                for key, i, j, rep, own, first, bands, text, df in ids:
                    if group != (key, i, j):
                        if group:
                            yield links(*group, rows)
                        group, rows = (key, i, j), []
                    rows.append((rep, own, first, np.array(bands, np.int64), text, df))
            if group:
                yield links(*group, rows)

        for found in all_links():
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


def classes(
    docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, floor: float = FLOOR,
    most_shingles: int = HELD_SHINGLES, most_docs: int = HELD_DOCS, range_shingles: int = RANGE_SHINGLES,
) -> DataFrame:
    """One row per document: _at (its place), doc_id, class_id, class_size, kept.

    class_id is the smallest doc_id of the class, and its row stays (of repeated rows one; a null
    doc_id is the largest). docs has doc_id and text; other columns are ignored.
    Rows with equal words are one class; null and empty texts are equal. Texts of fewer than five words
    are one shingle. An empty table gives no rows. Groups of equal texts are compared once, by one row.
    Document frequencies are counted over all rows, repeated ones too. With floor 0 all are exact; else
    those of shingles in a smaller share of the rows are taken as that share.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = rooted(scratch, docs)
    base = docs.select(place(docs).alias("_at"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if floor:
        w = weights(base, scratch, floor)
        signed = base.mapInArrow(lean(_signed(spark.sparkContext.broadcast(w), bands, rows)), SIGNED_DDL)
    else:
        w, signed = _exact(base, scratch, bands, rows, most_shingles, most_docs, range_shingles)
    weighing = spark.sparkContext.broadcast(w)
    signed = scratch.table(row_ids(signed), "signed")
    scratch.drop("blocks", "frequencies")
    first = scratch.table(signed.groupBy("digest").agg(F.min("_rid").alias("rep"), F.count(F.lit(1)).alias("copies")), "first")
    single = scratch.table(signed.join(first.select("rep", "copies"), F.col("_rid") == F.col("rep")).select("rep", "_at", "copies", "bands", "df"), "single")
    alone = single.select("rep", "copies", F.explode("bands").alias("key"))
    # stored sums, so that joins with them can split a frequent key
    crowded = scratch.table(alone.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "crowded")
    shared = scratch.table(alone.join(crowded, "key"), "shared")
    # a document in large buckets is likely in the middle of its group
    weight = shared.groupBy("rep").agg(F.sum("n").alias("crowd"))
    placed = scratch.table(shared.join(weight, "rep").select("rep", "key", "crowd", "copies"), "placed")
    centres = placed.groupBy("key").agg(
        F.max(F.struct("crowd", "rep")).alias("one"), F.max(F.struct(F.xxhash64("rep", "key").alias("x"), "rep")).alias("two")
    )
    centres = scratch.table(centres, "centres")
    paired = scratch.table(placed.join(centres, "key").select("rep", "one", F.col("two.rep").alias("two")), "paired")

    def ordered(a: str, b: str):
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    # sort-merge joins at every size: what moves grows in proportion, and a centre's rows can be split
    wanted = scratch.table(single.select("rep", "_at", "df").join(paired.select("rep").distinct(), "rep", "left_semi"), "wanted")
    texts = scratch.table(base.select("_at", "text").join(wanted.hint("merge"), "_at").select("rep", "text", "df"), "texts")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        a, b = (texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"), F.col("df").alias(f"df_{x}")) for x in "ab")
        return scratch.table(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "text_a", "df_a", "text_b", "df_b").mapInArrow(lean(_verified(weighing, least)), "a long, b long, similarity double"), name)

    likely = paired.filter("rep != one.rep").groupBy("rep").agg(F.max("one").alias("one")).select(*ordered("rep", "one.rep")).distinct()
    near = components(links(likely, "links1"), scratch, "near")
    x, y = near.select(F.col("node").alias("a"), F.col("root").alias("x")), near.select(F.col("node").alias("b"), F.col("root").alias("y"))
    rest = paired.select(F.explode(F.array(F.struct(*ordered("rep", "one.rep")), F.struct(*ordered("rep", "two")))).alias("p")).select("p.a", "p.b").filter("a != b").distinct()
    rest = rest.join(x, "a", "left").join(y, "b", "left").filter("coalesce(x, a) != coalesce(y, b)").select("a", "b")
    more = links(scratch.table(rest, "rest"), "links2").select("a", "b")
    both = scratch.table(near.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more), "links12")
    roots = components(both, scratch, "second")
    found = placed.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "key", F.coalesce("root", "rep").alias("class"))
    last_links = scratch.table(_rest_of_buckets(found, centres, single, texts, scratch).mapInArrow(lean(_compared(weighing, least)), "a long, b long"), "links3")
    roots = components(both.unionByName(last_links), scratch, "all")
    first = scratch.table(first.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("root", "rep").alias("class")), "first-classes")
    named = scratch.table(spread_join(signed.select("digest", "_rid", "_at", "doc_id"), first, ["digest"], "copies").drop("digest"), "named-rows")
    last = F.lit((1 << 63) - 1)
    sums = named.groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("d"), "_rid")).alias("keep"), F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    sums = scratch.table(sums.withColumn("_n", F.col("class_size")), "classes")
    return spread_join(named, sums, ["class"], "_n").select("_at", "doc_id", "class_id", "class_size", (F.col("_rid") == F.col("keep._rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY, floor: float = 0) -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns; by exact frequencies unless there is a floor."""
    scratch = Scratch(docs.sparkSession, "neardup-kept")
    docs = rooted(scratch, docs)
    return pick_rows(docs, classes(docs, least, floor=floor).filter("kept"))
