"""Exact duplicates by deterministic block naming.

Every text, lower-cased in A-Z, is cut into blocks of fixed size. The distinct blocks are sorted
and their places are their integer names; then adjacent names are paired, the distinct pairs are
sorted and named in the same way, and so on until each text has one name. Equal names mean equal
texts: a name stands for one block or one pair, never for a hash.

Blocks sort by a 64-bit hash first and by content among equal hashes, so that only one shuffle
moves content; where a hash has several contents, the blocks are named by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AT, Scratch, lean, partitions, pick_rows, place, rooted, row_ids, spread_join

BLOCK_BYTES = 4096


def _cut(text: bytes, size: int) -> list[bytes]:
    """At least one block; the last one may be shorter."""
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def _hash(block: bytes, bits: int) -> int:
    return (xxhash.xxh3_64_intdigest(block) >> (64 - bits)) - (1 << (bits - 1) if bits == 64 else 0)


def _summaries(block: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shas, names = [], []
            for text in b.column("text"):
                raw = (text.as_py() or "").encode().lower()  # bytes.lower() changes A-Z only
                shas.append(hashlib.sha256(raw).hexdigest())
                names.append([_hash(x, bits) for x in _cut(raw, block)])
            yield pa.record_batch(
                [b.column("_at"), b.column("doc_id"), pa.array(shas, pa.string()), pa.array(names, pa.list_(pa.int64()))],
                names=["_at", "doc_id", "text_sha256", "names"],
            )

    return run


def _blocks(block: int, bits: int, out_bytes: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, hashes, blocks, held = [], [], [], [], 0

            def batch() -> pa.RecordBatch:
                return pa.record_batch(
                    [b.column("_at").take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(hashes, pa.int64()), pa.array(blocks, pa.binary())],
                    names=["_at", "place", "h", "block"],
                )

            for row, text in enumerate(b.column("text")):
                for place_, x in enumerate(_cut((text.as_py() or "").encode().lower(), block)):
                    rows.append(row)
                    places.append(place_)
                    hashes.append(_hash(x, bits))
                    blocks.append(x)
                    held += len(x)
                    if held >= out_bytes:
                        yield batch()
                        rows, places, hashes, blocks, held = [], [], [], [], 0
            if rows:
                yield batch()

    return run


def _named(scratch: Scratch, keys: DataFrame, columns: list[str], base: int, name: str) -> tuple[DataFrame, int]:
    """Sort distinct keys over the cluster and store each with its integer name; also the next free name."""
    n = partitions(scratch.spark)
    out = scratch.table(
        keys.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id() + F.lit(base)), name
    )
    top = out.agg(F.max("name")).first()[0]
    return out, base if top is None else top + 1


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """_rid, _at, doc_id, text_sha256 and identity of every row; equal identities if and only if equal texts.

    docs has doc_id and text. hash_bits below 64 is for tests of clashing hashes.
    A null text counts as empty. The work for a text of n blocks is that of n log n names.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exactdup")
    docs = rooted(scratch, docs)
    base = docs.select(place(docs).alias("_at"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = scratch.table(row_ids(base.mapInArrow(lean(_summaries(block_bytes, hash_bits)), f"_at {AT}, doc_id long, text_sha256 string, names array<long>")), "summary")
    cut = base.select("_at", "text").mapInArrow(lean(_blocks(block_bytes, hash_bits)), f"_at {AT}, place int, h long, block binary")
    contents = cut.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("n"))
    names, free = _named(scratch, contents, ["h"], 0, "names-blocks")
    placed = summary.select("_rid", F.posexplode("names").alias("place", "h"))
    sole = spread_join(placed, names.filter("contents = 1").select("h", "name", "n"), ["h"], "n").select("_rid", "place", "name")
    clashing = names.filter("contents > 1").select("h")
    if clashing.limit(1).count():
        among = cut.join(clashing, "h", "left_semi")
        told, free = _named(scratch, among.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n")), ["h", "block"], free, "names-clashing")
        among = among.join(told.select("h", "block", "name"), ["h", "block"]).select("_at", "place", "name")
        sole = sole.unionByName(among.join(summary.select("_at", "_rid"), "_at").select("_rid", "place", "name"))

    def gathered(placed: DataFrame) -> DataFrame:
        """A row's names in order; as many as its blocks."""
        rows = placed.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("x"))
        return rows.select("_rid", F.col("x.name").alias("names"))

    level = scratch.table(gathered(sole), "level0")
    longest = summary.agg(F.max(F.size("names"))).first()[0] or 1
    done = [level.filter(F.size("names") == 1)]
    k = 0
    while longest > 1:
        k += 1
        pairs = level.filter(F.size("names") > 1).select(
            "_rid",
            F.posexplode(
                F.expr("transform(sequence(0, (size(names) - 1) div 2), i -> struct(names[2 * i] as a, if(2 * i + 1 < size(names), names[2 * i + 1], -1L) as b))")
            ).alias("place", "p"),
        ).select("_rid", "place", "p.a", "p.b")
        told, free = _named(scratch, pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"], free, f"names{k}")
        level = scratch.table(gathered(spread_join(pairs, told, ["a", "b"], "n").select("_rid", "place", "name")), f"level{k}")
        done.append(level.filter(F.size("names") == 1))
        longest = (longest + 1) // 2
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = found.select("_rid", F.col("names")[0].alias("identity"))
    return summary.select("_rid", "_at", "doc_id", "text_sha256").join(found, "_rid")


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row per document: _at (its place), doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; a null doc_id is the smallest, and of
    repeated rows with one doc_id exactly one stays. An empty table gives no rows; columns other than
    doc_id and text are ignored. A group of any size is only counted, never gathered.
    """
    scratch = Scratch(docs.sparkSession, "exactdup")
    found = scratch.table(identities(docs, block_bytes, hash_bits, scratch), "identities")
    keep = found.groupBy("identity").agg(F.max(F.struct("doc_id", "_rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    keep = scratch.table(keep.withColumn("n", F.col("group_size")), "groups")
    return spread_join(found, keep, ["identity"], "n").select(
        "_at",
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_rid") == F.col("keep._rid")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "exactdup-kept")
    docs = rooted(scratch, docs)
    return pick_rows(docs, groups(docs).filter("kept"))
