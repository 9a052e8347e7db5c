"""Mixing sources to target weights by systematic sampling, with DataFrame functions alone.

A document of a source with target t and size s is expected t / s times. Within the source, the
expected copies are summed up in the order of document size; one offset drawn for the source is
added, and a document is taken once for each integer that its sum crosses. So the number of copies
of any stretch of documents differs from what is expected by less than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, place, rank_within, rooted

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def _dec(x: int | Column) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)") if isinstance(x, int) else x.cast("decimal(38,0)")


def targets(scratch: Scratch, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size and target of each source.

    Sources in code-point order, null last, weigh weights, repeated. A target stops at most times
    its source's size; the excess is shared anew by weight until no target is above. Each round is
    one aggregation over the sources; the driver holds three numbers.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    one = totals.withColumn("_one", F.lit(1))
    ranked = rank_within(scratch, one, ["_one"], [F.col("source").asc_nulls_last()], "rank", "sources-ranked")
    ranked = scratch.table(
        ranked.select("source", "source_size", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long").alias("w")), "sources"
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rest, shares, capped = total, ranked.agg(F.sum("w")).first()[0] or 0, -1
    cap = F.col("source_size") * most
    while True:
        above = _dec(F.col("w")) * _dec(rest) > _dec(cap) * _dec(shares)
        n, stopped, free = ranked.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("w")))).first()
        if n == capped or not free:
            break
        capped, rest, shares = n, total - (stopped or 0), free
    target = F.when(above, cap.cast("double")).otherwise((F.col("w") * F.lit(rest)).cast("double") / F.lit(float(shares or 1)))
    return ranked.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per document: _at (its place), doc_id, size, source_size, target, copies, taken.

    docs has doc_id, text and source; other columns are ignored. A null text
    has size 0; null is a source of its own. Equal documents are told apart by their places, so that
    reruns agree. An empty table gives no rows; a source without words has target 0 and gives none.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = rooted(scratch, docs)
    base = docs.select(place(docs).alias("_at"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sizes = scratch.table(
        base.select("_at", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes"
    )
    goal = targets(scratch, sizes, weights, most)
    order = [F.col("size").asc(), F.md5(F.col("doc_id").cast("string")).asc_nulls_first(), F.col("_at").asc()]
    ranked = rank_within(scratch, sizes, ["source"], order, "rank", "documents-ranked")
    named = goal.withColumnRenamed("source", "_s")
    joined = ranked.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # hexadecimal digits of a digest give the source's offset, a multiple of 2**-20
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))), 1, 5), 16, 10)
    offset = drawn.cast("double") / F.lit(1048576.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(rate * F.col("rank") + offset) - F.floor(rate * (F.col("rank") - 1) + offset)
    copies = F.least(crossed, F.lit(most).cast("long"))  # rounding may add one where the rate is the most
    return joined.select("_at", "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mixed corpus: docs' rows with all their columns, each as often as the plan says."""
    docs = rooted(Scratch(docs.sparkSession, "mixing-given"), docs)
    at, n = fresh(docs, "_at"), fresh(docs, "_copies")
    taken = plan(docs, seed, weights, most).filter("copies > 0").select(F.col("_at").alias(at), F.col("copies").alias(n))
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(fresh(docs, "_copy"))
    return docs.select("*", place(docs).alias(at)).join(taken, at).select(*docs.columns, repeated).select(*docs.columns)
