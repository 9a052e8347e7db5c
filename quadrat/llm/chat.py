"""Preference formatting: a shared prompt, rendered once, and two completions with training masks.

A pair's prompt is the longest run of turns, from the first, that chosen and rejected share. Pairs are
found and cut on rows of turns; at the end a pair is one row with its prompt, both completions and
their masks. One of very many turns is a row for each SEGMENT of them, so that no task gathers it whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, rank_within, row_ids

TRAINED_ROLE = "assistant"
NO_ROLE = "unknown"
#: Turns of a pair that make up a row, at most.
SEGMENT = 256


def render(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """A turn as text, and where in it the content begins and ends (code points)."""
    head = F.concat(F.lit("<|"), F.coalesce(role, F.lit(NO_ROLE)), F.lit("|>\n"))
    content = F.coalesce(text, F.lit(""))
    return F.concat(head, content, F.lit("<|end|>\n")), F.length(head), F.length(head) + F.length(content)


def numbered(scratch: Scratch, turns: DataFrame, label: str) -> DataFrame:
    """Turns of each conversation numbered from 1 by turn (null last); ties by role, text and place."""
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last(), F.col("_rid").asc()]
    return rank_within(scratch, row_ids(turns), ["conv_id"], order, "no", label).drop("_rid")


def turn_rows(sides: DataFrame) -> DataFrame:
    """Rows of a preference dataset by turn, from sides: pair_id, side ('chosen', 'rejected' or 'rest'), no (from 1), role, text.

    Returns pair_id, part ('prompt', 'chosen', 'rejected', 'rest'), no, role, rendered, train_from, train_to:
    the turns in order of no make up a part, and a completion's assistant content is trained on
    (train_from < train_to), all else is masked. A prompt's turns are given once. Null text is empty,
    a null role is 'unknown'; turns are alike if role and text are, nulls as their own value. Equal
    sides have a prompt alone; with a side missing, all turns are a completion. What belongs to neither
    side is the rest.
    """
    same = F.sha2(F.to_json(F.struct("role", "text")), 256)
    places = sides.filter("side != 'rest'").groupBy("pair_id", "no").agg(F.count_distinct("side").alias("n"), F.min(same).alias("x"), F.max(same).alias("y"))
    differs = places.groupBy("pair_id").agg(F.min(F.when((F.col("n") < 2) | (F.col("x") != F.col("y")), F.col("no"))).alias("first"))
    rows = sides.join(differs.withColumnRenamed("pair_id", "_p"), F.col("pair_id").eqNullSafe(F.col("_p")), "left").drop("_p")
    rest = F.col("side") == "rest"
    shared = ~rest & (F.col("first").isNull() | (F.col("no") < F.col("first")))
    text, start, end = render(F.col("role"), F.col("text"))
    trained = ~rest & ~shared & F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))
    rows = rows.filter(~shared | (F.col("side") == "chosen"))
    return rows.select(
        "pair_id",
        F.when(shared, "prompt").otherwise(F.col("side")).alias("part"),
        "no",
        "role",
        text.alias("rendered"),
        F.when(trained, start).otherwise(0).alias("train_from"),
        F.when(trained, end).otherwise(0).alias("train_to"),
    )


def format_pairs(sides: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per pair: pair_id, segment, prompt, chosen, rejected, rest, chosen_train, rejected_train.

    sides and their parts are those of turn_rows; a part without turns is ''. The masks list the spans
    (code points of the completion beside them, end exclusive) that are trained on. A pair of more than
    segment turns has a row for each segment of them, from 0, and its texts are those of its rows in turn.
    An empty table gives no rows.
    """
    rows = turn_rows(sides).withColumn("segment", F.floor((F.col("no") - 1) / segment).cast("int"))
    before = Window.partitionBy("pair_id", "part", "segment").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)).cast("int"))

    def text(part: str) -> Column:
        turns = F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("no", "rendered"))))
        return F.array_join(turns["rendered"], "").alias(part)

    def mask(part: str) -> Column:
        span = F.struct((F.col("at") + F.col("train_from")).alias("from"), (F.col("at") + F.col("train_to")).alias("to"))
        return F.array_sort(F.collect_list(F.when((F.col("part") == part) & (F.col("train_to") > F.col("train_from")), span))).alias(f"{part}_train")

    return rows.groupBy("pair_id", "segment").agg(*map(text, ("prompt", "chosen", "rejected", "rest")), *map(mask, ("chosen", "rejected")))


def shown(mask: str) -> Column:
    """A mask as text: from:to, comma-joined."""
    return F.array_join(F.transform(mask, lambda x: F.concat_ws(":", x["from"], x["to"])), ",").alias(mask)


def batch_negatives(turns: DataFrame) -> DataFrame:
    """Sides of a preference dataset from plain conversations (conv_id of any type, turn, role, text).

    Chosen is a conversation up to its last assistant turn, rejected the same with that turn's text
    from the next conversation in the order of a digest of conv_id (the last one takes the first's).
    Turns after that, and all turns of a conversation without an assistant turn, are the rest. Turns go
    by turn (null last), repeated ones by role and text. A null conv_id is a conversation of its own.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = scratch.table(numbered(scratch, plain, "turns-ranked"), "turns")
    last = rows.filter(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max("no").alias("last"))
    last = scratch.table(rank_within(scratch, last.withColumn("_one", F.lit(1)), ["_one"], [F.md5(F.col("conv_id").cast("string")).asc_nulls_first(), F.col("conv_id").asc_nulls_first()], "rank", "last-ranked"), "last")
    own = last.select(F.col("conv_id").alias("_c"), "last", "rank")
    rows = scratch.table(rows.join(own, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(F.col("conv_id").alias("pair_id"), "no", "role", "text", "last", "rank"), "cut")
    n = last.count()
    final = rows.filter("no = last").select((F.when(F.col("rank") == 1, F.lit(n)).otherwise(F.col("rank") - 1)).alias("rank"), F.col("text").alias("_other"))

    def side(name: str, some: DataFrame, text: str = "text") -> DataFrame:
        return some.select("pair_id", F.lit(name).alias("side"), "no", "role", F.col(text).alias("text"))

    sides = [side("chosen", rows.filter("no <= last")), side("rejected", rows.filter("no < last")), side("rejected", rows.filter("no = last").join(final, "rank"), "_other"), side("rest", rows.filter("last is null or no > last"))]
    return reduce(DataFrame.unionByName, sides)
