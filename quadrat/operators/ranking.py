"""Orders without a task that sees all rows: drawn by digests, or within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch

#: A draw has 32 bits; slices of the draw share rows out evenly.
SLICE_BITS, FINE_BITS = 12, 16


def dense_index(df: DataFrame, drawn: Column, ties: list[str], name: str) -> DataFrame:
    """df with name: places from 0 in the order of drawn (32 bits) and ties.

    Rows are numbered within slices of the draw; only the slices' counts are added up.
    """
    rows = df.withColumn("_d", drawn).withColumn("_s", F.shiftright("_d", 32 - SLICE_BITS))
    counts = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4096 rows
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_d", *ties))
    return rows.withColumn("_r", rank).join(counts.select("_s", before.alias("_b")), "_s").withColumn(name, F.col("_b") + F.col("_r") - 1).drop("_s", "_d", "_r", "_b")


def first_rows(df: DataFrame, drawn: Column, ties: list[str], n: int) -> DataFrame:
    """The n first rows in the order of drawn (32 bits) and ties.

    Counts by slice of the draw tell the slice in which the n-th row lies; all before it are taken, and of it
    alone the first rows, a few ten-thousandths of all.
    """
    if n <= 0:
        return df.limit(0)
    rows = df.withColumn("_d", drawn).withColumn("_s", F.shiftright("_d", 32 - FINE_BITS))
    counts = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("_s")))  # 65,536 rows
    last = upto.filter(F.col("upto") >= n).orderBy("_s").limit(1).collect()
    if not last:
        return df
    cut, rest = last[0]["_s"], n - (last[0]["upto"] - last[0]["c"])
    part = rows.filter(F.col("_s") == cut).orderBy("_d", *ties).limit(rest)
    return rows.filter(F.col("_s") < cut).unionByName(part).drop("_s", "_d")


def first_in_groups(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The n first rows of each group. Spark takes the first n of each task before it shuffles, so that a hot group is a few rows."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def rank_within(scratch: Scratch, df: DataFrame, group: list[str], order: list[Column], name: str, label: str = "ranked") -> DataFrame:
    """Row number from 1 within each group, whatever the group's size.

    Rows are range-partitioned by group and order, so that a hot group spreads over many tasks;
    each task numbers its own rows, and only counts by task and group are added up.
    Nulls form a group, last. Writes one scratch table.
    """
    keys = [F.col(g).asc_nulls_last() for g in group] + order
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.table(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), label)
    task = F.shiftright("_m", 33)
    parts = placed.groupBy(task.alias("_task"), *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    # one row per task and group: no more rows of a group than tasks
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.select("_task", "_first", "_before", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    match = F.col("_t") == F.col("_task")
    for i, g in enumerate(group):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.withColumn("_t", task).join(parts, match)
    out = [c for c in placed.columns if c != "_m"]
    return joined.select(*out, (F.col("_m") - F.col("_first") + F.col("_before") + 1).alias(name))
