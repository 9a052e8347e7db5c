"""Distributions of objects and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import draw
from ..storage import Scratch
from .ranking import first_in_groups, rank_within


def quantiles(df: DataFrame, group: str, value: str, levels: list[float]) -> DataFrame:
    """group ('all' for the whole), n, share, median and exact quantiles, linear between values."""
    at = F.array(*[F.lit(float(x)) for x in levels])
    rows = df.withColumn("_g", F.explode(F.array(F.lit("all"), F.col(group).cast("string"))))
    out = rows.groupBy(F.col("_g").alias(group)).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, at).alias("q"))
    total = F.sum(F.when(F.col(group) == "all", F.col("n"))).over(Window.partitionBy())
    return out.withColumn("share", F.col("n") / total)


def bands(df: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """keys, stat, n, p10, p50, p90 of each column of stats."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in stats])).alias("x")).select(*keys, "x.*")
    return long.groupBy(*keys, "stat").agg(F.count("v").alias("n"), *(F.percentile("v", F.lit(p / 100)).alias(f"p{p}") for p in (10, 50, 90)))


def against_reference(band: DataFrame, reference: Column, key: str) -> DataFrame:
    """Each pool's gap to the reference pool's median, whether it is beyond a fifth, and whether it lies in the band."""
    real = band.filter(reference).select("stat", F.col("p10").alias("r10"), F.col("p50").alias("r50"), F.col("p90").alias("r90"))
    rows = band.filter(~reference).join(real, "stat")
    gap = F.try_divide(F.col("p50") - F.col("r50"), F.abs("r50"))
    return rows.select(key, "stat", "n", gap.alias("gap"), (F.abs(gap) > 0.2).alias("off"), F.col("p50").between(F.col("r10"), F.col("r90")).alias("in_band"))


def gate(df: DataFrame, ok: Column, group: list[str]) -> DataFrame:
    """Rows that are ok; of a group where none is, all."""
    some = F.count_if(ok).over(Window.partitionBy(*group))
    return df.withColumn("_n", some).filter(ok | (F.col("_n") == 0)).drop("_n")


def judged(df: DataFrame, score: str, least: float) -> DataFrame:
    """df with passed: whether its score is there and at least so high. Both parts are filters of one scan."""
    return df.withColumn("passed", F.coalesce(F.col(score) >= least, F.lit(False)))


def gate_or_fail(df: DataFrame, ok: Column, what: str = "rows") -> DataFrame:
    """Rows that are ok; none at all is an error, as a next step would have nothing to go on."""
    kept = df.filter(ok)
    if not kept.limit(1).count():
        raise ValueError(f"all {what} were rejected")
    return kept


def scored_sample(df: DataFrame, pool: str, key: str, score: str, n: int, seed: int = 0) -> DataFrame:
    """pool, n_images, n_scored, mean and population deviation (0 for one) of the scores of n members of each pool, drawn by digests."""
    drawn = df.withColumn("_d", draw(F.lit(str(seed)), F.col(key).cast("string")))
    some = first_in_groups(drawn, [pool], ["_d", key], n).groupBy(pool).agg(F.count(score).alias("n_scored"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return df.groupBy(pool).agg(F.count(F.lit(1)).alias("n_images")).join(some, pool)


def spread(df: DataFrame, value: str) -> DataFrame:
    """n, least, middle (the upper one of two) and largest of a column, by counts of its values' ranks rather than a list of them."""
    scratch = Scratch(df.sparkSession, "spread")
    ranked = scratch.table(rank_within(scratch, df.select(F.lit(0).alias("_all"), F.col(value).alias("v")).filter("v is not null"), ["_all"], [F.col("v").asc()], "r"), "values")
    n = ranked.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("largest"))
    return ranked.join(F.broadcast(n), F.col("r") == F.floor(F.col("n") / 2) + 1).select("n", "least", F.col("v").alias("middle"), "largest")  # one row


def mosaic_gains(members: DataFrame, scene: list[str], low: float = 0.9, high: float = 1.1) -> DataFrame:
    """members (scene, member, mean, sd) with shift and gain that bring them to their scene's medians; gains stay within bounds."""
    w = Window.partitionBy(*scene)
    mid = {c: F.median(c).over(w) for c in ("mean", "sd")}
    gain = F.greatest(F.lit(low), F.least(F.lit(high), mid["sd"] / (F.col("sd") + 1e-6)))
    return members.withColumns({"gain": gain, "to_mean": mid["mean"]}).withColumn("shift", F.col("to_mean") - F.col("mean") * F.col("gain")).drop("to_mean")


def best_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= k)


def upper_middle(values: Column) -> Column:
    """The middle element of an array in order, the upper one of two; not the median."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that fails, 'kept' if none does."""
    out = None
    for name, passed in checks:
        out = F.when(~passed, name) if out is None else out.when(~passed, name)
    return out.otherwise("kept")
