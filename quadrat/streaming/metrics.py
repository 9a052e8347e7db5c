"""Running statistics over metric files as runs write them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import parse_run


def running_means(metrics: DataFrame, metric: str = "map50") -> DataFrame:
    """Mean and deviation of each kind, detector, generator and ratio over the seeds seen so far.

    Works on a stream (in complete or update mode; state has a row per condition) and on a table.
    """
    rows = metrics.withColumn("_r", parse_run(F.col("run_name"))).filter("_r.kind is not null").select(metric, "_r.*")
    return rows.groupBy("kind", "detector", "generator", "pct").agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std_pop"))
