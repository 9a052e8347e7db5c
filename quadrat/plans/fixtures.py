"""Detection tables derived from the test tables, by integer arithmetic that any engine repeats.

SQL has the same views as common table expressions, for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import CLASSES

UNIT = ["seed", "tile_id"]
CELL = [*UNIT, "cls"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cents", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    long = "bigint"
    return li.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_shipdate",
        "l_linestatus",
        "l_returnflag",
        "l_tax",
        "l_discount",
        F.round(F.col("l_extendedprice") * 100).cast(long).alias("cents"),
        F.floor(F.col("l_orderkey") / 30).cast(long).alias("tile_id"),
        (F.col("l_linenumber") % 5).cast("int").alias("cls0"),
        ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber") * 101) % 1200).cast(long).alias("x"),
        ((F.col("l_partkey") * 53 + F.col("l_suppkey") * 29 + F.col("l_linenumber") * 67) % 1200).cast(long).alias("y"),
        (24 + F.col("l_quantity").cast(long) * 4).alias("w"),
        (24 + (F.col("l_partkey") % 50) * 4).cast(long).alias("h"),
    )


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).filter("l_linestatus = 'O'")
    return rows.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))


def gt_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed, tile_id, cls, gid, x1, y1, x2, y2: true boxes, the same for every seed."""
    number = F.row_number().over(Window.partitionBy("tile_id", "cls0").orderBy(*KEY))
    rows = _boxes(spark, sf_dir).filter("l_linestatus = 'O'").withColumn("gid", number).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select(*UNIT, F.col("cls0").alias("cls"), "gid", *(F.col(c).cast("double").alias(n) for c, n in (("x", "x1"), ("y", "y1"))), (F.col("x") + F.col("w")).cast("double").alias("x2"), (F.col("y") + F.col("h")).cast("double").alias("y2"))


def detections(spark: SparkSession, sf_dir: str, arm: int = 0) -> DataFrame:
    """seed, tile_id, cls, did, score, x1, y1, x2, y2; did numbers a cell's rows by falling score. arm 1: another model."""
    turn = F.col("seed") + 3 * arm
    cents, w, h = F.col("cents"), F.col("w"), F.col("h")
    rows = _seeded(spark, sf_dir).filter((cents + turn * 5) % 11 != 0)
    rows = rows.select(
        *UNIT,
        *KEY,
        F.when((cents + turn) % 13 == 0, (F.col("cls0") + 1) % 5).otherwise(F.col("cls0")).alias("cls"),
        (F.col("x") + ((cents + turn * 7) % 61 - 30) * w / F.lit(100.0)).alias("x1"),
        (F.col("y") + ((cents + turn * 11) % 53 - 26) * h / F.lit(100.0)).alias("y1"),
        w.cast("double").alias("w"),
        h.cast("double").alias("h"),
        ((cents * 31 + turn * 17) % 1000003).alias("score"),
    )
    number = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("score"), *KEY))
    return rows.withColumn("did", number).select(*CELL, "did", "score", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))


def conf(score: Column) -> Column:
    return score / F.lit(1000003.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, source, field, year, width, height."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    first = F.year("o_orderdate") < 1998
    source = F.when(first, "TOMATO_1").otherwise("TOMATO_2")
    return o.select(
        F.col("o_orderkey").alias("frame"),
        source.alias("source"),
        F.concat_ws("/", source, F.col("c_nationkey").cast("string")).alias("field"),
        F.when(first, 2021).otherwise(2022).alias("year"),
        (3000 + F.col("o_orderkey") * 37 % 800).cast("bigint").alias("width"),
        (3200 + F.col("o_orderkey") * 53 % 700).cast("bigint").alias("height"),
    )


def frame_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, cls, class, reason (null if the box counts), x1, y1, x2, y2: annotated objects of frames."""
    b = _boxes(spark, sf_dir)
    reason = F.when((F.col("l_returnflag") == "N") & (F.col("l_tax") == 0), "excluded:NR").when(F.col("l_discount") == 0.1, "degenerate_box")
    stretch = 3  # over most of a frame, some beyond its edge
    names = F.array(*[F.lit(c) for c in CLASSES])
    return b.select(
        F.col("l_orderkey").alias("frame"),
        F.col("cls0").alias("cls"),
        names[F.col("cls0")].alias("class"),
        reason.alias("reason"),
        (F.col("x") * stretch).alias("x1"),
        (F.col("y") * stretch).alias("y1"),
        (F.col("x") * stretch + F.col("w")).alias("x2"),
        (F.col("y") * stretch + F.col("h")).alias("y2"),
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_name and metric, the mean value of events that carry the same name."""
    e = table(spark, sf_dir, "events")
    seed, ratio = F.col("user_id") % 3, 50 + (F.floor(F.col("user_id") / 3) % 8) * 25
    kind = F.col("event_id") % 6
    det = F.when(F.floor(F.col("user_id") / 24) % 2 == 0, "yolo11").otherwise("yolo26")
    name = (
        F.when(kind == 0, F.concat(F.lit("realonly_"), det, F.lit("_seed"), seed))
        .when(kind <= 2, F.concat(F.lit("hybrid_"), det, F.when(kind == 1, "_v2").otherwise("_v8"), F.lit("_r"), ratio, F.lit("_seed"), seed))
        .when(kind == 3, F.concat(F.lit("matched_"), det, F.lit("_v2_r"), ratio, F.lit("_seed"), seed))
        .otherwise(F.concat(F.lit("annotred_"), F.when(kind == 4, F.when(ratio % 100 == 0, "A").otherwise("B")).otherwise("T"), F.lit("_"), det, F.lit("_seed"), seed))
    )
    cents = F.round(F.col("value") * 100).cast("bigint")
    rows = e.select(name.alias("run_name"), cents.alias("cents"), (F.col("event_id") % 5).cast("int").alias("cls"))
    return rows.groupBy("run_name").agg((F.sum("cents") / F.count("cents") / 50000.0).alias("metric"))


def run_metrics_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_name, cls and metric, null where a class is absent."""
    e = table(spark, sf_dir, "events")
    arm = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("T")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = e.select(
        F.concat(F.lit("annotred_"), arm, F.lit("_yolo26_seed"), (F.col("user_id") % 3)).alias("run_name"),
        (F.floor(F.col("event_id") / 3) % 5).cast("int").alias("cls"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    return rows.groupBy("run_name", "cls").agg(F.when(F.col("cls") < 4, F.sum("cents") / F.count("cents") / 50000.0).alias("metric"))


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run (user_id), epoch and lr: a user's events in order are a run's epochs."""
    e = table(spark, sf_dir, "events")
    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("run"), epoch.alias("epoch"), (F.round(F.col("value") * 100).cast("bigint") / (F.lit(1000000.0) * (1 + F.col("user_id") % 7 * F.col("user_id") % 5 * 20))).alias("lr"))


def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run (user_id), split and map50: the mean value of a user's even events, and of the odd ones; users 0, 10, ... have no val."""
    e = table(spark, sf_dir, "events")
    split = F.when(F.col("event_id") % 2 == 0, "test").otherwise("val")
    rows = e.select(F.col("user_id").alias("run"), split.alias("split"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return rows.filter("split = 'test' or run % 10 <> 0").groupBy("run", "split").agg((F.sum("cents") / F.count("cents") / 50000.0).alias("map50"))


SQL = """
li as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_linestatus, l_returnflag, l_tax, l_discount,
  round(l_extendedprice * 100)::bigint as cents, floor(l_orderkey / 30)::bigint as tile_id, (l_linenumber % 5)::int as cls0,
  (l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 1200 as x, (l_partkey * 53 + l_suppkey * 29 + l_linenumber * 67) % 1200 as y,
  24 + l_quantity::bigint * 4 as w, (24 + (l_partkey % 50) * 4)::bigint as h from lineitem),
seeded as (select *, unnest([0, 1, 2]) as seed from li where l_linestatus = 'O'),
gt as (select seed, tile_id, cls0 as cls, row_number() over (partition by seed, tile_id, cls0 order by l_orderkey, l_partkey, l_suppkey, l_linenumber, cents, l_shipdate)::int as gid,
  x::double as x1, y::double as y1, (x + w)::double as x2, (y + h)::double as y2 from seeded),
det0 as (select seed, tile_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, cents, l_shipdate, case when (cents + seed) % 13 = 0 then (cls0 + 1) % 5 else cls0 end as cls,
  x + ((cents + seed * 7) % 61 - 30) * w / 100.0::double as x1, y + ((cents + seed * 11) % 53 - 26) * h / 100.0::double as y1, w::double as w, h::double as h, (cents * 31 + seed * 17) % 1000003 as score
  from seeded where (cents + seed * 5) % 11 <> 0),
det as (select seed, tile_id, cls, row_number() over (partition by seed, tile_id, cls order by score desc, l_orderkey, l_partkey, l_suppkey, l_linenumber, cents, l_shipdate)::int as did, score, x1, y1, x1 + w as x2, y1 + h as y2 from det0),
det0b as (select seed, tile_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, cents, l_shipdate, case when (cents + seed + 3) % 13 = 0 then (cls0 + 1) % 5 else cls0 end as cls,
  x + ((cents + (seed + 3) * 7) % 61 - 30) * w / 100.0::double as x1, y + ((cents + (seed + 3) * 11) % 53 - 26) * h / 100.0::double as y1, w::double as w, h::double as h, (cents * 31 + (seed + 3) * 17) % 1000003 as score
  from seeded where (cents + (seed + 3) * 5) % 11 <> 0),
detb as (select seed, tile_id, cls, row_number() over (partition by seed, tile_id, cls order by score desc, l_orderkey, l_partkey, l_suppkey, l_linenumber, cents, l_shipdate)::int as did, score, x1, y1, x1 + w as x2, y1 + h as y2 from det0b),
frames as (select o_orderkey as frame, case when year(o_orderdate) < 1998 then 'TOMATO_1' else 'TOMATO_2' end as source, case when year(o_orderdate) < 1998 then 'TOMATO_1' else 'TOMATO_2' end || '/' || c_nationkey as field,
  case when year(o_orderdate) < 1998 then 2021 else 2022 end as year, 3000 + o_orderkey * 37 % 800 as width, 3200 + o_orderkey * 53 % 700 as height from orders join customer on o_custkey = c_custkey),
frame_boxes as (select l_orderkey as frame, cls0 as cls, (['SOLNI', 'POROL', 'SETVE', 'CYPRO', 'ECHCG'])[cls0 + 1] as class,
  case when l_returnflag = 'N' and l_tax = 0 then 'excluded:NR' when l_discount = 0.1::double then 'degenerate_box' end as reason, x * 3 as x1, y * 3 as y1, x * 3 + w as x2, y * 3 + h as y2 from li),
named as (select round(value * 100)::bigint as cents, event_id % 6 as kind, user_id % 3 as seed, 50 + ((user_id // 3) % 8) * 25 as ratio, case when (user_id // 24) % 2 = 0 then 'yolo11' else 'yolo26' end as det from events),
run_metrics as (select case when kind = 0 then 'realonly_' || det || '_seed' || seed when kind <= 2 then 'hybrid_' || det || case when kind = 1 then '_v2' else '_v8' end || '_r' || ratio || '_seed' || seed
  when kind = 3 then 'matched_' || det || '_v2_r' || ratio || '_seed' || seed else 'annotred_' || case when kind = 4 then case when ratio % 100 = 0 then 'A' else 'B' end else 'T' end || '_' || det || '_seed' || seed end as run_name,
  sum(cents)::double / count(cents) / 50000.0::double as metric from named group by 1),
run_metrics_class as (select 'annotred_' || (['A', 'B', 'T'])[event_id % 3 + 1] || '_yolo26_seed' || (user_id % 3) as run_name, ((event_id // 3) % 5)::int as cls,
  case when (event_id // 3) % 5 < 4 then sum(round(value * 100)::bigint)::double / count(*) / 50000.0::double end as metric from events group by 1, 2, (event_id // 3) % 5),
train_log as (select user_id as run, row_number() over (partition by user_id order by ts, event_id)::int as epoch, round(value * 100)::bigint / (1000000.0::double * (1 + user_id % 7 * user_id % 5 * 20)) as lr from events),
split_metrics as (select user_id as run, case when event_id % 2 = 0 then 'test' else 'val' end as split, sum(round(value * 100)::bigint)::double / count(*) / 50000.0::double as map50 from events where event_id % 2 = 0 or user_id % 10 <> 0 group by 1, 2)
"""
