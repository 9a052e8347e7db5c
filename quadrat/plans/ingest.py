"""Queries over annotated frames: splits, label geometry, tiles, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box, clamp, from_yolo, is_valid, longest_side, render_scale, size_key, to_yolo
from ..functions.names import CLASSES
from ..operators import regions as rg
from ..operators import splits as sp
from .detection import _bin
from .fixtures import SQL, detections, frame_boxes, frames, gt_box

QUERIES, ORACLE = {}, {}
TEST, VAL = ["TOMATO_1/3"], ["TOMATO_2/7"]
TILE, STRIDE, KEEP = 1536, 1024, 0.4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return f"with recursive {SQL}, " + ", ".join([_SPLIT, *ctes]) + " "


_SPLIT = f"split_frames as (select *, case when field = '{TEST[0]}' then 'test' when field = '{VAL[0]}' then 'val' else 'train' end as split from frames)"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.assign(frames(spark, sf_dir), TEST, VAL)


@query(_with() + "select coalesce(class, 'all') as class, coalesce(split, 'all') as split, count(*) as n from frame_boxes join split_frames using (frame) where reason is null group by cube (class, split)")
def class_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by class and split, with totals."""
    rows = frame_boxes(spark, sf_dir).filter("reason is null").join(_split(spark, sf_dir), "frame")
    return rows.cube("class", "split").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("class", F.lit("all")).alias("class"), F.coalesce("split", F.lit("all")).alias("split"), "n")


@query(_with("n as (select frame, count(*) as n from frame_boxes where reason is null group by frame)") + "select source, count(*) as images, sum(coalesce(n, 0))::bigint as objects, count(distinct field) as fields, count(*) filter (n is null) as missing from frames left join n using (frame) group by rollup (source)")
def split_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, objects and fields by source and in all."""
    return sp.inventory(frames(spark, sf_dir), frame_boxes(spark, sf_dir).filter("reason is null"))


@query(_with("b as (select * from frame_boxes where reason is null)") + "select field, year, count(distinct frame) as n_images, count(class) as n_objects, " + ", ".join(f"count(*) filter (class = '{c}') as \"{c}\"" for c in CLASSES) + " from frames left join b using (frame) group by field, year")
def field_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, objects and classes of each field."""
    rows = frames(spark, sf_dir).join(frame_boxes(spark, sf_dir).filter("reason is null"), "frame", "left")
    counts = [F.count_if(F.col("class") == c).alias(c) for c in CLASSES]
    return rows.groupBy("field", "year").agg(F.count_distinct("frame").alias("n_images"), F.count("class").alias("n_objects"), *counts)


@query(_with("f as (select field, count(distinct split) as splits from split_frames group by field)") + "select split, count(distinct field) as fields, count(*) as frames, count(distinct case when splits > 1 then field end) as shared, bool_or(year = 2022) as has_2022 from split_frames join f using (field) group by split")
def split_leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are in several splits, and whether a split has the later season."""
    return sp.leakage(_split(spark, sf_dir))


@query(_with("y as (select cls, (x1 + x2) / 2.0::double / width as cx, (y1 + y2) / 2.0::double / height as cy, (x2 - x1)::double / width as w, (y2 - y1)::double / height as h, width, height, x1 from frame_boxes join frames using (frame) where reason is null)") + "select cls, count(*) as n, sum(round(cx * 1e6)::bigint)::bigint as cx, sum(round(cy * 1e6)::bigint)::bigint as cy, sum(round(w * 1e6)::bigint)::bigint as w, sum(round(h * 1e6)::bigint)::bigint as h, count(*) filter (abs((cx - w / 2.0::double) * width - x1) > 1e-6) as off from y group by cls")
def yolo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label coordinates in millionths, and boxes that don't come back."""
    rows = frame_boxes(spark, sf_dir).filter("reason is null").join(frames(spark, sf_dir), "frame")
    w, h = F.col("width"), F.col("height")
    rows = rows.withColumn("y", to_yolo(box(), w, h))
    back = from_yolo(F.col("y.cx"), F.col("y.cy"), F.col("y.w"), F.col("y.h"), w, h)
    sums = [F.sum(F.round(F.col(f"y.{c}") * 1e6).cast("bigint")).alias(c) for c in ("cx", "cy", "w", "h")]
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), *sums, F.count_if(F.abs(back[0] - F.col("x1")) > 1e-6).alias("off"))


@query(_with("c as (select cls, greatest(0, least(x1, width)) as x1, greatest(0, least(y1, height)) as y1, greatest(0, least(x2, width)) as x2, greatest(0, least(y2, height)) as y2, x2 as ox, y2 as oy from frame_boxes join frames using (frame))") + "select cls, count(*) as n, count(*) filter (x2 <> ox or y2 <> oy) as cut, count(*) filter (x2 <= x1 or y2 <= y1) as gone, sum((x2 - x1) * (y2 - y1))::bigint as area from c group by cls")
def box_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut at the edge of their frames, and those of which nothing is left."""
    rows = frame_boxes(spark, sf_dir).join(frames(spark, sf_dir), "frame")
    c = clamp(box(), F.col("width"), F.col("height"))
    cut = (c[2] != F.col("x2")) | (c[3] != F.col("y2"))
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(cut).alias("cut"), F.count_if(~is_valid(c)).alias("gone"), F.sum((c[2] - c[0]) * (c[3] - c[1])).alias("area"))


@query(_with(f"g as (select cls, unnest(['all', {_bin('sqrt((x2 - x1) * (y2 - y1))')}]) as bin from gt where seed = 0)") + "select cls, bin, count(*) as n from g group by cls, bin")
def size_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True boxes by class and size."""
    from ..operators.evaluation import labelled_bins

    rows = gt_box(spark, sf_dir).filter("seed = 0").withColumn("bin", F.explode(labelled_bins(size_key(box()))))
    return rows.groupBy("cls", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(_with("s as (select cls, greatest(x2 - x1, y2 - y1) * (1024.0::double / greatest(width, height)) as side, sqrt((x2 - x1)::double * (y2 - y1)) * (1024.0::double / greatest(width, height)) as mean from frame_boxes join frames using (frame) where reason is null)") + "select cls, count(*) as n, round(quantile_cont(side, 0.5), 6) as longest_median, round(quantile_cont(mean, 0.5), 6) as mean_median, round(max(side), 6) as longest_max from s group by cls")
def apparent_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of objects at a render size of 1024."""
    rows = frame_boxes(spark, sf_dir).filter("reason is null").join(frames(spark, sf_dir), "frame")
    scale = render_scale(1024.0, F.col("width"), F.col("height"))
    rows = rows.select("cls", (longest_side(box()) * scale).alias("side"), (size_key(box()) * scale).alias("mean"))
    median = [F.round(F.percentile(c, F.lit(0.5)), 6).alias(n) for c, n in (("side", "longest_median"), ("mean", "mean_median"))]
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), *median, F.round(F.max("side"), 6).alias("longest_max"))


def _origins(side: str) -> str:
    return f"case when {side} <= {TILE} then [0] else list_distinct(list_concat(list_transform(range(0, ({side} - {TILE}) // {STRIDE} + 1), lambda k: k * {STRIDE}), [{side} - {TILE}])) end"


_TILES = f"tiles as (select frame, ti, tx, ty, least({TILE}, width - tx) as tw, least({TILE}, height - ty) as th from (select *, row_number() over (partition by frame order by ty, tx) - 1 as ti from (select *, unnest({_origins('width')}) as tx from (select *, unnest({_origins('height')}) as ty from frames))))"


@query(_with(_TILES) + "select frame, ti::int as ti, tx, ty, tw, th from tiles")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles of all frames."""
    return sp.tiles(frames(spark, sf_dir), TILE, STRIDE)


_CUT = f"cut as (select frame, ti::int as ti, cls, greatest(x1, tx) - tx as x1, greatest(y1, ty) - ty as y1, least(x2, tx + tw) - tx as x2, least(y2, ty + th) - ty as y2 from frame_boxes join tiles using (frame) where reason is null and least(x2, tx + tw) > greatest(x1, tx) and least(y2, ty + th) > greatest(y1, ty) and (least(x2, tx + tw) - greatest(x1, tx)) * (least(y2, ty + th) - greatest(y1, ty)) >= {KEEP}::double * ((x2 - x1) * (y2 - y1)))"


@query(_with(_TILES, _CUT) + "select frame, ti, cls, count(*) as n, sum(x1 + 2 * y1 + 3 * x2 + 5 * y2)::bigint as total from cut group by all")
def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in tiles, by frame, tile and class, with a sum that tells their places."""
    t = sp.tile_boxes(frames(spark, sf_dir), frame_boxes(spark, sf_dir).filter("reason is null"), TILE, STRIDE, KEEP)
    return t.groupBy("frame", "ti", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x1") + 2 * F.col("y1") + 3 * F.col("x2") + 5 * F.col("y2")).alias("total"))


@query(_with(_TILES, _CUT, "full_tiles as (select distinct frame, ti from cut)") + "select split, count(*) as tiles, count(c.ti) as kept from tiles t join split_frames using (frame) left join full_tiles c on c.frame = t.frame and c.ti = t.ti group by split")
def tile_drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with and without boxes, by split."""
    f = _split(spark, sf_dir)
    full = sp.tile_boxes(f, frame_boxes(spark, sf_dir).filter("reason is null"), TILE, STRIDE, KEEP).select("frame", "ti").distinct().withColumn("full", F.lit(True))
    rows = sp.tiles(f, TILE, STRIDE).join(f.select("frame", "split"), "frame").join(full, ["frame", "ti"], "left")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("tiles"), F.count("full").alias("kept"))


_REGION = "ext as (select tile_id, greatest(0.0::double, min(x1) - 20) as a, greatest(0.0::double, min(y1) - 20) as b, least(1400.0::double, max(x2) + 20) as c, least(1400.0::double, max(y2) + 20) as d from gt where seed = 0 group by tile_id), region as (select *, (c - a) * (d - b) / (1400.0::double * 1400.0) as share, case when (c - a) * (d - b) / (1400.0::double * 1400.0) >= 0.995 then 'all' else 'poly' end as mode from ext)"


@query(_with(_REGION) + "select tile_id, mode, round(share, 6) as share from region")
def region_from_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each image that its true boxes span."""
    r = rg.from_boxes(gt_box(spark, sf_dir).filter("seed = 0"), ["tile_id"], 1400.0, 1400.0, 20.0)
    return r.select("tile_id", "mode", F.round("share", 6).alias("share"))


_QUADS = "quads as (select tile_id, q as ti, (q % 2) * 700.0::double as x, (q // 2) * 700.0::double as y from (select tile_id, unnest([0, 1, 2, 3]) as q from region)), cutq as (select tile_id, ti, case when r.mode = 'all' then 1.0::double else greatest(0, least(c, x + 700) - greatest(a, x)) * greatest(0, least(d, y + 700) - greatest(b, y)) / 490000.0::double end as share from quads join region r using (tile_id))"


@query(_with(_REGION, _QUADS) + "select tile_id, ti, round(share, 6) as share, case when share >= 0.995 then 'all' when share * 490000 <= 1 then 'none' else 'poly' end as mode from cutq")
def region_to_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions cut to the four quarters of each image."""
    r = rg.from_boxes(gt_box(spark, sf_dir).filter("seed = 0"), ["tile_id"], 1400.0, 1400.0, 20.0)
    q = F.array(*[F.struct(F.lit(k).alias("ti"), F.lit(700 * (k % 2)).alias("tx"), F.lit(700 * (k // 2)).alias("ty"), F.lit(700).alias("tw"), F.lit(700).alias("th")) for k in range(4)])
    quarters = r.select("tile_id", F.explode(q).alias("q")).select("tile_id", "q.*")
    return rg.to_tiles(r, quarters, ["tile_id"]).select("tile_id", "ti", F.round("share", 6).alias("share"), "mode")


@query(_with(_REGION.replace("- 20", "+ 100").replace("+ 20", "- 100")) + "select d.seed, count(*) as n, count(*) filter (r.mode = 'all' or ((d.x1 + d.x2) / 2 >= r.a and (d.x1 + d.x2) / 2 < r.c and (d.y1 + d.y2) / 2 >= r.b and (d.y1 + d.y2) / 2 < r.d) ) as kept from det d join region r using (tile_id) group by d.seed")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections whose centre is in the image's region, drawn in by 100 pixels."""
    r = rg.from_boxes(gt_box(spark, sf_dir).filter("seed = 0"), ["tile_id"], 1400.0, 1400.0, -100.0)
    d = detections(spark, sf_dir).join(r.select("tile_id"), "tile_id", "left_semi")
    n = d.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    return n.join(rg.keep_inside(d, r, ["tile_id"]).groupBy("seed").agg(F.count(F.lit(1)).alias("kept")), "seed")
