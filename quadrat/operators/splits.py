"""Inventory, field-holdout splits and tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import tile_origins


def assign(frames: DataFrame, test: list[str], val: list[str], field: str = "field", check: bool = True) -> DataFrame:
    """frames with split: 'test' and 'val' for the named fields, else 'train'. A field that no frame has is an error."""
    if check:
        known = {r[0] for r in frames.filter(F.col(field).isin(test + val)).select(field).distinct().collect()}  # at most the names given
        if missing := sorted({*test, *val} - known):
            raise ValueError(f"no frames of field {', '.join(missing)}")
    split = F.when(F.col(field).isin(test), "test").when(F.col(field).isin(val), "val").otherwise("train")
    return frames.withColumn("split", split)


def leakage(frames: DataFrame) -> DataFrame:
    """split, fields, frames, shared (fields also in other splits), has_2022."""
    fields = frames.groupBy("field").agg(F.count_distinct("split").alias("splits"))
    return frames.join(fields, "field").groupBy("split").agg(
        F.count_distinct("field").alias("fields"),
        F.count(F.lit(1)).alias("frames"),
        F.count_distinct(F.when(F.col("splits") > 1, F.col("field"))).alias("shared"),
        F.bool_or(F.col("year") == 2022).alias("has_2022"),
    )


def assert_no_leakage(frames: DataFrame) -> None:
    """An error if a field is in two splits."""
    bad = frames.groupBy("field").agg(F.count_distinct("split").alias("n")).filter("n > 1").limit(5).collect()
    if bad:
        raise ValueError("fields in several splits: " + ", ".join(r["field"] for r in bad))


def inventory(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """source (null: all), images, objects, fields, missing (frames without objects)."""
    n = boxes.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    rows = frames.join(n, "frame", "left")
    return rows.rollup("source").agg(F.count(F.lit(1)).alias("images"), F.sum(F.coalesce("n", F.lit(0))).alias("objects"), F.count_distinct("field").alias("fields"), F.count_if(F.col("n").isNull()).alias("missing"))


def tiles(frames: DataFrame, tile: int, stride: int) -> DataFrame:
    """frame, ti, tx, ty, tw, th: tiles in rows from the top left; numbered from 0."""
    xs, ys = tile_origins(F.col("width"), tile, stride), tile_origins(F.col("height"), tile, stride)
    rows = frames.select("frame", "width", "height", F.size(xs).alias("nx"), xs.alias("xs"), F.posexplode(ys).alias("iy", "ty"))
    rows = rows.select("frame", "width", "height", "nx", "iy", "ty", F.posexplode("xs").alias("ix", "tx"))
    return rows.select(
        "frame",
        (F.col("iy") * F.col("nx") + F.col("ix")).alias("ti"),
        F.col("tx").cast("bigint").alias("tx"),
        F.col("ty").cast("bigint").alias("ty"),
        F.least(F.lit(tile), F.col("width") - F.col("tx")).cast("bigint").alias("tw"),
        F.least(F.lit(tile), F.col("height") - F.col("ty")).cast("bigint").alias("th"),
    )


def _reached(low: Column, high: Column, origins: Column, tile: int) -> Column:
    """Numbers and origins of the tiles of a side that [low, high) reaches into, from a short list per frame."""
    numbered = F.transform(origins, lambda o, i: F.struct(i.alias("i"), o.alias("o")))
    return F.filter(numbered, lambda t: (t["o"] < high) & (t["o"] + tile > low))


def tile_boxes(frames: DataFrame, boxes: DataFrame, tile: int, stride: int, keep: float) -> DataFrame:
    """Boxes cut to tiles: frame, ti, cls, x1..y2 within the tile; at least the share keep of a box is in it.

    One equi-join on the frame; a box looks up the few tiles that it reaches by their origins, so
    boxes and tiles are never paired off.
    """
    f = frames.select("frame", tile_origins(F.col("width"), tile, stride).alias("xs"), tile_origins(F.col("height"), tile, stride).alias("ys"), "width", "height")
    rows = boxes.join(f, "frame")
    rows = rows.withColumn("tx", F.explode(_reached(F.col("x1"), F.col("x2"), F.col("xs"), tile))).withColumn("ty", F.explode(_reached(F.col("y1"), F.col("y2"), F.col("ys"), tile)))
    tx, ty = F.col("tx.o"), F.col("ty.o")
    tw, th = F.least(F.lit(tile), F.col("width") - tx), F.least(F.lit(tile), F.col("height") - ty)
    cut = [F.greatest("x1", tx) - tx, F.greatest("y1", ty) - ty, F.least(F.col("x2"), tx + tw) - tx, F.least(F.col("y2"), ty + th) - ty]
    rows = rows.select(
        "frame",
        (F.col("ty.i") * F.size("xs") + F.col("tx.i")).alias("ti"),
        "cls",
        *(c.cast("bigint").alias(n) for c, n in zip(cut, ("x1", "y1", "x2", "y2"))),
        ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("whole"),
    )
    inside = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return rows.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (inside >= keep * F.col("whole"))).drop("whole")
