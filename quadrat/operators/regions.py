"""Valid regions of images: from true boxes, carried to tiles, and as filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import draw
from ..functions.polygons import clip, in_region, shoelace

FULL = 0.995


def from_boxes(gt: DataFrame, unit: list[str], width: float, height: float, margin: float, axes: str = "both") -> DataFrame:
    """unit, mode and polys: the extent of an image's boxes and a margin, along x, y or both.

    'all' if that is nearly the whole image. Images without boxes have no row; outer-join them as 'none'.
    """
    edges = gt.groupBy(*unit).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    x = (F.lit(0.0), F.lit(width)) if axes == "y" else (F.greatest(F.lit(0.0), F.col("x1") - margin), F.least(F.lit(width), F.col("x2") + margin))
    y = (F.lit(0.0), F.lit(height)) if axes == "x" else (F.greatest(F.lit(0.0), F.col("y1") - margin), F.least(F.lit(height), F.col("y2") + margin))
    share = (x[1] - x[0]) * (y[1] - y[0]) / (width * height)
    poly = F.array(F.array(x[0], y[0]), F.array(x[1], y[0]), F.array(x[1], y[1]), F.array(x[0], y[1]))
    return edges.select(*unit, F.when(share >= FULL, "all").otherwise("poly").alias("mode"), F.array(poly).alias("polys"), share.alias("share"))


def to_tiles(regions: DataFrame, tiles: DataFrame, key: list[str], least: float = 1.0) -> DataFrame:
    """key, ti, mode, polys and share of each tile: the image's region, cut to the tile and moved to its origin.

    A tile that is nearly all inside is 'all', one with at most least pixels 'none'.
    """
    rows = tiles.join(regions.select(*key, F.col("mode").alias("frame_mode"), "polys"), key, "left")
    x0, y0 = F.col("tx").cast("double"), F.col("ty").cast("double")
    x1, y1 = x0 + F.col("tw"), y0 + F.col("th")
    cut = F.filter(F.transform("polys", lambda p: clip(p, x0, y0, x1, y1)), lambda p: F.size(p) >= 3)
    rows = rows.withColumn("cut", F.when(F.col("frame_mode") == "poly", cut).otherwise(F.array().cast("array<array<array<double>>>")))
    part = F.aggregate("cut", F.lit(0.0), lambda s, p: s + shoelace(p)) / (F.col("tw") * F.col("th"))
    share = F.when(F.col("frame_mode").isNull() | (F.col("frame_mode") == "all"), 1.0).when(F.col("frame_mode") == "none", 0.0).otherwise(part)
    rows = rows.withColumn("share", share)
    mode = F.when(F.col("share") >= FULL, "all").when(F.col("share") * F.col("tw") * F.col("th") <= least, "none").otherwise("poly")
    moved = F.transform("cut", lambda p: F.transform(p, lambda q: F.array(q[0] - x0, q[1] - y0)))
    return rows.select(*key, "ti", mode.alias("mode"), F.when(mode == "poly", moved).alias("polys"), "share")


def keep_inside(boxes: DataFrame, regions: DataFrame, unit: list[str]) -> DataFrame:
    """Boxes whose centre is in the image's region; images without one keep all."""
    rows = boxes.join(regions.select(*unit, "mode", "polys"), unit, "left")
    inside = in_region(F.col("mode"), F.col("polys"), (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    return rows.filter(inside).drop("mode", "polys")


def free_windows(windows: DataFrame, boxes: DataFrame, unit: list[str], margin: float = 0.0) -> DataFrame:
    """Windows (unit, x, y, size) that no box of their image comes closer to than margin; one equi-join on the image."""
    b = boxes.select(*(F.col(c).alias(f"_{c}") for c in unit), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    met = (F.col("b_x2") + margin > F.col("x")) & (F.col("b_x1") - margin < F.col("x") + F.col("size")) & (F.col("b_y2") + margin > F.col("y")) & (F.col("b_y1") - margin < F.col("y") + F.col("size"))
    for c in unit:
        met &= F.col(c) == F.col(f"_{c}")
    return windows.join(b, met, "left_anti")


def drawn_windows(images: DataFrame, unit: list[str], sizes: list[int], attempts: int, seed: int = 0) -> DataFrame:
    """images (unit, width, height) with n, size, x, y: so many windows of each size in each image, drawn by digests; none where it is larger."""
    grid = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(n).alias("n")) for s in sizes for n in range(attempts)])
    rows = images.select("*", F.explode(grid).alias("g")).select("*", "g.*").drop("g").filter("width >= size and height >= size")

    def at(axis: str, room: str):
        return draw(F.lit(f"{seed}{axis}"), *(F.col(c).cast("string") for c in unit), F.col("size").cast("string"), F.col("n").cast("string")) % (F.col(room) - F.col("size") + 1).cast("bigint")

    return rows.withColumns({"x": at("x", "width"), "y": at("y", "height")})


def modes(regions: DataFrame, images: DataFrame, unit: list[str]) -> DataFrame:
    """mode and n of images; 'undecided' for those without a region, which count as wholly valid."""
    return images.select(*unit).join(regions.select(*unit, "mode"), unit, "left").groupBy(F.coalesce("mode", F.lit("undecided")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
