"""Boxes as column expressions. A box is given by the names or columns of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
EPS = 1e-9


def box(prefix: str = "") -> Box:
    """The columns x1, y1, x2, y2 with a prefix, such as 'd.' or 'gt_'."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def clamp(b: Box, width: Column, height: Column) -> Box:
    """The part of a box inside its frame."""
    x1, y1, x2, y2 = b
    zero = F.lit(0)
    return tuple(F.greatest(zero, F.least(v, limit)) for v, limit in ((x1, width), (y1, height), (x2, width), (y2, height)))


def is_valid(b: Box) -> Column:
    x1, y1, x2, y2 = b
    return (x2 > x1) & (y2 > y1)


def area(b: Box) -> Column:
    x1, y1, x2, y2 = b
    return (x2 - x1) * (y2 - y1)


def intersection(a: Box, b: Box) -> Column:
    """Common area; 0 for boxes that only touch."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def iou(a: Box, b: Box) -> Column:
    common = intersection(a, b)
    return common / F.greatest(area(a) + area(b) - common, F.lit(EPS))


def ioa(a: Box, of: Box) -> Column:
    """Common area over the area of the second box."""
    return intersection(a, of) / F.greatest(area(of).cast("double"), F.lit(EPS))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return intersection(a, b) / F.greatest(F.least(area(a), area(b)).cast("double"), F.lit(EPS))


def match_score(a: Box, b: Box, mode: str = "iou") -> Column:
    """How well detection a covers truth b: 'iou', 'ioa', or the larger of both ('max')."""
    if mode == "max":
        return F.greatest(iou(a, b), ioa(a, b))
    return {"iou": iou, "ioa": ioa}[mode](a, b)


def size_key(b: Box) -> Column:
    """Square root of the area, sides below 0 as 0."""
    zero = F.lit(0.0)
    return F.sqrt(F.greatest(zero, b[2] - b[0]) * F.greatest(zero, b[3] - b[1]))


def longest_side(b: Box) -> Column:
    return F.greatest(b[2] - b[0], b[3] - b[1])


def render_scale(target: float | Column, width: Column, height: Column) -> Column:
    """Factor at which a frame is seen when its longer side becomes target."""
    return (F.lit(target) if not isinstance(target, Column) else target) / F.greatest(width, height)


def size_bin(key: Column, edges: list[tuple[str, float, float]]) -> Column:
    """Name of the half-open bin [low, high) that holds key, null for none."""
    out = F.lit(None).cast("string")
    for name, low, high in edges:
        out = F.when((key >= low) & (key < high), name).otherwise(out)
    return out


def to_yolo(b: Box, width: Column, height: Column) -> Column:
    """Struct of centre and size in shares of the frame."""
    x1, y1, x2, y2 = b
    return F.struct(
        ((x1 + x2) / 2 / width).alias("cx"), ((y1 + y2) / 2 / height).alias("cy"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h")
    )


def yolo_line(cls: Column, yolo: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, yolo["cx"], yolo["cy"], yolo["w"], yolo["h"])


def from_yolo(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height


def tile_origins(length: Column, tile: int, stride: int) -> Column:
    """Where tiles begin along a side; the last one ends at the edge, a shorter side has one at 0."""
    n = F.floor((length - tile) / stride).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: k * stride)
    last = (length - tile).cast("int")
    return F.when(length <= tile, F.array(F.lit(0))).when(n * stride == last, steps).otherwise(F.concat(steps, F.array(last)))


def square_window(b: Box, pad: float, width: Column, height: Column) -> Box:
    """A square about the box's centre with a padded side, cut to the frame; whole pixels, cut off below."""
    side = F.greatest(b[2] - b[0], b[3] - b[1]) * (1 + 2 * pad)
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    corners = clamp((cx - side / 2, cy - side / 2, cx + side / 2, cy + side / 2), width, height)
    return tuple(c.cast("int") for c in corners)
