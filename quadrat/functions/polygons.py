"""Polygons as arrays of points (arrays x, y), with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAT = 1e-12


def _edges(poly: Column) -> Column:
    """Structs a, b of each point and the one after it, the last to the first."""
    after = F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))
    return F.zip_with(poly, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(poly: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether an odd number of edges lies to the right of the point."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
        rise = F.when(by == ay, F.lit(FLAT)).otherwise(by - ay)
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / rise + ax)

    return F.size(F.filter(_edges(poly), crosses)) % 2 == 1


def in_region(mode: Column, polys: Column, x: Column, y: Column) -> Column:
    """Whether a point counts: mode null or 'all' yes, 'none' no, 'poly' inside any polygon of 3 points or more."""
    inside = F.exists(polys, lambda p: (F.size(p) >= 3) & contains(p, x, y))
    return F.when(mode.isNull() | (mode == "all"), F.lit(True)).when(mode == "none", F.lit(False)).otherwise(F.coalesce(inside, F.lit(False)))


def shoelace(poly: Column) -> Column:
    """Area without sign; fewer than 3 points have none."""
    doubled = F.aggregate(_edges(poly), F.lit(0.0), lambda s, e: s + (e["a"][0] * e["b"][1] - e["b"][0] * e["a"][1]))
    return F.when(F.size(poly) < 3, F.lit(0.0)).otherwise(F.abs(doubled) / 2)


def clip(poly: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a polygon in a rectangle, cut at its four sides in turn."""
    for axis, limit, keep_above in ((0, x0, True), (0, x1, False), (1, y0, True), (1, y1, False)):
        # a list of one and its lambda give the polygon a name, so that no step is computed twice
        poly = F.transform(F.array(poly), _side(axis, limit.cast("double"), keep_above))[0]
    return poly


def _side(axis: int, limit: Column, keep_above: bool):
    return lambda poly: _cut(poly, axis, limit, keep_above)


def _cut(poly: Column, axis: int, limit: Column, keep_above: bool) -> Column:
    """The part of a polygon on one side of a line along an axis."""
    none = F.array().cast("array<array<double>>")

    def inside(p: Column) -> Column:
        return p[axis] >= limit if keep_above else p[axis] <= limit

    def met(a: Column, b: Column) -> Column:
        t = (limit - a[axis]) / F.when(b[axis] == a[axis], F.lit(FLAT)).otherwise(b[axis] - a[axis])
        other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
        return F.array(limit, other) if axis == 0 else F.array(other, limit)

    def kept(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return F.concat(F.when(inside(a) != inside(b), F.array(met(a, b))).otherwise(none), F.when(inside(b), F.array(b)).otherwise(none))

    return F.flatten(F.transform(_edges(poly), kept))
