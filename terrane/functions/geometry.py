"""Geometry measures and tile arithmetic as native column expressions.

A geometry is struct<type, parts: array<array<struct<x, y>>>>: a point is one part of one vertex, a polygon's parts are rings.
The vertices of the kinds PointZ, PolylineZ and PolygonZ also have z and m, those of PointM, PolylineM and PolygonM m; no reader
makes them.  They have boxes, of x and y, and become null in features.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point_z(x: Column, y: Column, z: Column, m: Column | None = None) -> Column:
    """m may be missing."""
    return F.struct(*(v.cast("double").alias(n) for n, v in zip("xyzm", (x, y, z, F.lit(None) if m is None else m), strict=True)))


def point_m(x: Column, y: Column, m: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for n, v in zip("xym", (x, y, m), strict=True)))


def geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts"))


def bbox(g: Column) -> Column:
    """The envelope of all vertices; null for no geometry.

    A point's is the point itself.  NaN is passed over in all others, which without a number reach from plus to minus infinity.
    """
    inf, one = float("inf"), g["type"].isin("Point", "PointZ", "PointM")
    ends = (("x_min", "x", inf), ("y_min", "y", inf), ("x_max", "x", -inf), ("y_max", "y", -inf))
    nothing = F.struct(*(F.lit(none).alias(n) for n, _, none in ends))
    # One pass over the vertices; a comparison with NaN holds for no least one, and is asked about for the greatest.
    wider = lambda b, p: F.struct(*(F.when((p[k] < b[n]) if none > 0 else (p[k] > b[n]) & ~F.isnan(p[k]), p[k]).otherwise(b[n]).alias(n) for n, k, none in ends))
    single = lambda p: F.struct(*(p[k].alias(n) for n, k, _ in ends))
    first = F.get(F.get(g["parts"], F.lit(0)), F.lit(0))
    return F.when(one & first.isNotNull(), single(first)).when(g["parts"].isNotNull(), F.aggregate(F.flatten(g["parts"]), nothing, wider))


def intersects(box: Column, x_min: float, y_min: float, x_max: float, y_max: float) -> Column:
    """Not apart on any side, so edges count, and so does NaN, which is apart from nothing; a null box never does."""
    apart = lambda low, high: (low > high) & ~F.isnan(low) & ~F.isnan(high)
    sides = (box["x_min"], F.lit(x_max)), (F.lit(x_min), box["x_max"]), (box["y_min"], F.lit(y_max)), (F.lit(y_min), box["y_max"])
    any_side = F.lit(False)
    for low, high in sides:
        any_side = any_side | apart(low.cast("double"), high.cast("double"))
    return F.coalesce(~any_side & box.isNotNull(), F.lit(False))


def _sides(part: Column, of) -> Column:
    """The sum of of(vertex, next vertex) along a part."""
    n = F.size(part)
    pairs = F.zip_with(F.slice(part, 1, F.greatest(n - 1, F.lit(0))), F.slice(part, 2, F.greatest(n - 1, F.lit(0))), of)
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def length(g: Column) -> Column:
    """Summed over parts."""
    one = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    return F.aggregate(F.transform(g["parts"], lambda p: _sides(p, one)), F.lit(0.0), lambda s, d: s + d)


def signed_area(ring: Column) -> Column:
    """Shoelace over the ring closed by its first vertex; positive: counter-clockwise."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return _sides(closed, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def num_points(g: Column) -> Column:
    return F.size(F.flatten(g["parts"]))


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """Longitudes and latitudes of a Web Mercator tile."""
    n = F.pow(F.lit(2.0), z)
    lon = lambda v: v / n * 360 - 180
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return F.struct(lon(x).alias("x_min"), lat(y + 1).alias("y_min"), lon(x + 1).alias("x_max"), lat(y).alias("y_max"))


def zigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1))))


def distance(a: Column, b: Column) -> Column:
    """Between two vertices, in the plane."""
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def num_parts(g: Column) -> Column:
    return F.size(g["parts"])


def is_clockwise(ring: Column) -> Column:
    """A ring without area isn't."""
    return signed_area(ring) < 0


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def exterior(g: Column) -> Column:
    """A polygon's first ring; null without rings."""
    return F.get(g["parts"], F.lit(0))


def holes(g: Column) -> Column:
    return F.slice(g["parts"], F.lit(2), F.greatest(F.size(g["parts"]) - 1, F.lit(0)))


def polygon_area(g: Column) -> Column:
    """The first ring's area less all others', so it may fall below zero."""
    return F.aggregate(holes(g), F.coalesce(ring_area(exterior(g)), F.lit(0.0)), lambda s, ring: s - ring_area(ring))


def perimeter(g: Column) -> Column:
    """Over all rings as they are stored; no side is added to close one."""
    return length(g)


def contains(box: Column, x: Column, y: Column) -> Column:
    """Edges count."""
    return x.between(box["x_min"], box["x_max"]) & y.between(box["y_min"], box["y_max"])


def shape_type(g: Column) -> Column:
    return g["type"]


def is_null(g: Column) -> Column:
    return g["type"] == "Null"


def parts_of(g: Column, kind: str) -> Column:
    """A geometry's parts if it is of this kind, else null."""
    return F.when(g["type"] == kind, g["parts"])


def pixel_to_geo(z: Column, x: Column, y: Column, px: Column, py: Column, extent: Column) -> Column:
    """Longitude and latitude of a place within a tile."""
    n = F.pow(F.lit(2.0), z)
    lat = F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * (y + py / extent) / n))))
    return F.struct(((x + px / extent) / n * 360 - 180).alias("x"), lat.alias("y"))
