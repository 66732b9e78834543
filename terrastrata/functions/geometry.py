"""Plane geometry as arithmetic on columns; shapes are arrays of structs (x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GeoTransform = tuple[float, float, float, float, float, float]


def pixel_x(gt: GeoTransform, col: Column, row: Column) -> Column:
    """Map x of the pixel's centre."""
    return F.lit(gt[0]) + (col + 0.5) * F.lit(gt[1]) + (row + 0.5) * F.lit(gt[2])


def pixel_y(gt: GeoTransform, col: Column, row: Column) -> Column:
    return F.lit(gt[3]) + (col + 0.5) * F.lit(gt[4]) + (row + 0.5) * F.lit(gt[5])


def inverse(gt: GeoTransform) -> GeoTransform:
    det = gt[1] * gt[5] - gt[2] * gt[4]
    if not det:
        raise ValueError("the geotransform can't be inverted")
    a, b, d, e = gt[5] / det, -gt[2] / det, -gt[4] / det, gt[1] / det
    return (-(a * gt[0] + b * gt[3]), a, b, -(d * gt[0] + e * gt[3]), d, e)


def point_col(gt: GeoTransform, x: Column, y: Column) -> Column:
    """0-based pixel column that holds a map point; the point may lie outside of the grid."""
    i = inverse(gt)
    return F.floor(F.lit(i[0]) + x * F.lit(i[1]) + y * F.lit(i[2])).cast("int")


def point_row(gt: GeoTransform, x: Column, y: Column) -> Column:
    i = inverse(gt)
    return F.floor(F.lit(i[3]) + x * F.lit(i[4]) + y * F.lit(i[5])).cast("int")


def segment_distance_squared(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point from a segment; a segment of no length is a point."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = F.when(length == 0, F.lit(0.0)).otherwise(((x - x1) * dx + (y - y1) * dy) / F.nullif(length, F.lit(0.0)))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    px, py = x - (x1 + t * dx), y - (y1 + t * dy)
    return px * px + py * py


def ring_crossings(x: Column, y: Column, ring: Column) -> Column:
    """How many edges of a closed ring a ray from the point to the right crosses."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        at = ax + (y - ay) / F.nullif(by - ay, F.lit(0.0)) * (bx - ax)
        return F.when((ay > y) != (by > y), (x < at).cast("int")).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e))


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings, so that inner rings are holes."""
    return F.aggregate(rings, F.lit(0), lambda acc, r: acc + ring_crossings(x, y, r)) % 2 == 1


def rotated(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    """Turned about the origin, counter-clockwise."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * F.lit(c) - y * F.lit(s), x * F.lit(s) + y * F.lit(c)
