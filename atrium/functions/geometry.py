"""Column builders for plane geometry; edges count as inside, with a tolerance of 1e-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EPS = 1e-8
EARTH_RADIUS = 6378137.0


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where the projection of p falls on the segment a-b, from 0 to 1; 0 if a is b."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    return F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(length == 0, 1.0).otherwise(length))))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = along(px, py, ax, ay, bx, by)
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def in_box(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (px >= x0 - EPS) & (px <= x1 + EPS) & (py >= y0 - EPS) & (py <= y1 + EPS)


def ring_area(points: Column) -> Column:
    """Signed area of array<struct<x,y>> by the shoelace rule, positive if counter-clockwise; 0 below three points."""
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, F.least(n, F.lit(1))))
    products = F.zip_with(points, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.aggregate(products, F.lit(0.0), lambda s, v: s + v) / 2)


def path_length(points: Column) -> Column:
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def perimeter(points: Column) -> Column:
    """Length of the closed ring; of an open path below three points."""
    ends = distance(F.element_at(points, 1)["x"], F.element_at(points, 1)["y"], F.element_at(points, -1)["x"], F.element_at(points, -1)["y"])
    return path_length(points) + F.when(F.size(points) > 2, ends).otherwise(0.0)


def rotated(px: Column, py: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return cx + (px - cx) * F.cos(a) - (py - cy) * F.sin(a), cy + (px - cx) * F.sin(a) + (py - cy) * F.cos(a)


def local_to_lonlat(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin to degrees; longitudes wrap at 180."""
    lat = F.lit(lat0) + F.degrees(y / EARTH_RADIUS)
    lon = F.lit(lon0) + F.degrees(x / (EARTH_RADIUS * F.cos(F.radians(F.lit(lat0)))))
    return F.pmod(lon + 540.0, F.lit(360.0)) - 180.0, lat


def snap(v: Column, grid: float) -> Column:
    """To the nearest multiple, halves upwards also below zero."""
    return F.floor(v / grid + 0.5) * grid


def segment_in_box(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """The part lo..hi (fractions) of segment a-b that lies in a box; lo > hi if none does."""

    def side(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = F.when(b == a, 1.0).otherwise(b - a)
        t, u = (low - a) / d, (high - a) / d
        flat_in = (a >= low) & (a <= high)
        lo = F.when(b == a, F.when(flat_in, 0.0).otherwise(2.0)).otherwise(F.least(t, u))
        hi = F.when(b == a, F.when(flat_in, 1.0).otherwise(-1.0)).otherwise(F.greatest(t, u))
        return lo, hi

    (xl, xh), (yl, yh) = side(ax, bx, x0, x1), side(ay, by, y0, y1)
    return F.greatest(F.lit(0.0), xl, yl), F.least(F.lit(1.0), xh, yh)


def segment_in_disc(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, r: Column) -> tuple[Column, Column]:
    """The part lo..hi of segment a-b inside a disc; null if they do not meet."""
    dx, dy, ex, ey = bx - ax, by - ay, ax - cx, ay - cy
    a, b, c = dx * dx + dy * dy, 2 * (ex * dx + ey * dy), ex * ex + ey * ey - r * r
    root = b * b - 4 * a * c
    ok = (a > 0) & (root >= 0)
    s = F.sqrt(F.when(ok, root).otherwise(0.0))
    den = F.when(a > 0, 2 * a).otherwise(1.0)
    return F.when(ok, F.greatest(F.lit(0.0), (-b - s) / den)), F.when(ok, F.least(F.lit(1.0), (-b + s) / den))
