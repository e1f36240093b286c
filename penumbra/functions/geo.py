"""Geometry as column expressions: projection, distances, bearings, map tiles, point in polygon."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Centre of the local projection, metres per degree, radius of the earth.
CENTRE_LAT, CENTRE_LON = 37.498, 127.032
METRES_LON, METRES_LAT = 111320.0, 110540.0
EARTH_RADIUS_M = 6371000.0
#: Zoom of the map tiles.
ZOOM = 15
#: Compass labels, clockwise from north.
CARDINALS = ["북쪽", "북동쪽", "동쪽", "남동쪽", "남쪽", "남서쪽", "서쪽", "북서쪽"]


def lit(x: float) -> Column:
    return F.lit(float(x))


def half_up(x: Column) -> Column:
    """Round to the nearest integer, halves towards plus infinity."""
    return F.floor(x + lit(0.5)).cast("long")


def metres_per_lon(lat0: float = CENTRE_LAT) -> Column:
    return lit(METRES_LON) * F.cos(F.radians(lit(lat0)))


def to_x(lon: Column, lat0: float = CENTRE_LAT, lon0: float = CENTRE_LON) -> Column:
    return (lon - lit(lon0)) * metres_per_lon(lat0)


def to_y(lat: Column, lat0: float = CENTRE_LAT) -> Column:
    return (lat - lit(lat0)) * lit(METRES_LAT)


def to_lon(x: Column, lat0: float = CENTRE_LAT, lon0: float = CENTRE_LON) -> Column:
    return x / metres_per_lon(lat0) + lit(lon0)


def to_lat(y: Column, lat0: float = CENTRE_LAT) -> Column:
    return y / lit(METRES_LAT) + lit(lat0)


def euclid(ax, ay, bx, by) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    a = F.sin(F.radians(lat2 - lat1) / 2)
    b = F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return lit(2 * EARTH_RADIUS_M) * F.asin(F.least(lit(1.0), F.sqrt(h)))


def atan2(y: Column, x: Column) -> Column:
    """Arc tangent to the last bit of the C library, which SQL engines use; Java's own is at times the double beside it.

    A way straight back turns by 180 degrees but for that bit, and the bit decides between left and right.
    """

    def run(y: pa.Array, x: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else math.atan2(p, q) for p, q in zip(y.to_pylist(), x.to_pylist())], pa.float64())

    return F.arrow_udf(run, DoubleType())(y, x)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Degrees clockwise from north, within [0, 360)."""
    east = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(atan2(east, lat2 - lat1)) + 360, lit(360.0))


def turn_delta(before: Column, after: Column) -> Column:
    """Signed change of bearing, within [-180, 180)."""
    return F.pmod(after - before + 540, lit(360.0)) - 180


def turn_kind(before: Column, after: Column) -> Column:
    delta = turn_delta(before, after)
    size = F.abs(delta)
    side = lambda right, left: F.when(delta > 0, right).otherwise(left)
    return (
        F.when(size < 15, "straight").when(size < 45, side("slight-right", "slight-left")).when(size < 160, side("right", "left"))
        .when(size == 180, "uturn-right").otherwise(side("uturn-right", "uturn-left"))
    )


def cardinal(b: Column) -> Column:
    labels = F.array(*(F.lit(x) for x in CARDINALS))
    return F.element_at(labels, (F.pmod(half_up(b / 45), F.lit(8)) + 1).cast("int"))


def tile_x(lon: Column, zoom: int = ZOOM) -> Column:
    return F.floor((lon + 180) / 360 * float(1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int = ZOOM) -> Column:
    return F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * float(1 << zoom)).cast("long")


def tile_west(x: Column, zoom: int = ZOOM) -> Column:
    return x / float(1 << zoom) * 360 - 180


def tile_north(y: Column, zoom: int = ZOOM) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / float(1 << zoom)))))


def boxes_meet(a, b) -> Column:
    """Closed boxes (south, west, north, east) that touch or overlap."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def in_ring(px: Column, py: Column, ring: Column, x="x", y="y") -> Column:
    """Even-odd test of a point against an array of points. Only edges that cross py are divided."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + n - 1, n))
        ax, ay, bx, by = a[x], a[y], b[x], b[y]
        at = (bx - ax) * (py - ay) / F.nullif(by - ay, lit(0.0)) + ax
        return ((ay > py) != (by > py)) & F.coalesce(px < at, F.lit(False))

    return F.when(n >= 3, F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1).otherwise(False)


def in_multipolygon(px: Column, py: Column, polygons: Column, x="x", y="y") -> Column:
    """In the outer ring of some polygon and in none of its holes."""
    return F.exists(polygons, lambda rings: in_ring(px, py, rings[0], x, y) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda hole: in_ring(px, py, hole, x, y)))


def vertex_mean(ring: Column, field: str) -> Column:
    """Mean over the vertices; a repeated closing vertex counts twice."""
    return F.aggregate(ring, lit(0.0), lambda a, p: a + p[field]) / F.nullif(F.size(ring), F.lit(0))


def micro(degrees: Column) -> Column:
    return half_up(degrees * lit(1e6))


def on_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column, Column, Column]:
    """Nearest point of a segment: t within [0, 1] (0 for a point-like one), x, y, distance.

    The distance is taken from the segment's start, so it is exactly 0 at both ends, and segments that meet in a point are equally far from it.
    """
    dx, dy = bx - ax, by - ay
    raw = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, lit(0.0))
    t = F.coalesce(F.greatest(lit(0.0), F.least(lit(1.0), raw)), lit(0.0))
    off_x, off_y = px - ax - t * dx, py - ay - t * dy
    return t, ax + t * dx, ay + t * dy, F.sqrt(off_x * off_x + off_y * off_y)


def in_corridor(lat: Column, lon: Column, south=37.494, west=127.024, north=37.502, east=127.04) -> Column:
    return lat.between(south, north) & lon.between(west, east)
