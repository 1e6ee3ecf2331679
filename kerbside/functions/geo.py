"""Geometry on plain columns: points are x/y pairs, lines are arrays of point structs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.vocab import CITY_BBOX, EARTH_RADIUS_M

POINT = "struct<x:double,y:double>"
MERCATOR_HALF_M = math.pi * 6378137.0


# --- spherical and planar measures -----------------------------------------------------------------
def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((phi2 - phi1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(phi1) * F.cos(phi2) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def planar_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def bearing_deg(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Clockwise from north, 0..360; 0 where the points coincide."""
    dx, dy = x2 - x1, y2 - y1
    turned = F.degrees(F.atan2(dx, dy))
    return (F.when((dx == 0) & (dy == 0), F.lit(0.0))
            .otherwise(F.when(turned < 0, turned + F.lit(360.0)).otherwise(turned)))


def angle_diff(a: Column, b: Column) -> Column:
    """Smallest absolute difference of two headings, 0..180."""
    return F.abs(F.pmod(a - b + F.lit(540.0), F.lit(360.0)) - F.lit(180.0))


def point_leg_m(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a straight leg.

    Kept free of branches: the compiled join loop stays small enough for the JVM to optimise.
    """
    dx, dy, ax, ay = x2 - x1, y2 - y1, px - x1, py - y1
    # A leg without length divides to null, which greatest() passes over.
    t = F.least(F.greatest(F.try_divide(ax * dx + ay * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    ex, ey = ax - t * dx, ay - t * dy
    return F.sqrt(ex * ex + ey * ey)


# --- lines held in arrays ------------------------------------------------------------------------
def leg_array(pts: Column) -> Column:
    """Consecutive point pairs of a line as structs x1,y1,x2,y2."""
    return F.zip_with(
        F.slice(pts, F.lit(1), F.greatest(F.size(pts) - 1, F.lit(0))),
        F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"),
                              b["x"].alias("x2"), b["y"].alias("y2")))


def line_length(pts: Column, geodesic: bool = False) -> Column:
    measure = haversine_m if geodesic else planar_m
    return F.aggregate(leg_array(pts), F.lit(0.0),
                       lambda total, leg: total + measure(leg["x1"], leg["y1"], leg["x2"], leg["y2"]))


def point_at(pts: Column, fraction: Column, geodesic: bool = False) -> Column:
    """The point a fraction of the way along a line, as a struct."""
    measure = haversine_m if geodesic else planar_m
    share_of_line = F.greatest(F.least(fraction, F.lit(1.0)), F.lit(0.0))
    # ``left`` is what remains to walk; it stays with the state so that the length is summed only once.
    start = F.struct((share_of_line * line_length(pts, geodesic)).alias("left"),
                     pts[0]["x"].alias("x"), pts[0]["y"].alias("y"))

    def step(state: Column, leg: Column) -> Column:
        length = measure(leg["x1"], leg["y1"], leg["x2"], leg["y2"])
        share = F.least(F.coalesce(F.try_divide(state["left"], length), F.lit(0.0)), F.lit(1.0))
        walking = state["left"] > 0
        return F.struct(
            (state["left"] - length).alias("left"),
            F.when(walking, leg["x1"] + (leg["x2"] - leg["x1"]) * share).otherwise(state["x"]).alias("x"),
            F.when(walking, leg["y1"] + (leg["y2"] - leg["y1"]) * share).otherwise(state["y"]).alias("y"))

    walked = F.aggregate(leg_array(pts), start, step,
                         lambda state: F.struct(state["x"].alias("x"), state["y"].alias("y")))
    # A straight line takes the same step without the functions over arrays, which run uncompiled.
    a, b = pts[0], pts[1]
    length = measure(a["x"], a["y"], b["x"], b["y"])
    left = share_of_line * length
    share = F.least(F.coalesce(F.try_divide(left, length), F.lit(0.0)), F.lit(1.0))
    straight = F.struct(*[F.when(left > 0, a[c] + (b[c] - a[c]) * share).otherwise(a[c]).alias(c) for c in ("x", "y")])
    return F.when(F.size(pts) == 2, straight).otherwise(walked)


def start_point(pts: Column) -> Column:
    return pts[0]


def end_point(pts: Column) -> Column:
    return F.element_at(pts, -1)


def centroid(pts: Column) -> Column:
    """Length-weighted centroid of a line; its first point when it has no length."""
    total = line_length(pts)
    sums = F.aggregate(
        leg_array(pts), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, leg: F.struct(
            (s["x"] + (leg["x1"] + leg["x2"]) / 2
             * planar_m(leg["x1"], leg["y1"], leg["x2"], leg["y2"])).alias("x"),
            (s["y"] + (leg["y1"] + leg["y2"]) / 2
             * planar_m(leg["x1"], leg["y1"], leg["x2"], leg["y2"])).alias("y")))
    return (F.when(total > 0, F.struct((sums["x"] / total).alias("x"), (sums["y"] / total).alias("y")))
            .otherwise(F.struct(pts[0]["x"].alias("x"), pts[0]["y"].alias("y"))))


def route_bearing(pts: Column, offset_m: Column, span_m: float) -> Column:
    """Heading of a line around an offset, measured over a short span either side."""
    length = line_length(pts)
    behind = point_at(pts, F.when(length > 0, (offset_m - F.lit(span_m)) / length).otherwise(F.lit(0.0)))
    ahead = point_at(pts, F.when(length > 0, (offset_m + F.lit(span_m)) / length).otherwise(F.lit(0.0)))
    return bearing_deg(behind["x"], behind["y"], ahead["x"], ahead["y"])


def with_steps(df: DataFrame, length: Column, interval_m: float) -> DataFrame:
    """One row per step 0..floor(length/interval), with its offset along the line."""
    last = F.greatest(F.floor(length / F.lit(float(interval_m))), F.lit(0))
    return (df.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .withColumn("distance_offset_m", F.col("step") * F.lit(float(interval_m))))


# --- areas ---------------------------------------------------------------------------------------
def in_bbox(lon: Column, lat: Column, pad: float = 0.0, bbox: tuple = CITY_BBOX) -> Column:
    west, south, east, north = bbox
    return lon.between(west - pad, east + pad) & lat.between(south - pad, north + pad)


def valid_point(lat: Column, lon: Column) -> Column:
    from kerbside.functions.numbers import finite

    return finite(lat) & finite(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd test against one ring; the ring may be open or closed."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    crossings = F.aggregate(
        leg_array(closed), F.lit(0),
        lambda n, e: n + F.when(
            ((e["y1"] > py) != (e["y2"] > py))
            & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]),
            F.lit(1)).otherwise(F.lit(0)))
    return crossings % 2 == 1


def in_rings(px: Column, py: Column, rings: Column) -> Column:
    """Even-odd over all rings of an area, so holes count as outside."""
    hits = F.aggregate(rings, F.lit(0),
                       lambda n, ring: n + in_ring(px, py, ring).cast("int"))
    return hits % 2 == 1


# --- web map tiles -------------------------------------------------------------------------------
def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = F.radians(lon) * F.lit(6378137.0)
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(6378137.0)
    return x, y


def mercator_tile(mx: Column, my: Column, zoom: int) -> tuple[Column, Column]:
    """Tile column and row of a web-mercator position."""
    per_side = F.lit(1 << zoom)
    world = F.lit(2 * MERCATOR_HALF_M)
    last = per_side - 1
    col = F.floor((mx + F.lit(MERCATOR_HALF_M)) / world * per_side)
    row = F.floor((F.lit(MERCATOR_HALF_M) - my) / world * per_side)
    return (F.greatest(F.least(col, last), F.lit(0)), F.greatest(F.least(row, last), F.lit(0)))


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    return mercator_tile(*to_mercator(lon, lat), zoom)


def tile_bounds_m(col: Column, row: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a tile in web-mercator metres."""
    size = F.lit(2 * MERCATOR_HALF_M / (1 << zoom))
    west = col * size - F.lit(MERCATOR_HALF_M)
    north = F.lit(MERCATOR_HALF_M) - row * size
    return west, north - size, west + size, north


def valid_tile(zoom: Column, x: Column, y: Column) -> Column:
    side = F.pow(F.lit(2.0), zoom.cast("double"))
    return zoom.between(0, 22) & (x >= 0) & (y >= 0) & (x < side) & (y < side)


# --- map projections (published closed forms) --------------------------------------------------------
def to_utm18(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 UTM zone 18N by the Krueger series to third order."""
    a, flattening = 6378137.0, 1 / 298.257223563
    n = flattening / (2 - flattening)
    radius = a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240)
    eccentric = 2 * math.sqrt(n) / (1 + n)
    sin_lat = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin_lat) - F.lit(eccentric) * F.atanh(F.lit(eccentric) * sin_lat))
    dlon = F.radians(lon - F.lit(-75.0))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for order, coefficient in enumerate(alpha, start=1):
        east = east + F.lit(coefficient) * F.cos(F.lit(2.0 * order) * xi) * F.sinh(F.lit(2.0 * order) * eta)
        north = north + F.lit(coefficient) * F.sin(F.lit(2.0 * order) * xi) * F.cosh(F.lit(2.0 * order) * eta)
    return F.lit(500000.0) + F.lit(0.9996 * radius) * east, F.lit(0.9996 * radius) * north


def to_long_island_ft(lon: Column, lat: Column) -> tuple[Column, Column]:
    """NAD83 New York Long Island (Lambert conic, two parallels) in US survey feet."""
    a, flattening = 6378137.0, 1 / 298.257222101
    e = math.sqrt(2 * flattening - flattening ** 2)
    south, north, origin = (math.radians(v) for v in (40 + 40 / 60, 41 + 2 / 60, 40 + 10 / 60))

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)

    def t(phi: float) -> float:
        return math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)

    n = (math.log(m(south)) - math.log(m(north))) / (math.log(t(south)) - math.log(t(north)))
    scale = m(south) / (n * t(south) ** n)
    rho0 = a * scale * t(origin) ** n
    phi = F.radians(lat)
    es = F.lit(e) * F.sin(phi)
    t_phi = (F.tan(F.lit(math.pi / 4) - phi / 2)
             / F.pow((F.lit(1.0) - es) / (F.lit(1.0) + es), F.lit(e / 2)))
    rho = F.lit(a * scale) * F.pow(t_phi, F.lit(n))
    theta = F.lit(n) * F.radians(lon - F.lit(-74.0))
    foot = 1200 / 3937
    return ((F.lit(300000.0) + rho * F.sin(theta)) / F.lit(foot),
            (F.lit(rho0) - rho * F.cos(theta)) / F.lit(foot))
