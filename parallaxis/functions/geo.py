"""Distances, angles, tiles and polygons as column expressions."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
TILE_ZOOM = 14
TILE_EXTENT = 4096


def _col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_phi, half_lam = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_phi), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lam), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def angle_diff(a, b) -> Column:
    """Smallest difference of two compass angles, 0 to 180; null if either is null."""
    turn = F.abs(_col(a) - _col(b)) % 360
    return F.least(turn, 360 - turn)


def circular_distance(a, b) -> Column:
    return F.abs(F.pmod(_col(a) - _col(b) + 180, F.lit(360.0)) - 180)


def circular_mean(angle) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    r = F.radians(_col(angle))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def tile_x(lon, zoom: int = TILE_ZOOM) -> Column:
    return F.floor((_col(lon) + 180) / 360 * 2**zoom).cast("int")


def tile_y(lat, zoom: int = TILE_ZOOM) -> Column:
    r = F.radians(_col(lat))
    return F.floor((1 - F.asinh(F.tan(r)) / math.pi) / 2 * 2**zoom).cast("int")


def tile_position(px, py, west, east, north, south) -> tuple[Column, Column]:
    """(lon, lat) of a point given in tile units from the north-west corner."""
    px, py, west, east, north, south = map(_col, (px, py, west, east, north, south))
    return west + px / TILE_EXTENT * (east - west), north - py / TILE_EXTENT * (north - south)


def tile_range(wkt: str, zoom: int = TILE_ZOOM) -> tuple[int, int, int, int]:
    """(x least, x most, y least, y most) of the tiles that a geometry's box touches; literals for partition pruning."""
    west, south, east, north = bounds(parse_wkt(wkt))

    def x(lon):
        return int(math.floor((lon + 180) / 360 * 2**zoom))

    def y(lat):
        return int(math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**zoom))

    return x(west), x(east), y(north), y(south)


Ring = list[tuple[float, float]]


def parse_wkt(wkt: str) -> list[Ring]:
    """Closed rings of a POLYGON or MULTIPOLYGON (holes are rings, too)."""
    kind = re.match(r"\s*(MULTI)?POLYGON\s*\(", wkt, re.I)
    if not kind:
        raise ValueError("expected a POLYGON or MULTIPOLYGON")
    rings = []
    for body in re.findall(r"\(([^()]+)\)", wkt):
        ring = [tuple(map(float, p.split()[:2])) for p in body.split(",")]
        if len(ring) < 3:
            raise ValueError("a ring needs three points")
        rings.append(ring if ring[0] == ring[-1] else [*ring, ring[0]])
    if not rings:
        raise ValueError("empty geometry")
    return rings


def bounds(rings: list[Ring]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    return min(xs), min(ys), max(xs), max(ys)


def within(wkt: str, lon="lon", lat="lat") -> Column:
    """Strictly inside: even-odd ray cast over all rings, boundary excluded, the box first so that it can be pushed down."""
    rings = parse_wkt(wkt)
    west, south, east, north = bounds(rings)
    x, y = _col(lon), _col(lat)
    crossings, on_edge = [], []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if y1 != y2:
                at = F.lit(x2 - x1) * (y - y1) / F.lit(y2 - y1) + x1
                crossings.append((((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at)).cast("int"))
            cross = F.lit(x2 - x1) * (y - y1) - F.lit(y2 - y1) * (x - x1)
            on_edge.append(
                (cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
            )
    odd = reduce(lambda a, b: a + b, crossings, F.lit(0)) % 2 == 1
    return x.between(west, east) & y.between(south, north) & odd & ~reduce(lambda a, b: a | b, on_edge)
