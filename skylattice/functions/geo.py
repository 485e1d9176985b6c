"""Boxes, circles, affine transforms and the UTM projection as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE_LAT, KM_PER_DEGREE_LNG = 110.574, 111.320


def intersects(xmin: Column, ymin: Column, xmax: Column, ymax: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed: boxes that touch intersect."""
    check_box(box)
    return (xmin <= box[2]) & (xmax >= box[0]) & (ymin <= box[3]) & (ymax >= box[1])


def check_box(box) -> None:
    if len(box) != 4 or box[0] > box[2] or box[1] > box[3]:
        raise ValueError(f"not a bounding box: {box}")


def circle_box(lat: Column, lng: Column, radius_km: Column) -> Column:
    """Bounding box in degrees of a circle."""
    dy = radius_km / KM_PER_DEGREE_LAT
    dx = radius_km / (KM_PER_DEGREE_LNG * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return F.struct((lng - dx).alias("west"), (lat - dy).alias("south"), (lng + dx).alias("east"), (lat + dy).alias("north"))


def circle_polygon(lat: Column, lng: Column, radius_km: Column, steps: int = 48) -> Column:
    """Closed ring of ``steps`` + 1 points."""
    dy = radius_km / KM_PER_DEGREE_LAT
    dx = radius_km / (KM_PER_DEGREE_LNG * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    turn = 2 * math.pi / steps
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.array(lng + dx * F.cos(i * turn), lat + dy * F.sin(i * turn)))


def map_x(transform: Column, x: Column, y: Column) -> Column:
    """Affine [a, b, c, d, e, f]: a x + b y + c."""
    return transform[0] * x + transform[1] * y + transform[2]


def map_y(transform: Column, x: Column, y: Column) -> Column:
    return transform[3] * x + transform[4] * y + transform[5]


def pixel_of(transform: Column, mx: Column, my: Column) -> Column:
    """(x, y) as fractions of pixels of a map point."""
    a, b, c, d, e, f = (transform[i] for i in range(6))
    det = a * e - b * d
    return F.struct(((e * (mx - c) - b * (my - f)) / det).alias("x"), ((a * (my - f) - d * (mx - c)) / det).alias("y"))


def pixel_area(transform: Column, unit_m: Column) -> Column:
    """Square metres of a pixel; null where the unit of the map is no length."""
    return F.abs(transform[0] * transform[4] - transform[1] * transform[3]) * unit_m * unit_m


def nearest_distance(lat: Column, lng: Column, to_lat: Column, to_lng: Column) -> Column:
    return F.hypot(to_lat - lat, (to_lng - lng) * F.cos(F.radians(lat)))


# WGS 84 and the published Krueger series to fourth order in the third flattening.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)


def _steps(start: Column, *steps) -> Column:
    """``start`` through functions of structs, each evaluated once however often the next one names its fields."""
    out = F.array(start)
    for step in steps:
        out = F.transform(out, step)
    return out[0]


_E = 2 * math.sqrt(_N) / (1 + _N)


def _to_sphere(lat: Column, lng: Column, zone: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.struct(F.sinh(F.atanh(s) - _E * F.atanh(_E * s)).alias("t"), F.radians(lng - (zone * 6 - 183)).alias("lam"))


def _to_plane(p: Column) -> Column:
    t, lam = p["t"], p["lam"]
    return F.struct(F.atan2(t, F.cos(lam)).alias("xi"), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam))).alias("eta"))


def _to_metres(shift: Column):
    def step(p: Column) -> Column:
        x, y, xi, eta = p["eta"], p["xi"], p["xi"], p["eta"]
        for j, a in enumerate(_ALPHA, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct((500000 + 0.9996 * _RADIUS * x).alias("easting"), (shift + 0.9996 * _RADIUS * y).alias("northing"))

    return step


def utm(lat: Column, lng: Column, zone: Column, north: Column | None = None) -> Column:
    """WGS 84 degrees to UTM metres (easting, northing)."""
    shift = F.when(lat < 0, 1e7).otherwise(0.0) if north is None else F.when(north, 0.0).otherwise(1e7)
    return _steps(_to_sphere(lat, lng, zone), _to_plane, _to_metres(shift))


# The inverse series, and that of the latitude, to fourth order.
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def _from_metres(easting: Column, northing: Column, north: Column) -> Column:
    return F.struct(((northing - F.when(north, 0.0).otherwise(1e7)) / (0.9996 * _RADIUS)).alias("xi"), ((easting - 500000) / (0.9996 * _RADIUS)).alias("eta"))


def _from_plane(p: Column) -> Column:
    x, y, xi, eta = p["eta"], p["xi"], p["xi"], p["eta"]
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct(x.alias("x"), y.alias("y"))


def _from_sphere(p: Column) -> Column:
    return F.struct(F.asin(F.sin(p["y"]) / F.cosh(p["x"])).alias("chi"), F.degrees(F.atan2(F.sinh(p["x"]), F.cos(p["y"]))).alias("turn"))


def _to_degrees(zone: Column):
    def step(p: Column) -> Column:
        lat = p["chi"]
        for j, d in enumerate(_DELTA, 1):
            lat = lat + d * F.sin(2 * j * p["chi"])
        return F.struct(F.degrees(lat).alias("lat"), (zone * 6 - 183 + p["turn"]).alias("lng"))

    return step


def from_utm(easting: Column, northing: Column, zone: Column, north: Column) -> Column:
    """UTM metres to WGS 84 degrees (lat, lng)."""
    return _steps(_from_metres(easting, northing, north), _from_plane, _from_sphere, _to_degrees(zone))


#: Points on each edge of a box between its corners.
EDGE_POINTS = 21


def edge_places(box: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the corners of boxes (rows of west, south, east, north) and of ``points`` points between them on each edge."""
    w, s, e, n = (box[:, i : i + 1] for i in range(4))
    f = np.arange(points + 2) / (points + 1)
    x, y = w + (e - w) * f, s + (n - s) * f
    return np.hstack([x, x, np.broadcast_to(w, y.shape), np.broadcast_to(e, y.shape)]), np.hstack([np.broadcast_to(s, x.shape), np.broadcast_to(n, x.shape), y, y])


def _series(factors: tuple, xi: np.ndarray, eta: np.ndarray | None = None) -> np.ndarray:
    """Sum of a_j sin(2 j z) for z = ``xi`` or the complex xi + i eta, by the recurrence of the multiples of an angle."""
    sin, cos = np.sin(2 * xi), np.cos(2 * xi)
    low, here, twice = 0, sin, 2 * cos
    if eta is not None:
        up = np.exp(2 * eta)
        cosh, sinh = (up + 1 / up) / 2, (up - 1 / up) / 2
        here, twice = sin * cosh + 1j * (cos * sinh), 2 * (cos * cosh) - 2j * (sin * sinh)
    total = factors[0] * here
    for a in factors[1:]:
        low, here = here, twice * here - low
        total += a * here
    return total


def _metres(lng: np.ndarray, lat: np.ndarray, zone: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, lam = np.sin(np.radians(lat)), np.radians(lng - (zone * 6 - 183))
    t, c = np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s)), np.cos(lam)
    xi, eta = np.arctan2(t, c), np.arcsinh(np.sin(lam) / np.sqrt(t * t + c * c))
    more = _series(_ALPHA, xi, eta)
    return 500000 + 0.9996 * _RADIUS * (eta + more.imag), shift + 0.9996 * _RADIUS * (xi + more.real)


def _degrees(easting: np.ndarray, northing: np.ndarray, zone: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    xi, eta = (northing - shift) / (0.9996 * _RADIUS), (easting - 500000) / (0.9996 * _RADIUS)
    less = _series(_BETA, xi, eta)
    xi, eta = xi - less.real, eta - less.imag
    chi = np.arcsin(np.sin(xi) / np.cosh(eta))
    return zone * 6 - 183 + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(chi + _series(_DELTA, chi))


#: Boxes whose points are held at once.
BOXES_AT_ONCE = 256


def _edge_extent(projected: Callable, points: int):
    """Extent of the projected edges of each box, a batch at a time; four nulls for boxes that lack a bound or the zone."""

    def run(box: pa.Array, zone: pa.Array, north: pa.Array) -> pa.Array:
        whole = pc.fill_null(pc.and_(pc.equal(pc.list_value_length(box), 4), pc.is_valid(zone)), False)
        places = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        held = pc.list_flatten(box.take(pa.array(places))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 4)
        zones = zone.take(pa.array(places)).to_numpy(zero_copy_only=False).astype(np.float64)
        shift = np.where(pc.fill_null(north, False).to_numpy(zero_copy_only=False)[places], 0.0, 1e7)
        out = np.full((len(box), 4), np.nan)
        with np.errstate(all="ignore"):
            for a in range(0, len(places), BOXES_AT_ONCE):
                part = slice(a, a + BOXES_AT_ONCE)
                x, y = projected(*edge_places(held[part], points), zones[part, None], shift[part, None])
                out[places[part]] = np.stack([x.min(1), y.min(1), x.max(1), y.max(1)], 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(box) + 1) * 4, pa.int32()), pa.array(out.ravel(), from_pandas=True))

    return run


def utm_bounds(box: Column, zone: Column, north: Column, points: int = EDGE_POINTS) -> Column:
    """A box in degrees as [left, bottom, right, top] in metres: the extent of its corners and of ``points`` points between them on each edge.
    Batches of boxes are projected as arrays: a function of each element is interpreted, node by node, for every point."""
    return F.arrow_udf(_edge_extent(_metres, points), "array<double>")(box, zone, north)


def degree_bounds(box: Column, zone: Column, north: Column, points: int = EDGE_POINTS) -> Column:
    """A box in metres as [west, south, east, north] in degrees, in the same way."""
    return F.arrow_udf(_edge_extent(_degrees, points), "array<double>")(box, zone, north)
