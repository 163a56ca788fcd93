"""Plane geometry as columns. A ring is an array of structs x, y whose last point repeats the first; a polygon is an array of rings, all but the first holes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrier.functions.values import let

# GRS80, zone 19 north, metres to a degree at 45 degrees, and to an acre.
AXIS, FLATTENING, SCALE, MERIDIAN, EASTING = 6_378_137.0, 1 / 298.257222101, 0.9996, -69.0, 500_000.0
METRES_LAT, METRES_LON = 110_540.0, 111_320.0 * math.cos(math.pi / 4)
ACRE = 4046.8564224
CELL, SNAP = 500.0, 2.0


def project(lon: Column, lat: Column) -> Column:
    """struct(x, y): degrees to metres of the transverse Mercator zone, by the usual series."""
    e2 = FLATTENING * (2 - FLATTENING)
    second = e2 / (1 - e2)
    coefficients = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)
    phi = F.radians(lat)
    n = AXIS / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c = F.tan(phi) * F.tan(phi), second * F.cos(phi) * F.cos(phi)
    a = F.radians(lon - MERIDIAN) * F.cos(phi)
    arc = AXIS * (coefficients[0] * phi - coefficients[1] * F.sin(2 * phi) + coefficients[2] * F.sin(4 * phi) - coefficients[3] * F.sin(6 * phi))
    east = a + (1 - t + c) * F.pow(a, 3.0) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * F.pow(a, 5.0) / 120
    north = a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4.0) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * F.pow(a, 6.0) / 720
    return F.struct((SCALE * n * east + EASTING).alias("x"), (SCALE * (arc + n * F.tan(phi) * north)).alias("y"))


def metres_apart(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column) -> Column:
    return F.hypot((a_lon - b_lon) * METRES_LON, (a_lat - b_lat) * METRES_LAT)


def _edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def signed_area(ring: Column) -> Column:
    return _total(F.transform(_edges(ring), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def length(ring: Column) -> Column:
    return _total(F.transform(_edges(ring), lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])))


def box(ring: Column) -> Column:
    side = lambda f, k: f(ring[k])
    return F.struct(side(F.array_min, "x").alias("west"), side(F.array_min, "y").alias("south"), side(F.array_max, "x").alias("east"), side(F.array_max, "y").alias("north"))


def is_finite(ring: Column) -> Column:
    """Whether all coordinates are known and finite."""
    return F.coalesce(F.forall(ring, lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf"))), F.lit(False))


def vertex_mean(ring: Column) -> Column:
    """Of a closed ring of four points at least, without the last."""
    inner = F.slice(ring, 1, F.size(ring) - 1)
    mean = lambda k: _total(F.transform(inner, lambda p: p[k])) / F.size(inner)
    return F.when(F.size(ring) >= 4, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def centroid(ring: Column) -> Column:
    """Weighted by area; the mean of the vertices where there is none."""

    def weighted(area: Column) -> Column:
        moment = lambda k: _total(F.transform(_edges(ring), lambda e: (e["p"][k] + e["q"][k]) * (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))) / (6 * area)
        return F.when(F.abs(area) < 1e-9, vertex_mean(ring)).otherwise(F.struct(moment("x").alias("x"), moment("y").alias("y")))

    return let(signed_area(ring), weighted)


def polygon_area(rings: Column) -> Column:
    """The outer ring's less the holes', 0 at least."""
    sizes = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return let(sizes, lambda s: F.greatest(F.lit(0.0), 2 * s[0] - _total(s)))


def polygon_length(rings: Column) -> Column:
    return _total(F.transform(rings, length))


# Shapes of many parts: an array of polygons.


def shape_area(parts: Column) -> Column:
    """The sum of its parts'; parts of degrees must be projected first (project_shape)."""
    return _total(F.transform(parts, polygon_area))


def shape_box(parts: Column) -> Column:
    return box(F.flatten(F.flatten(parts)))


def shape_point(parts: Column) -> Column:
    """Where a shape is shown: the mean of the corners of its first part's outer ring."""
    return vertex_mean(parts[0][0])


def project_shape(parts: Column) -> Column:
    """Degrees to metres, point by point."""
    return F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: project(p["x"], p["y"]))))


def acres_text(acreage: Column) -> Column:
    """To six places, without zeros at the end; null unless positive."""
    return F.when((acreage > 0) & ~F.isnan(acreage), F.regexp_replace(F.format_string("%.6f", acreage), r"\.?0+$", ""))


def compactness(area: Column, perimeter: Column) -> Column:
    """4 pi A / P²: 1 for a circle."""
    return F.when((area > 0) & (perimeter > 0), 4 * math.pi * area / (perimeter * perimeter))


def to_acres(area: Column) -> Column:
    return F.when(area > 0, area / ACRE)


def cells(b: Column, snap: float = SNAP, cell: float = CELL) -> Column:
    """structs (cx, cy) of the grid cells that a box, widened by snap, meets."""
    span = lambda low, high: F.sequence(F.floor((b[low] - snap) / cell), F.floor((b[high] + snap) / cell))
    return F.flatten(F.transform(span("west", "east"), lambda x: F.transform(span("south", "north"), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def boxes_near(a: Column, b: Column, snap: float = SNAP) -> Column:
    return (a["west"] - snap <= b["east"]) & (b["west"] - snap <= a["east"]) & (a["south"] - snap <= b["north"]) & (b["south"] - snap <= a["north"])


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def ring_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of closed rings, arrays of pair, point and coordinate: the least distance of their segments, 0 where they cross."""

    def to_segments(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
        start, d = ring[:, None, :-1], np.diff(ring, axis=1)[:, None]
        off = points[:, :, None] - start
        t = np.clip((off * d).sum(axis=-1) / np.maximum((d**2).sum(axis=-1), 1e-300), 0, 1)
        off = off - t[..., None] * d
        return np.hypot(off[..., 0], off[..., 1]).min(axis=(1, 2))

    p, q, r, s = a[:, :-1, None], a[:, 1:, None], b[:, None, :-1], b[:, None, 1:]
    crossing = ((_cross(p, q, r) * _cross(p, q, s) < 0) & (_cross(r, s, p) * _cross(r, s, q) < 0)).any(axis=(1, 2))
    return np.where(crossing, 0.0, np.minimum(to_segments(a, b), to_segments(b, a)))


@F.arrow_udf(T.DoubleType())
def _flat_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Rings as x, y, x, y ...; pairs with as many points each are worked out together, in pieces of bounded size."""
    starts, sizes = zip(*((o[:-1], np.diff(o)) for o in (x.offsets.to_numpy().astype(np.int64) for x in (a, b))), strict=True)
    flat = [x.values.to_numpy(zero_copy_only=False) for x in (a, b)]
    out = np.zeros(len(a))
    shapes, of = np.unique(np.stack(sizes, axis=1), axis=0, return_inverse=True)
    for k, (m, n) in enumerate(shapes):
        at, step = np.flatnonzero(of.reshape(-1) == k), max(1, 2_000_000 // int(m * n))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            rings = (v[s[some][:, None] + np.arange(size)].reshape(len(some), -1, 2) for v, s, size in zip(flat, starts, (m, n), strict=True))
            out[some] = ring_gaps(*rings)
    return pa.array(out)


#: Not pushed into filters, which would work each distance out again.
_flat_distance = _flat_distance.asNondeterministic()


def min_ring_distance(a: Column, b: Column) -> Column:
    """The least distance of two rings, 0 where they cross."""
    flat = lambda ring: F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return _flat_distance(flat(a), flat(b))


def tile(lon: Column, lat: Column, zoom: int) -> Column:
    """struct(x, y, tms_y) of the web-mercator tile."""
    n = float(2**zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    r = F.radians(lat)
    y = F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n)
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), (n - 1 - y).cast("long").alias("tms_y"))


def tile_range(b: Column, zoom: Column) -> Column:
    """struct(zoom, west, north, east, south): the tiles that a box of degrees meets, within the map."""
    n = F.pow(F.lit(2.0), zoom)

    def row(lat: Column) -> Column:
        r = F.radians(lat)
        return F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n).cast("long")

    column = lambda lon: F.floor((lon + 180.0) / 360.0 * n).cast("long")
    last, zero = (n - 1).cast("long"), F.lit(0).cast("long")
    return F.struct(zoom.alias("zoom"), F.greatest(zero, column(b["west"])).alias("west"), F.greatest(zero, row(b["north"])).alias("north"), F.least(last, column(b["east"])).alias("east"), F.least(last, row(b["south"])).alias("south"))


def square(x: Column, y: Column, side: float) -> Column:
    """The closed ring of a square with its lower left corner at x, y."""
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return F.array(corner(0.0, 0.0), corner(side, 0.0), corner(side, side), corner(0.0, side), corner(0.0, 0.0))
