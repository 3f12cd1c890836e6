"""Spatial kernels as Catalyst expressions.

* even-odd ray casting (point in polygon) and on-boundary tests, either
  against a polygon *column* (higher-order functions over ``parts``) or a
  driver-side literal whose edges are one constant array so the
  whole test stays inside whole-stage codegen;
* great-circle distance (haversine, mean Earth radius);
* bbox overlap on the four top-level columns (Parquet-pushable).

Ray casting is half-open (``y1 > py`` differs from ``y2 > py``); boundary
membership is decided separately by an exact collinearity test, so
intersects = inside OR on-boundary and within = inside AND NOT on-boundary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Geom

# Fixed value: mean Earth radius (IUGG) used for every metric distance.
EARTH_RADIUS_M = 6371008.8


def bbox_overlaps(xmin: float, ymin: float, xmax: float, ymax: float, prefix: str = "") -> Column:
    """SPA-1 ``&&``: inclusive envelope overlap on the top-level bbox columns.

    Written as four plain comparisons so Catalyst pushes them into the
    Parquet scan (``PushedFilters``) and row groups are skipped by min/max.
    """
    c = (lambda n: F.col(prefix + n))
    return ((c("_xmin") <= F.lit(float(xmax))) & (c("_xmax") >= F.lit(float(xmin)))
            & (c("_ymin") <= F.lit(float(ymax))) & (c("_ymax") >= F.lit(float(ymin))))


def boxes_overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Inclusive overlap of two boxes given as (xmin, ymin, xmax, ymax) Columns."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


# ---------------------------------------------------------------- distance
def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in metres between two lon/lat points (Columns or floats)."""
    def c(v):
        return v if isinstance(v, Column) else F.lit(float(v))
    lon1, lat1, lon2, lat2 = map(c, (lon1, lat1, lon2, lat2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def radius_box(lon: float, lat: float, radius_m: float) -> list[tuple[float, float, float, float]]:
    """Lon/lat boxes that surely contain every point within ``radius_m`` of (lon, lat).

    One box normally; split in two across the antimeridian; the full longitude
    range when the circle reaches a pole.  Used as the Parquet-pushable
    prefilter of a radius search and as the probe extent of a radius join.
    """
    dlat = math.degrees(radius_m / EARTH_RADIUS_M)
    ymin, ymax = lat - dlat, lat + dlat
    if ymin <= -90 or ymax >= 90:
        return [(-180.0, max(ymin, -90.0), 180.0, min(ymax, 90.0))]
    # widest longitude offset is reached at the latitude nearest the pole
    coslat = min(math.cos(math.radians(ymin)), math.cos(math.radians(ymax)))
    dlon = math.degrees(radius_m / (EARTH_RADIUS_M * max(coslat, 1e-12)))
    if dlon >= 180:
        return [(-180.0, ymin, 180.0, ymax)]
    xmin, xmax = lon - dlon, lon + dlon
    boxes = [(max(xmin, -180.0), ymin, min(xmax, 180.0), ymax)]
    if xmin < -180:
        boxes.append((xmin + 360, ymin, 180.0, ymax))
    if xmax > 180:
        boxes.append((-180.0, ymin, xmax - 360, ymax))
    return boxes


def radius_box_columns(lon: Column, lat: Column, radius_m: Column) -> tuple[Column, Column, Column, Column]:
    """Column form of :func:`radius_box` without the antimeridian split.

    Probes whose circle crosses +-180 are widened to the full longitude range,
    which is exact (a superset) and keeps one box per probe.
    """
    dlat = F.degrees(radius_m / EARTH_RADIUS_M)
    ymin = lat - dlat
    ymax = lat + dlat
    coslat = F.least(F.cos(F.radians(ymin)), F.cos(F.radians(ymax)))
    dlon = F.degrees(radius_m / (EARTH_RADIUS_M * F.greatest(coslat, F.lit(1e-12))))
    polar = (ymin <= -90) | (ymax >= 90) | (dlon >= 180) | (lon - dlon < -180) | (lon + dlon > 180)
    return (F.when(polar, F.lit(-180.0)).otherwise(lon - dlon), F.greatest(ymin, F.lit(-90.0)),
            F.when(polar, F.lit(180.0)).otherwise(lon + dlon), F.least(ymax, F.lit(90.0)))


# ---------------------------------------------------------------- ray casting, column polygon
def edge_crosses(a, b, px, py) -> Column:
    return (((a["y"] > py) != (b["y"] > py))
            & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]))


def edge_touches(a, b, px, py) -> Column:
    cross = (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
    return ((cross == 0)
            & (px >= F.least(a["x"], b["x"])) & (px <= F.greatest(a["x"], b["x"]))
            & (py >= F.least(a["y"], b["y"])) & (py <= F.greatest(a["y"], b["y"])))


def segment_indexes(ring: Column) -> Column:
    return F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))


def ring_crossings(ring: Column, px: Column, py: Column) -> Column:
    return F.size(F.filter(segment_indexes(ring),
                           lambda i: edge_crosses(F.get(ring, i), F.get(ring, i + 1), px, py)))


def pip_inside(parts: Column, px: Column, py: Column) -> Column:
    """Even-odd ray casting of (px, py) against every ring of a (multi)polygon column."""
    n = F.aggregate(F.flatten(parts), F.lit(0), lambda acc, ring: acc + ring_crossings(ring, px, py))
    return (n % 2) == 1


def on_boundary(parts: Column, px: Column, py: Column) -> Column:
    """True when (px, py) lies exactly on a ring segment (or a linestring segment)."""
    return F.exists(F.flatten(parts), lambda ring: F.exists(
        segment_indexes(ring), lambda i: edge_touches(F.get(ring, i), F.get(ring, i + 1), px, py)))


# ---------------------------------------------------------------- ray casting, literal polygon
def _edge_array(edges) -> Column:
    """Literal segments as one constant array (folded by the optimizer), whatever their number."""
    return F.array(*[F.struct(F.lit(float(x1)).alias("x1"), F.lit(float(y1)).alias("y1"),
                              F.lit(float(x2)).alias("x2"), F.lit(float(y2)).alias("y2"))
                     for (x1, y1), (x2, y2) in edges])


def pip_inside_literal(g: Geom, px: Column, py: Column) -> Column:
    """Even-odd ray casting against a literal polygon: the crossed segments of one constant array."""
    edges = [(a, b) for a, b in g.edges() if a[1] != b[1]]       # horizontal edges never cross
    if not edges:
        return F.lit(False)
    crossed = F.filter(_edge_array(edges), lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (
        px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return (F.size(crossed) % 2) == 1


def on_boundary_literal(g: Geom, px: Column, py: Column) -> Column:
    """Exact on-segment test against the literal's segments."""
    edges = list(g.edges())
    if not edges:
        return F.lit(False)
    return F.exists(_edge_array(edges), lambda e: (
        ((e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"]) == 0)
        & (px >= F.least(e["x1"], e["x2"])) & (px <= F.greatest(e["x1"], e["x2"]))
        & (py >= F.least(e["y1"], e["y2"])) & (py <= F.greatest(e["y1"], e["y2"]))))


def point_equals_literal(g: Geom, px: Column, py: Column) -> Column:
    """(px, py) equals one of the literal's vertices (points / multipoints)."""
    out = F.lit(False)
    for x, y in g.vertices:
        out = out | ((px == F.lit(x)) & (py == F.lit(y)))
    return out


def line_endpoints(g: Geom) -> list[tuple[float, float]]:
    """Boundary of a (multi)linestring under the mod-2 rule: endpoints seen an odd number of times."""
    counts: dict[tuple[float, float], int] = {}
    for part in g.parts:
        for ring in part:
            if len(ring) >= 2 and ring[0] != ring[-1]:
                for p in (ring[0], ring[-1]):
                    counts[p] = counts.get(p, 0) + 1
    return [p for p, n in counts.items() if n % 2 == 1]
