"""Coordinate reference systems (CRS-1..6).

The projections are written once against a small math namespace so the same
formula serves Spark ``Column`` expressions (vertices of a whole table, JVM
side, inside whole-stage codegen) and Python floats (a request literal that is
transformed once on the driver, never the column).
"""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

# OGC CRS URIs and the EPSG codes the service supports.
CRS84_URI = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
EPSG_URI_PREFIX = "http://www.opengis.net/def/crs/EPSG/0/"
BASE_SUPPORTED_SRIDS = (4326, 3857, 2154)

# Web mercator sphere and Lambert-93 (EPSG:2154, GRS80) parameters.
MERC_A = 6378137.0
MERC_HALF_WORLD = 20037508.342789244
L93_E = 0.0818191910428158
L93_N = 0.7256077650532670
L93_C = 11754255.426096
L93_XS = 700000.0
L93_YS = 12655612.049876
L93_LON0 = 3.0
L93_ITERATIONS = 5

_PY = SimpleNamespace(sin=math.sin, cos=math.cos, tan=math.tan, atan=math.atan, atan2=math.atan2,
                      log=math.log, exp=math.exp, sqrt=math.sqrt, pow=math.pow,
                      radians=math.radians, degrees=math.degrees, pi=math.pi)
_SQL = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, atan=F.atan, atan2=F.atan2,
                       log=F.log, exp=F.exp, sqrt=F.sqrt, pow=F.pow,
                       radians=F.radians, degrees=F.degrees, pi=math.pi)


def _ns(*values):
    return _SQL if any(isinstance(v, Column) for v in values) else _PY


# --------------------------------------------------------------------------- URIs
def srid_to_uri(srid) -> Column | str:
    """CRS-1: EPSG code -> OGC URI (Column or int)."""
    if isinstance(srid, Column):
        return F.concat(F.lit(EPSG_URI_PREFIX), srid.cast("string"))
    return f"{EPSG_URI_PREFIX}{int(srid)}"


def uri_to_srid(uri) -> Column | int | None:
    """CRS-2: URI -> EPSG code; CRS84 -> 4326; anything else -> null.

    Like ``parseInt`` the code is the leading run of digits after the prefix.
    """
    if isinstance(uri, Column):
        digits = F.regexp_extract(F.substring(uri, len(EPSG_URI_PREFIX) + 1, 1 << 20), r"^([0-9]+)", 1)
        return (F.when(uri == F.lit(CRS84_URI), F.lit(4326))
                .when(uri.startswith(EPSG_URI_PREFIX) & (digits != ""), digits.cast("int")))
    if uri == CRS84_URI:
        return 4326
    if isinstance(uri, str) and uri.startswith(EPSG_URI_PREFIX):
        rest = uri[len(EPSG_URI_PREFIX):]
        n = 0
        while n < len(rest) and rest[n].isdigit():
            n += 1
        return int(rest[:n]) if n else None
    return None


def supported_crs(native_srid) -> Column | list[str]:
    """CRS-3: CRS84, the base codes and the native code when not already listed."""
    if isinstance(native_srid, Column):
        base = [F.lit(CRS84_URI)] + [F.lit(srid_to_uri(s)) for s in BASE_SUPPORTED_SRIDS]
        return F.array_distinct(F.concat(F.array(*base), F.array(srid_to_uri(native_srid))))
    uris = [CRS84_URI] + [srid_to_uri(s) for s in BASE_SUPPORTED_SRIDS]
    if int(native_srid) not in BASE_SUPPORTED_SRIDS:
        uris.append(srid_to_uri(native_srid))
    return uris


def resolve_output_srid(crs_uri: str | None) -> tuple[int, str]:
    """CRS-3: missing or CRS84 -> (4326, CRS84); unknown -> ValueError."""
    if not crs_uri or crs_uri == CRS84_URI:
        return 4326, CRS84_URI
    srid = uri_to_srid(crs_uri)
    if srid is None:
        raise ValueError(f"Unsupported CRS: {crs_uri}")
    return srid, crs_uri


def check_supported(native_srid: int, crs_uri: str | None) -> int:
    """Resolve an output CRS and check it against the collection's list."""
    srid, uri = resolve_output_srid(crs_uri)
    if uri not in supported_crs(native_srid):
        raise ValueError(f"Unsupported CRS for this collection: {uri}")
    return srid


# --------------------------------------------------------------------- projections
def lonlat_to_mercator(lon, lat):
    m = _ns(lon, lat)
    x = MERC_A * m.radians(lon)
    y = MERC_A * m.log(m.tan(m.pi / 4 + m.radians(lat) / 2))
    return x, y


def mercator_to_lonlat(x, y):
    m = _ns(x, y)
    lon = m.degrees(x / MERC_A)
    lat = m.degrees(2 * m.atan(m.exp(y / MERC_A)) - m.pi / 2)
    return lon, lat


def lonlat_to_lambert93(lon, lat):
    m = _ns(lon, lat)
    phi = m.radians(lat)
    esin = L93_E * m.sin(phi)
    iso = m.log(m.tan(m.pi / 4 + phi / 2) * m.pow((1 - esin) / (1 + esin), L93_E / 2))
    r = L93_C * m.exp(-L93_N * iso)
    gamma = L93_N * (m.radians(lon) - math.radians(L93_LON0))
    return L93_XS + r * m.sin(gamma), L93_YS - r * m.cos(gamma)


def lambert93_to_lonlat(x, y):
    m = _ns(x, y)
    dx = x - L93_XS
    dy = L93_YS - y
    r = m.sqrt(dx * dx + dy * dy)
    gamma = m.atan2(dx, dy)
    iso = -m.log(r / L93_C) / L93_N
    lon = L93_LON0 + m.degrees(gamma / L93_N)
    exp_iso = m.exp(iso)
    phi = 2 * m.atan(exp_iso) - m.pi / 2
    for _ in range(L93_ITERATIONS):
        esin = L93_E * m.sin(phi)
        phi = 2 * m.atan(m.pow((1 + esin) / (1 - esin), L93_E / 2) * exp_iso) - m.pi / 2
    return lon, m.degrees(phi)


_TO_LONLAT = {4326: lambda x, y: (x, y), 3857: mercator_to_lonlat, 2154: lambert93_to_lonlat}
_FROM_LONLAT = {4326: lambda x, y: (x, y), 3857: lonlat_to_mercator, 2154: lonlat_to_lambert93}


def transform_xy(x, y, src: int, dst: int):
    """Transform one coordinate pair (Columns or floats) between supported SRIDs."""
    src, dst = int(src), int(dst)
    if src == dst:
        return x, y
    if src not in _TO_LONLAT or dst not in _FROM_LONLAT:
        raise ValueError(f"Unsupported transformation EPSG:{src} -> EPSG:{dst}")
    lon, lat = _TO_LONLAT[src](x, y)
    return _FROM_LONLAT[dst](lon, lat)


def transform_bbox(bbox, src: int, dst: int) -> tuple[float, float, float, float]:
    """SPA-2: transform the 4 corners of a box and take their envelope."""
    x1, y1, x2, y2 = (float(v) for v in bbox)
    if int(src) == int(dst):
        return min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)
    pts = [transform_xy(x, y, src, dst) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    xs = [p[0] for p in pts]
    ys = [p[1] for p in pts]
    return min(xs), min(ys), max(xs), max(ys)
