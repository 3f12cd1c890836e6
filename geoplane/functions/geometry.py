"""Geometry constructors and text forms (SCL-1, SCL-2, ING-10, ING-11, PRJ-5, PRJ-6).

Two halves:

* :class:`Geom` -- a *literal* geometry (a request's polygon, bbox or point),
  parsed once on the driver from WKT / GeoJSON; it turns into a Column literal.
* Column builders over the canonical ``geom`` struct of a feature table:
  point construction, bbox columns, Multi promotion, GeoJSON parsing and
  WKT / GeoJSON output -- all JVM-side expressions (no Python per row).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GEOM_DDL, GEOMETRY_TYPES
from . import crs as _crs


# ============================================================ driver-side literals
@dataclass(frozen=True)
class Geom:
    """A literal geometry: ``parts`` is part -> ring -> (x, y) tuples."""

    type: str
    parts: tuple = field(default_factory=tuple)
    srid: int = 4326

    # ---- constructors
    @staticmethod
    def point(x: float, y: float, srid: int = 4326) -> "Geom":
        return Geom("Point", ((((float(x), float(y)),),),), srid)

    @staticmethod
    def envelope(xmin: float, ymin: float, xmax: float, ymax: float, srid: int = 4326) -> "Geom":
        """ST_MakeEnvelope; the corners are ordered so minx > maxx does not wrap."""
        x1, x2 = sorted((float(xmin), float(xmax)))
        y1, y2 = sorted((float(ymin), float(ymax)))
        ring = ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))
        return Geom("Polygon", ((ring,),), srid)

    @staticmethod
    def from_bbox(values, srid: int = 4326) -> "Geom":
        """SPA-13: a JSON ``{bbox: [...]}`` literal (>= 4 numbers) as a 5-vertex polygon."""
        vals = [float(v) for v in values]
        if len(vals) < 4:
            raise ValueError("bbox needs at least 4 numbers")
        if len(vals) >= 6:   # 3-D box: minx, miny, minz, maxx, maxy, maxz
            return Geom.envelope(vals[0], vals[1], vals[3], vals[4], srid)
        return Geom.envelope(vals[0], vals[1], vals[2], vals[3], srid)

    @staticmethod
    def from_wkt(text: str, srid: int = 4326) -> "Geom":
        return _parse_wkt(text, srid)

    @staticmethod
    def from_geojson(obj, srid: int = 4326) -> "Geom":
        if isinstance(obj, str):
            obj = json.loads(obj)
        return _geojson_to_geom(obj, srid)

    # ---- properties
    @property
    def vertices(self) -> list[tuple[float, float]]:
        return [v for part in self.parts for ring in part for v in ring]

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        vs = self.vertices
        xs = [v[0] for v in vs]
        ys = [v[1] for v in vs]
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def dimension(self) -> int:
        return 0 if self.type in ("Point", "MultiPoint") else 1 if "Line" in self.type else 2

    def edges(self):
        """All ring segments ((x1, y1), (x2, y2)) of lines and polygon rings."""
        for part in self.parts:
            for ring in part:
                for a, b in zip(ring, ring[1:]):
                    yield a, b

    def transform(self, dst: int) -> "Geom":
        """Reproject the literal (driver side): the column is never transformed."""
        if int(dst) == int(self.srid):
            return self
        parts = tuple(tuple(tuple(_crs.transform_xy(x, y, self.srid, dst) for x, y in ring)
                            for ring in part) for part in self.parts)
        return Geom(self.type, parts, int(dst))

    def to_wkt(self) -> str:
        def pt(v):
            return f"{_fmt(v[0])} {_fmt(v[1])}"

        def ring(r):
            return "(" + ",".join(pt(v) for v in r) + ")"

        t = self.type
        if t == "Point":
            return f"POINT({pt(self.parts[0][0][0])})"
        if t == "MultiPoint":
            return "MULTIPOINT(" + ",".join("(" + pt(p[0][0]) + ")" for p in self.parts) + ")"
        if t == "LineString":
            return "LINESTRING" + ring(self.parts[0][0])
        if t == "MultiLineString":
            return "MULTILINESTRING(" + ",".join(ring(p[0]) for p in self.parts) + ")"
        if t == "Polygon":
            return "POLYGON(" + ",".join(ring(r) for r in self.parts[0]) + ")"
        return "MULTIPOLYGON(" + ",".join("(" + ",".join(ring(r) for r in p) + ")" for p in self.parts) + ")"

    def to_column(self) -> Column:
        """The literal as a ``geom`` struct Column."""
        parts = F.array(*[
            F.array(*[F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
                                for x, y in ring]) for ring in part])
            for part in self.parts])
        return F.struct(F.lit(self.type).alias("type"), F.lit(int(self.srid)).alias("srid"),
                        parts.cast("array<array<array<struct<x:double,y:double>>>>").alias("parts"))


def _fmt(v: float) -> str:
    s = repr(float(v))
    if "e" in s or "E" in s:
        s = f"{float(v):.9f}"
    if "." in s:
        s = s.rstrip("0").rstrip(".")
    return s if s not in ("-0",) else "0"


_WKT_TOKEN = re.compile(r"\s*([A-Za-z]+|\(|\)|,|[-+0-9.eE]+)")


def _parse_wkt(text: str, srid: int) -> Geom:
    tokens = [t for t in _WKT_TOKEN.findall(text.strip()) if t]
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else None

    def take(expected=None):
        nonlocal pos
        tok = peek()
        if tok is None or (expected is not None and tok.upper() != expected):
            raise ValueError(f"Invalid WKT near {tok!r}: {text!r}")
        pos += 1
        return tok

    def coord():
        x = float(take())
        y = float(take())
        while peek() not in (",", ")"):
            take()   # drop Z/M ordinates: 2-D model only
        return (x, y)

    def seq(item):
        take("(")
        items = [item()]
        while peek() == ",":
            take(",")
            items.append(item())
        take(")")
        return items

    def ring():
        return tuple(seq(coord))

    def point_in_multi():
        if peek() == "(":
            take("(")
            c = coord()
            take(")")
            return c
        return coord()

    kind = take().upper()
    if peek() and peek().upper() in ("Z", "M", "ZM"):
        take()
    if peek() and peek().upper() == "EMPTY":
        raise ValueError("EMPTY geometries are not supported as literals")
    if kind == "POINT":
        c = seq(coord)[0]
        return Geom("Point", (((c,),),), srid)
    if kind == "MULTIPOINT":
        return Geom("MultiPoint", tuple(((c,),) for c in seq(point_in_multi)), srid)
    if kind == "LINESTRING":
        return Geom("LineString", ((ring(),),), srid)
    if kind == "MULTILINESTRING":
        return Geom("MultiLineString", tuple((r,) for r in seq(ring)), srid)
    if kind == "POLYGON":
        return Geom("Polygon", (tuple(seq(ring)),), srid)
    if kind == "MULTIPOLYGON":
        return Geom("MultiPolygon", tuple(tuple(p) for p in seq(lambda: seq(ring))), srid)
    raise ValueError(f"Unsupported WKT geometry type {kind!r}")


def _geojson_to_geom(obj: dict, srid: int) -> Geom:
    t = obj.get("type")
    c = obj.get("coordinates")
    if t not in GEOMETRY_TYPES or c is None:
        raise ValueError(f"Unsupported GeoJSON geometry: {t!r}")

    def v(p):
        return (float(p[0]), float(p[1]))

    def r(ring):
        return tuple(v(p) for p in ring)

    if t == "Point":
        parts = (((v(c),),),)
    elif t == "MultiPoint":
        parts = tuple(((v(p),),) for p in c)
    elif t == "LineString":
        parts = ((r(c),),)
    elif t == "MultiLineString":
        parts = tuple((r(line),) for line in c)
    elif t == "Polygon":
        parts = (tuple(r(ring) for ring in c),)
    else:
        parts = tuple(tuple(r(ring) for ring in poly) for poly in c)
    return Geom(t, parts, srid)


# ============================================================ Column builders
def xy(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column, srid: int = 4326, multi: bool = False) -> Column:
    """ST_MakePoint + ST_SetSRID (+ ST_Multi when ``multi``)."""
    return F.struct(F.lit("MultiPoint" if multi else "Point").alias("type"),
                    F.lit(int(srid)).alias("srid"),
                    F.array(F.array(F.array(xy(x, y)))).alias("parts"))


def vertices(geom: Column) -> Column:
    """All vertices of a geometry as one array<struct<x,y>>."""
    return F.flatten(F.flatten(geom["parts"]))


def bbox_columns(geom: Column) -> dict[str, Column]:
    vs = vertices(geom)
    xs = F.transform(vs, lambda v: v["x"])
    ys = F.transform(vs, lambda v: v["y"])
    return {"_xmin": F.array_min(xs), "_ymin": F.array_min(ys),
            "_xmax": F.array_max(xs), "_ymax": F.array_max(ys)}


def with_bbox(df, geom_col: str = "geom"):
    """Add the four top-level bbox columns computed from the geometry."""
    return df.withColumns(bbox_columns(F.col(geom_col)))


def set_srid(geom: Column, srid: int) -> Column:
    """ING-12: tag only, no reprojection."""
    return F.when(geom.isNotNull(), geom.withField("srid", F.lit(int(srid))))


def promote_multi(geom: Column) -> Column:
    """ING-11 ST_Multi: Point->MultiPoint, LineString->MultiLineString, Polygon->MultiPolygon.

    The part/ring/vertex layout is already the Multi layout, so only the type changes.
    """
    t = geom["type"]
    return F.when(geom.isNotNull(), geom.withField(
        "type", F.when(t.startswith("Multi"), t).otherwise(F.concat(F.lit("Multi"), t))))


def transform_geom(geom: Column, src: int, dst: int) -> Column:
    """PRJ-7 / CRS-4..6: reproject every vertex; skipped when the SRIDs are equal."""
    if int(src) == int(dst):
        return geom

    def vertex(v):
        x, y = _crs.transform_xy(v["x"], v["y"], src, dst)
        return F.struct(x.alias("x"), y.alias("y"))

    parts = F.transform(geom["parts"], lambda part: F.transform(
        part, lambda ring: F.transform(ring, vertex)))
    return F.when(geom.isNotNull(), F.struct(geom["type"].alias("type"), F.lit(int(dst)).alias("srid"),
                                             parts.alias("parts")))


# ------------------------------------------------------------------ text output
def fmt_number(c: Column, decimals: int = 9) -> Column:
    """Shortest decimal text of a double rounded to ``decimals`` places (no exponent)."""
    s = c.cast(f"decimal(38,{decimals})").cast("string")
    s = F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(s == "-0", F.lit("0")).otherwise(s)


def _wkt_pt(v, d):
    return F.concat(fmt_number(v["x"], d), F.lit(" "), fmt_number(v["y"], d))


def _wkt_ring(r, d):
    return F.concat(F.lit("("), F.array_join(F.transform(r, lambda v: _wkt_pt(v, d)), ","), F.lit(")"))


def to_wkt(geom: Column, decimals: int = 9) -> Column:
    """PRJ-6 ST_AsText, e.g. ``POINT(2.35 48.85)``."""
    t = geom["type"]
    p = geom["parts"]
    body = (
        F.when(t == "Point", F.concat(F.lit("("), _wkt_pt(p[0][0][0], decimals), F.lit(")")))
        .when(t == "MultiPoint", F.concat(F.lit("("), F.array_join(F.transform(
            p, lambda part: F.concat(F.lit("("), _wkt_pt(part[0][0], decimals), F.lit(")"))), ","), F.lit(")")))
        .when(t == "LineString", _wkt_ring(p[0][0], decimals))
        .when(t == "MultiLineString", F.concat(F.lit("("), F.array_join(F.transform(
            p, lambda part: _wkt_ring(part[0], decimals)), ","), F.lit(")")))
        .when(t == "Polygon", F.concat(F.lit("("), F.array_join(F.transform(
            p[0], lambda r: _wkt_ring(r, decimals)), ","), F.lit(")")))
        .otherwise(F.concat(F.lit("("), F.array_join(F.transform(
            p, lambda part: F.concat(F.lit("("), F.array_join(F.transform(
                part, lambda r: _wkt_ring(r, decimals)), ","), F.lit(")"))), ","), F.lit(")")))
    )
    return F.when(geom.isNotNull(), F.concat(F.upper(t), body))


def _gj_pt(v, d):
    return F.concat(F.lit("["), fmt_number(v["x"], d), F.lit(","), fmt_number(v["y"], d), F.lit("]"))


def _gj_list(arr, fn):
    return F.concat(F.lit("["), F.array_join(F.transform(arr, fn), ","), F.lit("]"))


def to_geojson(geom: Column, decimals: int = 9) -> Column:
    """PRJ-5 ST_AsGeoJSON: ``{"type":..,"coordinates":..}`` text, 9 decimals.

    Like PostGIS a ``crs`` member names the EPSG code when it is not 4326.
    """
    t = geom["type"]
    p = geom["parts"]
    coords = (
        F.when(t == "Point", _gj_pt(p[0][0][0], decimals))
        .when(t == "MultiPoint", _gj_list(p, lambda part: _gj_pt(part[0][0], decimals)))
        .when(t == "LineString", _gj_list(p[0][0], lambda v: _gj_pt(v, decimals)))
        .when(t == "MultiLineString", _gj_list(p, lambda part: _gj_list(part[0], lambda v: _gj_pt(v, decimals))))
        .when(t == "Polygon", _gj_list(p[0], lambda r: _gj_list(r, lambda v: _gj_pt(v, decimals))))
        .otherwise(_gj_list(p, lambda part: _gj_list(part, lambda r: _gj_list(r, lambda v: _gj_pt(v, decimals)))))
    )
    crs_member = F.when(geom["srid"] != 4326, F.concat(
        F.lit(',"crs":{"type":"name","properties":{"name":"EPSG:'), geom["srid"].cast("string"), F.lit('"}}'))
    ).otherwise(F.lit(""))
    return F.when(geom.isNotNull(), F.concat(F.lit('{"type":"'), t, F.lit('"'), crs_member,
                                             F.lit(',"coordinates":'), coords, F.lit("}")))


# ------------------------------------------------------------------ GeoJSON input
_COORD_SCHEMA = {
    "Point": "array<double>",
    "MultiPoint": "array<array<double>>",
    "LineString": "array<array<double>>",
    "MultiLineString": "array<array<array<double>>>",
    "Polygon": "array<array<array<double>>>",
    "MultiPolygon": "array<array<array<array<double>>>>",
}


def from_geojson(text: Column, srid: int = 4326) -> Column:
    """ING-10 ST_GeomFromGeoJSON for a column of geometry JSON text.

    Two ``from_json`` passes: the envelope with ``coordinates`` kept as text,
    then the coordinates with the array depth given by the type.  Unknown
    types, missing coordinates and nulls give a null geometry.  Extra
    ordinates (Z/M) are dropped: the model is 2-D.
    """
    env = F.from_json(text, "struct<type:string,coordinates:string>")
    t = env["type"]
    c = env["coordinates"]

    def v(p):
        return F.struct(p[0].alias("x"), p[1].alias("y"))

    def ring(r):
        return F.transform(r, v)

    parts = (
        F.when(t == "Point", F.array(F.array(F.array(v(F.from_json(c, _COORD_SCHEMA["Point"]))))))
        .when(t == "MultiPoint", F.transform(F.from_json(c, _COORD_SCHEMA["MultiPoint"]),
                                             lambda p: F.array(F.array(v(p)))))
        .when(t == "LineString", F.array(F.array(ring(F.from_json(c, _COORD_SCHEMA["LineString"])))))
        .when(t == "MultiLineString", F.transform(F.from_json(c, _COORD_SCHEMA["MultiLineString"]),
                                                  lambda line: F.array(ring(line))))
        .when(t == "Polygon", F.array(F.transform(F.from_json(c, _COORD_SCHEMA["Polygon"]), ring)))
        .when(t == "MultiPolygon", F.transform(F.from_json(c, _COORD_SCHEMA["MultiPolygon"]),
                                               lambda poly: F.transform(poly, ring)))
    )
    ok = t.isin(*GEOMETRY_TYPES) & parts.isNotNull()
    return F.when(ok, F.struct(t.alias("type"), F.lit(int(srid)).alias("srid"),
                               parts.alias("parts"))).cast(GEOM_DDL)
