"""Spatial predicates of a collection (SPA-1..14), literal (single request) form.

Every builder returns ``bbox prefilter AND exact refine``.  The prefilter is
four comparisons on the top-level bbox columns, which Catalyst pushes into
the Parquet scan.  The refine is a Catalyst expression for Point and
MultiPoint features (literal tests, quantified over the vertices)
and for point literals against (multi)polygon features; line/polygon pairs
use the exact relations of :mod:`geoplane.operators.relate`.

The literal is transformed to the storage SRID on the driver (the column is
never transformed), as the reference does to keep its index usable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import crs as _crs
from ..functions import spatial as K
from ..functions.geometry import Geom

SPATIAL_OPS = ("s_intersects", "s_within", "s_contains", "s_touches",
               "s_crosses", "s_overlaps", "s_equals", "s_disjoint")


def _store(coll, g: Geom) -> Geom:
    return g.transform(coll.srid)


def _point_xy(coll):
    # for Point features the bbox collapses onto the point itself
    return F.col("_xmin"), F.col("_ymin")


# ---------------------------------------------------------------- SPA-1, SPA-2
def bbox(coll, box, bbox_crs: int | str | None = None) -> Column:
    """SPA-1/2: envelope overlap with a box given in 4326 (or ``bbox_crs``).

    Boxes of other than 4 numbers are ignored (no condition), as in the
    reference; the corners are re-ordered so minx > maxx does not wrap.
    """
    if box is None or len(box) != 4:
        return F.lit(True)
    src = 4326
    if bbox_crs is not None:
        src = bbox_crs if isinstance(bbox_crs, int) else _crs.resolve_output_srid(bbox_crs)[0]
    x1, y1, x2, y2 = _crs.transform_bbox(box, src, coll.srid)
    return K.bbox_overlaps(x1, y1, x2, y2)


# ---------------------------------------------------------------- SPA-3
def point_intersects(coll, lon: float, lat: float) -> Column:
    """SPA-3: features containing or touching a lon/lat point."""
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError("lat must be in [-90, 90] and lon in [-180, 180]")
    return relate_literal(coll, "s_intersects", Geom.point(lon, lat))


# ---------------------------------------------------------------- SPA-4
def radius(coll, lon: float, lat: float, radius_m: float) -> Column:
    """SPA-4: features within ``radius_m`` metres of a lon/lat point.

    Points: haversine distance <= r behind a lon/lat box prefilter.  Lines and
    polygons: true minimum distance (deviation D1).
    """
    if radius_m is None or radius_m <= 0:
        raise ValueError("radius must be > 0")
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError("lat must be in [-90, 90] and lon in [-180, 180]")
    boxes = K.radius_box(lon, lat, radius_m)
    if coll.srid != 4326:
        boxes = [_crs.transform_bbox(b, 4326, coll.srid) for b in boxes]
    pre = None
    for b in boxes:
        c = K.bbox_overlaps(*b)
        pre = c if pre is None else (pre | c)
    if coll.geometry_type == "Point":
        px, py = _point_xy(coll)
        if coll.srid != 4326:
            px, py = _crs.transform_xy(px, py, coll.srid, 4326)
        return pre & (K.haversine_m(px, py, lon, lat) <= F.lit(float(radius_m)))
    if coll.geometry_type == "MultiPoint":
        vs = F.flatten(F.flatten(F.col(coll.geometry_column)["parts"]))

        def near(v):
            x, y = _crs.transform_xy(v["x"], v["y"], coll.srid, 4326) if coll.srid != 4326 else (v["x"], v["y"])
            return K.haversine_m(x, y, lon, lat) <= F.lit(float(radius_m))
        return pre & F.exists(vs, near)
    from . import relate
    return pre & relate.within_distance(coll, Geom.point(lon, lat), radius_m)


# ---------------------------------------------------------------- SPA-5..12
def relate_literal(coll, op: str, g: Geom) -> Column:
    """S_* predicate between the feature geometry and a literal geometry."""
    op = op.lower()
    if op not in SPATIAL_OPS:
        raise ValueError(f"Unknown spatial operator: {op}")
    g = _store(coll, g)
    if op == "s_disjoint":
        # no bbox prune is possible: bbox-disjoint features qualify
        inter = relate_literal(coll, "s_intersects", g)
        return F.coalesce(~inter, F.lit(False)) & F.col(coll.geometry_column).isNotNull()
    xmin, ymin, xmax, ymax = g.bbox
    if op == "s_within":
        # the feature must lie inside the literal's box
        pre = ((F.col("_xmin") >= xmin) & (F.col("_xmax") <= xmax)
               & (F.col("_ymin") >= ymin) & (F.col("_ymax") <= ymax))
    elif op in ("s_contains", "s_equals"):
        # the feature's box must cover the literal's box
        pre = ((F.col("_xmin") <= xmin) & (F.col("_xmax") >= xmax)
               & (F.col("_ymin") <= ymin) & (F.col("_ymax") >= ymax))
    else:
        pre = K.bbox_overlaps(xmin, ymin, xmax, ymax)
    return pre & _refine(coll, op, g)


def _refine(coll, op: str, g: Geom) -> Column:
    if coll.geometry_type == "Point":
        return _refine_point_feature(op, g, *_point_xy(coll))
    if coll.geometry_type == "MultiPoint":
        return _refine_multipoint_feature(op, g, F.flatten(F.flatten(F.col(coll.geometry_column)["parts"])))
    if g.type == "Point" and coll.geometry_type in ("Polygon", "MultiPolygon"):
        return _refine_polygon_feature_point_literal(coll, op, g)
    from . import relate
    return relate.relate_column(coll, op, g)


def _refine_point_feature(op: str, g: Geom, px: Column, py: Column) -> Column:
    """Exact DE-9IM outcomes for a single-point feature against any literal."""
    dim = g.dimension
    if dim == 0:
        eqv = K.point_equals_literal(g, px, py)
        if op == "s_intersects":
            return eqv
        if op == "s_within":
            return eqv
        if op == "s_contains" or op == "s_equals":
            # a point contains / equals the literal only if every literal vertex is that point
            out = F.lit(True)
            for x, y in g.vertices:
                out = out & (px == F.lit(x)) & (py == F.lit(y))
            return out
        return F.lit(False)          # touches / crosses / overlaps: impossible for point vs points
    if dim == 1:
        on = K.on_boundary_literal(g, px, py)
        ends = K.line_endpoints(g)
        at_end = F.lit(False)
        for x, y in ends:
            at_end = at_end | ((px == F.lit(x)) & (py == F.lit(y)))
        if op == "s_intersects":
            return on
        if op == "s_within":
            return on & ~at_end
        if op == "s_touches":
            return at_end
        return F.lit(False)          # contains / equals / crosses / overlaps
    inside = K.pip_inside_literal(g, px, py)
    edge = K.on_boundary_literal(g, px, py)
    if op == "s_intersects":
        return inside | edge
    if op == "s_within":
        return inside & ~edge
    if op == "s_touches":
        return edge
    return F.lit(False)


def _point_locations(g: Geom):
    """(interior, boundary) Column predicates of a point against the literal."""
    dim = g.dimension
    if dim == 0:
        return (lambda x, y: K.point_equals_literal(g, x, y)), (lambda x, y: F.lit(False))
    if dim == 1:
        ends = K.line_endpoints(g)

        def at_end(x, y):
            out = F.lit(False)
            for ex, ey in ends:
                out = out | ((x == F.lit(ex)) & (y == F.lit(ey)))
            return out
        return (lambda x, y: K.on_boundary_literal(g, x, y) & ~at_end(x, y)), at_end
    return ((lambda x, y: K.pip_inside_literal(g, x, y) & ~K.on_boundary_literal(g, x, y)),
            (lambda x, y: K.on_boundary_literal(g, x, y)))


def _refine_multipoint_feature(op: str, g: Geom, vs: Column) -> Column:
    """DE-9IM outcomes for a (multi)point feature given as its vertex array, against any literal.

    Quantifiers over the vertices (``exists`` / ``forall``) with the
    literal tests inside -- Catalyst expressions, no Python.
    """
    interior, boundary = _point_locations(g)

    def any_(f):
        return F.exists(vs, lambda v: f(v["x"], v["y"]))

    def all_(f):
        return F.forall(vs, lambda v: f(v["x"], v["y"]))

    hit = (lambda x, y: interior(x, y) | boundary(x, y))
    if op == "s_intersects":
        return any_(hit)
    if op == "s_within":
        return all_(hit) & any_(interior)
    if op == "s_touches":
        return any_(boundary) & ~any_(interior)
    if op == "s_crosses":
        return F.lit(g.dimension > 0) & any_(interior) & ~all_(hit)
    if g.dimension == 0:
        lit_pts = set(g.vertices)
        covers_lit = F.lit(True)
        def same(x, y):
            return lambda v: (v["x"] == F.lit(x)) & (v["y"] == F.lit(y))
        for x, y in lit_pts:
            covers_lit = covers_lit & F.exists(vs, same(x, y))
        if op == "s_contains":
            return covers_lit
        if op == "s_equals":
            return covers_lit & all_(hit)
        if op == "s_overlaps":
            return any_(hit) & ~all_(hit) & ~covers_lit
    return F.lit(False)             # contains / equals / overlaps against lines or polygons


def _refine_polygon_feature_point_literal(coll, op: str, g: Geom) -> Column:
    parts = F.col(coll.geometry_column)["parts"]
    x, y = g.vertices[0]
    px, py = F.lit(x), F.lit(y)
    inside = K.pip_inside(parts, px, py)
    edge = K.on_boundary(parts, px, py)
    if op == "s_intersects":
        return inside | edge
    if op == "s_contains":
        return inside & ~edge
    if op == "s_touches":
        return edge
    return F.lit(False)              # within / crosses / overlaps / equals


# ---------------------------------------------------------------- SPA-13
def bbox_literal(values) -> Geom:
    """SPA-13: ``{"bbox": [...]}`` operand -> 5-vertex polygon literal."""
    return Geom.from_bbox(values)
