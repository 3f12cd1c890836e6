"""Registered queries of the exact relations: contained lines and polygons, near misses, batch radius on areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Geom
from ..operators import joins as J
from ..operators import relate as R
from ..operators import spatial as S
from . import collection as C
from . import tables as T
from .queries import CBOX, CUST, SUPP, query

# A zigzag and a box at the place of a customer that every scale factor has.
LINE = Geom.from_wkt("LINESTRING(1.68 43.78, 1.7 43.8, 1.71 43.78)")
RECT = Geom.from_wkt("POLYGON((1.68 43.78, 1.7 43.78, 1.7 43.8, 1.68 43.8, 1.68 43.78))")
HALF = "(0.02 + CAST(id % 11 AS DOUBLE) * 0.01)"


def _polygon(*points):
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in (*points, points[0])])
    return F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts"))


def _line(*points):
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])
    return F.struct(F.lit("LineString").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts"))


def _literal(g):
    def run(spark, sf_dir):
        c = T.customer_areas(spark, sf_dir)
        return c.df.filter(S.relate_literal(c, "s_contains", g)).select("id")
    return run


def _covers(x1, y1, x2, y2):
    return f"xmin <= {x1} AND ymin <= {y1} AND xmax >= {x2} AND ymax >= {y2}"


query("spa7_s_contains_line_literal", f"SELECT id FROM {CBOX} WHERE {_covers(1.68, 43.78, 1.71, 43.8)}")(_literal(LINE))
query("spa7_s_contains_polygon_literal", f"SELECT id FROM {CBOX} WHERE {_covers(1.68, 43.78, 1.7, 43.8)}")(_literal(RECT))


# Each supplier asks for the areas that hold a zigzag, or a triangle, at its place.
def _requests(spark, sf_dir, kind):
    s = T.suppliers(spark, sf_dir).df
    x, y = F.col("_xmin"), F.col("_ymin")
    points = ((x, y), (x + 0.01, y + 0.02), (x + 0.03, y + 0.01))
    return s.select(F.col("id").alias("gid"), (_line if kind == "line" else _polygon)(*points).alias("geom"))


def _contains(kind):
    return lambda spark, sf_dir: J.batch_predicate(T.customer_areas(spark, sf_dir), _requests(spark, sf_dir, kind), "s_contains")


_ASKED = (f"SELECT s.id AS gid, c.id FROM {SUPP} s JOIN {CBOX} c ON c.xmin <= s.x AND c.ymin <= s.y "
          "AND c.xmax >= s.x + 0.03 AND c.ymax >= s.y + 0.02")
query("jn10_batch_contains_lines", _ASKED)(_contains("line"))
query("jn10_batch_contains_polygons", _ASKED)(_contains("polygon"))


# ============================================================ corners on, and one rounding off, a sloped edge
# DuckDB decides by integers: every coordinate is a multiple of 2^-48.
_NEAR = {"x1": "x + 50.0", "y1": "y", "x2": "x + 50.0 + 3.0", "y2": "y + 2.01",
         "x3": "x + 50.0 + (CAST(id % 97 AS DOUBLE) + 1.0) / 99.0 * ((x + 50.0 + 3.0) - (x + 50.0))",
         "y3": "y + (CAST(id % 97 AS DOUBLE) + 1.0) / 99.0 * ((y + 2.01) - y)"}


def _near_edges(op):
    def run(spark, sf_dir):
        c = T.customers(spark, sf_dir).df.select("id", F.col("_xmin").alias("x"), F.col("_ymin").alias("y"))
        p = c.selectExpr("id", *[f"{e} AS {n}" for n, e in _NEAR.items()])
        a, b, q = ((F.col(f"x{n}"), F.col(f"y{n}")) for n in (1, 2, 3))
        pairs = p.select("id", _polygon(a, b, (a[0], b[1])).alias("upper"),
                         _polygon(q, (q[0] + 1.0, q[1] - 5.0), (q[0] + 2.0, q[1] - 5.0)).alias("lower"))
        return pairs.filter(R.relate_pair_column(op, "lower", "upper")).select("id")
    return run


_INT = {n: f"CAST(({e}) * 281474976710656.0 AS HUGEINT)" for n, e in _NEAR.items()}
_SIDE = "(x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)"
_EDGES = f"(SELECT id, {', '.join(f'{e} AS {n}' for n, e in _INT.items())} FROM {CUST})"
query("spa8_touches_near_edges", f"SELECT id FROM {_EDGES} WHERE {_SIDE} = 0")(_near_edges("s_touches"))
query("spa10_overlaps_near_edges", f"SELECT id FROM {_EDGES} WHERE {_SIDE} > 0")(_near_edges("s_overlaps"))
query("spa12_disjoint_near_edges", f"SELECT id FROM {_EDGES} WHERE {_SIDE} < 0")(_near_edges("s_disjoint"))


# ============================================================ JN-8 on areas: true distance to a box
def _radius_areas(spark, sf_dir):
    s = T.suppliers(spark, sf_dir).df.select(
        F.col("id").alias("pid"), F.col("_xmin").alias("lon"), F.col("_ymin").alias("lat"),
        (F.lit(5000.0) + (F.col("id") % 10).cast("double") * 2000.0).alias("radius_m"))
    out = J.batch_radius(T.customer_areas(spark, sf_dir), s)
    return out.select("pid", "id", F.round("distance_m", 3).alias("distance_m"))


_M = "radians(1.0) * 6371008.8"
_DIST = (f"sqrt(pow(greatest(c.xmin - s.x, 0.0, s.x - c.xmax) * cos(radians(s.y)) * {_M}, 2) + "
         f"pow(greatest(c.ymin - s.y, 0.0, s.y - c.ymax) * {_M}, 2))")
query("jn8_batch_radius_areas", f"SELECT s.id AS pid, c.id, round({_DIST}, 3) AS distance_m FROM {SUPP} s JOIN {CBOX} c "
      f"ON {_DIST} <= 5000.0 + CAST(s.id % 10 AS DOUBLE) * 2000.0")(_radius_areas)


# ============================================================ JN-7 on polygons of thousands of vertices
BLOCK = 2000


def skylines(spark, sf_dir) -> C.Collection:
    """One polygon for each block of 2000 customer keys: a flat base and a ragged upper line through the block."""
    c = T.read(spark, sf_dir, "customer").selectExpr(
        f"floor((c_custkey - 1) / {BLOCK}) AS id", "c_custkey AS k", f"{_SKY_X} AS x", f"{_SKY_Y} AS y")
    line = F.array_sort(F.collect_list(F.struct("k", "x", "y")))        # at most BLOCK rows a group
    poly = c.groupBy("id").agg(line.alias("v"), F.min("x").alias("_xmin"), F.max("x").alias("_xmax"),
                               (F.floor(F.col("id") / 10) * 30.0).alias("_ymin"), F.max("y").alias("_ymax"))

    def corner(x):
        return F.array(F.struct(F.col(x).alias("x"), F.col("_ymin").alias("y")))
    ring = F.concat(corner("_xmin"), F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))),
                    corner("_xmax"), corner("_xmin"))
    geom = F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts"))
    return C.Collection(poly.select("id", geom.alias("geom"), "_xmin", "_ymin", "_xmax", "_ymax"), name="skylines",
                        geometry_type="Polygon")


_SKY_X = f"(floor((c_custkey - 1) / {BLOCK}) % 10 * 21.0 - 100.0 + CAST((c_custkey - 1) % {BLOCK} AS DOUBLE) / 128.0)"
_SKY_Y = f"(floor(floor((c_custkey - 1) / {BLOCK}) / 10) * 30.0 + 4.0 + CAST(c_custkey * 7919 % 1009 AS DOUBLE) / 128.0)"
_SKY_PX = "(CAST(o_orderkey * 104729 % 13440 AS DOUBLE) / 64.0 - 100.0)"
_SKY_PY = "(CAST(o_orderkey * 7919 % 1153 AS DOUBLE) / 64.0 - 1.0)"


def _jn7_skylines(spark, sf_dir):
    pts = T.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS pid", f"{_SKY_PX} AS x", f"{_SKY_PY} AS y")
    return J.batch_point_lookup(skylines(spark, sf_dir), pts)


query("jn7_skyline_polygons", f"""WITH v AS (SELECT CAST(floor((c_custkey - 1) / {BLOCK}) AS BIGINT) AS id, c_custkey AS k,
  {_SKY_X} AS x, {_SKY_Y} AS y FROM customer),
e AS (SELECT id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY id ORDER BY k))
SELECT DISTINCT p.pid, e.id FROM (SELECT o_orderkey AS pid, {_SKY_PX} AS x, {_SKY_PY} AS y FROM orders) p
JOIN e ON p.x >= e.x1 AND p.x <= e.x2 AND (e.x2 - e.x1) * (p.y - e.y1) - (e.y2 - e.y1) * (p.x - e.x1) <= 0
  AND p.y >= floor(e.id / 10) * 30.0""")(_jn7_skylines)
