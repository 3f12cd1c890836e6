"""(Multi)point fast paths agree with the relate kernel on every predicate."""

import pytest
from pyspark.sql import functions as F

from geoplane.functions.geometry import Geom
from tests import relate_kernel as R
from geoplane.operators import spatial as S
from geoplane.plans.collection import Collection

LITERALS = [
    Geom.from_wkt("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"),
    Geom.from_wkt("LINESTRING(0 0, 4 4)"),
    Geom.from_wkt("MULTIPOINT((1 1), (3 3))"),
    Geom.point(1, 1),
]
FEATURES = ["MULTIPOINT((1 1))", "MULTIPOINT((1 1),(5 5))", "MULTIPOINT((0 0),(2 0))", "MULTIPOINT((1 1),(3 3))",
            "MULTIPOINT((2 2))", "MULTIPOINT((0 0))", "MULTIPOINT((1 2),(2 1))", "MULTIPOINT((9 9))"]


@pytest.fixture(scope="module")
def mp(spark):
    rows = []
    for i, w in enumerate(FEATURES):
        g = Geom.from_wkt(w)
        rows.append((i, [[[{"x": x, "y": y}] ] for x, y in g.vertices]))
    df = spark.createDataFrame(rows, "id int, parts array<array<array<struct<x:double,y:double>>>>")
    df = df.withColumn("geom", F.struct(F.lit("MultiPoint").alias("type"), F.lit(4326).alias("srid"), F.col("parts"))).drop("parts")
    from geoplane.functions.geometry import with_bbox
    return Collection(with_bbox(df), name="mp", geometry_type="MultiPoint")


@pytest.mark.parametrize("lit", LITERALS, ids=lambda g: g.type)
def test_fast_path_equals_kernel(mp, lit):
    for op in S.SPATIAL_OPS:
        fast = {r["id"] for r in mp.df.filter(S.relate_literal(mp, op, lit)).select("id").collect()}
        shape_lit = R._literal_shape(lit)
        want = set()
        for i, w in enumerate(FEATURES):
            g = Geom.from_wkt(w)
            if R.relate(R.Shape(g.type, [[list(r) for r in p] for p in g.parts]), shape_lit, op):
                want.add(i)
        assert fast == want, (op, lit.type)


def test_batch_predicate_mixed_request_kinds(spark):
    from geoplane.functions.geometry import Geom
    from geoplane.operators import joins as J
    from geoplane.plans import tables as T
    c = T.customers(spark, "/root/testdata/sf0.001")
    pts = [(r["_xmin"], r["_ymin"]) for r in c.df.select("_xmin", "_ymin").limit(3).collect()]
    lits = {1: Geom.from_wkt(f"LINESTRING({pts[0][0]} {pts[0][1]}, {pts[1][0]} {pts[1][1]})"),
            2: Geom.point(*pts[2]),
            3: Geom.from_wkt("POLYGON((0 44, 3 44, 3 47, 0 47, 0 44))")}
    geoms = spark.createDataFrame([(k, g.type) for k, g in lits.items()], "gid int, t string")
    from pyspark.sql import functions as F
    geoms = geoms.withColumn("geom", F.when(F.col("gid") == 1, lits[1].to_column())
                             .when(F.col("gid") == 2, lits[2].to_column()).otherwise(lits[3].to_column()))
    for op in ("s_intersects", "s_within", "s_touches"):
        got = {(r["gid"], r["id"]) for r in J.batch_predicate(c, geoms, op).collect()}
        want = set()
        for k, g in lits.items():
            want |= {(k, r["id"]) for r in c.df.filter(S.relate_literal(c, op, g)).select("id").collect()}
        assert got == want, op


def test_batch_radius_on_polygons_matches_literal(spark):
    from geoplane.operators import joins as J
    from geoplane.plans import tables as T
    areas = T.customer_areas(spark, "/root/testdata/sf0.001")
    probes = [(1, 2.35, 48.86, 60000.0), (2, 0.5, 45.0, 30000.0), (3, 7.0, 43.5, 5000.0)]
    pdf = spark.createDataFrame(probes, "pid int, lon double, lat double, radius_m double")
    got = {(r["pid"], r["id"]) for r in J.batch_radius(areas, pdf).collect()}
    want = set()
    for pid, lon, lat, r in probes:
        want |= {(pid, x["id"]) for x in areas.df.filter(S.radius(areas, lon, lat, r)).select("id").collect()}
    assert got == want and len(got) > 0


def test_point_lookup_of_large_polygons_does_not_depend_on_cells(spark):
    """Large polygons (holes, concave): every cell size gives the pairs of the literal test, ids keep their type."""
    import math as _m
    from geoplane.functions.geometry import with_bbox
    from geoplane.operators import joins as J
    polys = []
    for k in range(6):
        cx, cy, r = 1.0 + k * 1.7, 45.0 + (k % 2) * 1.3, 0.9
        star = [(cx + (r if i % 2 == 0 else r / 2.2) * _m.cos(i * _m.pi / 40), cy + (r if i % 2 == 0 else r / 2.2) * _m.sin(i * _m.pi / 40))
                for i in range(80)]
        star.append(star[0])
        hole = [(cx - 0.1, cy - 0.1), (cx + 0.1, cy - 0.1), (cx + 0.1, cy + 0.1), (cx - 0.1, cy + 0.1), (cx - 0.1, cy - 0.1)]
        polys.append((k, [[[{"x": a, "y": b} for a, b in star], [{"x": a, "y": b} for a, b in hole]]]))
    df = spark.createDataFrame([(f"star-{k}", parts) for k, parts in polys],
                               "id string, parts array<array<array<struct<x:double,y:double>>>>")
    df = with_bbox(df.withColumn("geom", F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.col("parts"))).drop("parts"))
    coll = Collection(df, name="stars", geometry_type="Polygon")
    pts = spark.range(20000).select(F.col("id").alias("pid"), (F.lit(-0.5) + (F.col("id") * 7919 % 12000) / 1000.0).alias("x"),
                                    (F.lit(43.5) + (F.col("id") * 104729 % 4000) / 1000.0).alias("y"))
    for op in ("s_intersects", "s_contains"):
        found = [{tuple(r) for r in J.batch_point_lookup(coll, pts, op=op, cell=cell).collect()}
                 for cell in (None, 0.37, 5.0)]
        assert found[0] == found[1] == found[2] and len(found[0]) > 100, op
        assert {i for _, i in found[0]} <= {f"star-{k}" for k in range(6)}


def test_batch_predicate_large_polygon_requests(spark):
    import math as _m
    from geoplane.operators import joins as J
    from geoplane.plans import tables as T
    c = T.customers(spark, "/root/testdata/sf0.001")
    ring = [(2.0 + 2.0 * _m.cos(i * _m.pi / 30) * (1 if i % 2 else 0.55), 46.0 + 2.0 * _m.sin(i * _m.pi / 30) * (1 if i % 2 else 0.55))
            for i in range(60)]
    ring.append(ring[0])
    g = Geom("Polygon", ((tuple(ring),),))
    geoms = spark.createDataFrame([(1,)], "gid int").withColumn("geom", g.to_column())
    for op in ("s_intersects", "s_within", "s_touches"):
        got = {r["id"] for r in J.batch_predicate(c, geoms, op).collect()}
        want = {r["id"] for r in c.df.filter(S.relate_literal(c, op, g)).select("id").collect()}
        assert got == want, op
    assert len(want) >= 0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=3, max_size=7, unique=True))
def test_point_kernels_equal_relate_kernel(spark, verts):
    import math as _m
    cx = sum(v[0] for v in verts) / len(verts)
    cy = sum(v[1] for v in verts) / len(verts)
    ring = sorted(verts, key=lambda v: _m.atan2(v[1] - cy, v[0] - cx))       # star-shaped, simple
    ring = ring + [ring[0]]
    g = Geom("Polygon", ((tuple((float(x), float(y)) for x, y in ring),),))
    if abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) == 0:
        return
    from geoplane.functions.geometry import point, with_bbox
    pts = [(i * 9 + j, float(i), float(j)) for i in range(9) for j in range(9)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    c = Collection(with_bbox(df.withColumn("geom", point(F.col("x"), F.col("y"))).drop("x", "y")), name="g",
                   geometry_type="Point")
    lit = R._literal_shape(g)
    for op in ("s_intersects", "s_within", "s_touches", "s_disjoint"):
        fast = {r["id"] for r in c.df.filter(S.relate_literal(c, op, g)).select("id").collect()}
        want = {i for i, x, y in pts if R.relate(R.Shape("Point", [[[(x, y)]]]), lit, op)}
        assert fast == want, op


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=3, max_size=6, unique=True),
                min_size=1, max_size=3))
def test_batch_column_kernels_equal_literal(spark, polys):
    import math as _m
    from geoplane.functions.geometry import point, with_bbox
    from geoplane.operators import joins as J
    lits = {}
    for k, verts in enumerate(polys):
        cx = sum(v[0] for v in verts) / len(verts)
        cy = sum(v[1] for v in verts) / len(verts)
        ring = sorted(verts, key=lambda v: _m.atan2(v[1] - cy, v[0] - cx))
        ring = ring + [ring[0]]
        if abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) == 0:
            continue
        lits[k] = Geom("Polygon", ((tuple((float(x), float(y)) for x, y in ring),),))
    if not lits:
        return
    pts = [(i * 9 + j, float(i), float(j)) for i in range(9) for j in range(9)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    c = Collection(with_bbox(df.withColumn("geom", point(F.col("x"), F.col("y"))).drop("x", "y")), name="g",
                   geometry_type="Point")
    geoms = None
    for k, g in lits.items():
        one = spark.range(1).select(F.lit(k).alias("gid"), g.to_column().alias("geom"))
        geoms = one if geoms is None else geoms.unionByName(one)
    for op in ("s_intersects", "s_within", "s_touches"):
        got = {(r["gid"], r["id"]) for r in J.batch_predicate(c, geoms, op).collect()}
        want = set()
        for k, g in lits.items():
            want |= {(k, r["id"]) for r in c.df.filter(S.relate_literal(c, op, g)).select("id").collect()}
        assert got == want, op


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=3, max_size=7, unique=True),
       st.sampled_from([1.0, 2.0, 0.5]))
def test_lookup_boundaries_for_every_cell_size(spark, verts, cell):
    """Cell borders on polygon edges and vertices, points on edges: one answer for all cell sizes."""
    import math as _m
    from geoplane.functions.geometry import with_bbox
    from geoplane.operators import joins as J
    cx = sum(v[0] for v in verts) / len(verts)
    cy = sum(v[1] for v in verts) / len(verts)
    ring = sorted(verts, key=lambda v: _m.atan2(v[1] - cy, v[0] - cx))
    ring = ring + [ring[0]]
    if abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) == 0:
        return
    parts = [[[{"x": float(x), "y": float(y)} for x, y in ring]]]
    df = spark.createDataFrame([(1, parts)], "id int, parts array<array<array<struct<x:double,y:double>>>>")
    df = with_bbox(df.withColumn("geom", F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"),
                                                  F.col("parts"))).drop("parts"))
    coll = Collection(df, name="p", geometry_type="Polygon")
    pts = spark.createDataFrame([(i * 100 + j, i / 2.0, j / 2.0) for i in range(-1, 18) for j in range(-1, 18)],
                                "pid int, x double, y double")
    for op in ("s_intersects", "s_contains"):
        a = {tuple(r) for r in J.batch_point_lookup(coll, pts, op=op, cell=cell).collect()}
        b = {tuple(r) for r in J.batch_point_lookup(coll, pts, op=op, cell=cell * 3).collect()}
        assert a == b, (op, cell)
