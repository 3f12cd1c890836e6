"""The relations as Spark expressions against the exact brute force, on every predicate."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from geoplane.functions import sqltext as S
from geoplane.functions.geometry import Geom
from geoplane.operators import relate as R
from geoplane.operators.spatial import SPATIAL_OPS
from geoplane.plans.collection import Collection
from tests import relate_kernel as B
from tests.test_relate import CASES

DDL = "struct<type:string,srid:int,parts:array<array<array<struct<x:double,y:double>>>>>"


def row(g):
    return (g.type, 4326, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in g.parts])


def kernel(g):
    return B.Shape(g.type, [[list(r) for r in p] for p in g.parts])


def compare(spark, pairs):
    """All predicates of all pairs in one job."""
    rows = [(i, row(a), row(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"i int, a {DDL}, b {DDL}").repartition(8)
    shapes = df.select("i", R.shape(S.col("a")).column().alias("a"), R.shape(S.col("b")).column().alias("b"))
    cells = shapes.select("i", R.cells(S.col("a"), S.col("b")).column().alias("c"))
    got = cells.select("i", *[R.holds(S.col("c"), op).column().alias(op) for op in SPATIAL_OPS]).collect()
    bad = []
    for r in got:
        a, b = pairs[r["i"]]
        ka, kb = kernel(a), kernel(b)
        m = B._matrix(ka, kb)
        for op in SPATIAL_OPS:
            if r[op] is not B.relate(ka, kb, op, m):
                bad.append((op, r[op], a.to_wkt(), b.to_wkt()))
    assert not bad, bad[:3]


def as_geom(s):
    if s.dim == 0:
        return Geom("MultiPoint", tuple(((tuple(map(float, p)),),) for p in s.points))
    if s.dim == 1:
        return Geom("MultiLineString", tuple((tuple(tuple(map(float, v)) for v in ln),) for ln in s.lines))
    return Geom("MultiPolygon", tuple(tuple(tuple(tuple(map(float, v)) for v in r) for r in p) for p in s.polys))


def test_hand_checked_cases(spark):
    pairs = [(as_geom(a), as_geom(b)) for a, b, _, _ in CASES]
    compare(spark, pairs + [(b, a) for a, b in pairs])


def box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]


def random_geom(rng):
    n = lambda: rng.randint(0, 5)
    kind = rng.choice(["box", "tri", "holed", "two", "line", "loop", "lines", "points", "ell"])
    x, y, w, h = n(), n(), rng.randint(1, 4), rng.randint(1, 4)
    if kind == "box":
        ring = box(x, y, x + w, y + h)
        return Geom("Polygon", ((tuple(ring if rng.random() < 0.5 else ring[::-1]),),))
    if kind == "tri":
        while True:
            p = [(n(), n()) for _ in range(3)]
            if (p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) != (p[1][1] - p[0][1]) * (p[2][0] - p[0][0]):
                return Geom("Polygon", ((tuple([*p, p[0]]),),))
    if kind == "holed":
        hole = rng.choice([box(1, 1, 3, 3), [(0, 0), (2, 1), (1, 2), (0, 0)], [(0, 2), (2, 3), (2, 1), (0, 2)], box(2, 2, 4, 3)])
        return Geom("Polygon", ((tuple(box(0, 0, 5, 5)), tuple(hole)),))
    if kind == "two":
        return Geom("MultiPolygon", ((tuple(box(x, y, x + 1, y + 1)),), (tuple(box(x + 1, y + 1, x + 1 + w, y + 1 + h)),)))
    if kind == "ell":
        return Geom("Polygon", ((((x, y), (x + 3, y), (x + 3, y + 1), (x + 1, y + 1), (x + 1, y + 3), (x, y + 3), (x, y)),),))
    if kind == "loop":
        return Geom("LineString", ((tuple(box(x, y, x + w, y + h)),),))
    if kind == "points":
        return Geom("MultiPoint", tuple((((n(), n()),),) for _ in range(rng.randint(1, 3))))

    def path():     # simple: x never falls
        xs = sorted(rng.sample(range(6), rng.randint(2, 3)))
        return tuple((v, n()) for v in xs)
    if kind == "line":
        return Geom("LineString", ((path(),),))
    p = path()
    return Geom("MultiLineString", ((p,), ((p[-1], (p[-1][0] + 1, n())),)))


def test_random_pairs_on_a_small_grid(spark):
    rng = random.Random(11)
    compare(spark, [(random_geom(rng), random_geom(rng)) for _ in range(1500)])


def test_random_pairs_turned_and_moved(spark):
    """The same pairs after a turn by rounded coordinates: edges that nearly touch, none of them exact."""
    rng = random.Random(12)
    out = []
    for _ in range(500):
        t, s, dx = rng.random() * 7, rng.choice([1e-6, 1.0, 1e5]), rng.choice([0.0, 47.01, 6.6e6])
        turn = lambda g, t=t, s=s, dx=dx: Geom(g.type, tuple(tuple(tuple((
            dx + s * (x * math.cos(t) - y * math.sin(t)), dx + s * (x * math.sin(t) + y * math.cos(t)))
            for x, y in r) for r in p) for p in g.parts))
        a, b = (turn(Geom("Polygon", ((tuple(box(x := rng.randint(0, 3), y := rng.randint(0, 3), x + 2, y + 2)),),)))
                for _ in range(2))
        out.append((a, b))
    compare(spark, out)


def test_near_misses(spark):
    up = lambda v, n: math.nextafter(v, math.inf) if n == 1 else v
    out = []
    for gap in (1e-11, 1e-12, 1e-14):
        out.append((Geom("Polygon", ((tuple(box(0, 0, 1, 1)),),)), Geom("Polygon", ((tuple(box(1 + gap, 0, 2, 1)),),))))
    # a corner on, or one ulp off, a sloped edge
    for x in (0.1, 0.3, 1.7, 2.9, 3.3):
        on = x * 47.01 / 3.0
        for k in (-1, 0, 1):
            y = math.nextafter(on, math.inf * k) if k else on
            out.append((Geom("Polygon", ((((x, y), (x + 1, y - 40), (x + 1, y - 30), (x, y)),),)),
                        Geom("Polygon", ((((0, 0), (3.0, 47.01), (0, 47.01), (0, 0)),),))))
    compare(spark, out)
    far = Geom("Polygon", ((tuple(box(0, 0, 1, 1)),),)), Geom("Polygon", ((tuple(box(up(1.0, 1), 0, 2, 1)),),))
    rows = spark.createDataFrame([(row(far[0]), row(far[1]))], f"a {DDL}, b {DDL}")
    assert rows.select(R.relate_pair_column("s_disjoint", "a", "b")).first()[0] is True


def test_orientation_is_exact(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        s = rng.choice([1e-9, 1.0, 1e7])
        a, b = [(rng.uniform(-s, s), rng.uniform(-s, s)) for _ in range(2)]
        t = rng.random()
        c = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))            # on the line but for rounding
        rows.append((*a, *b, *c))
    rows += [(0.5, 0.5, 12.0, 12.0, 24.0, 24.0), (0.1, 0.1, 0.2, 0.2, 0.3, 0.3), (1.0, 1.0, 1.0, 1.0, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double")
    got = df.select("*", R.orient(*[(S.col(f"{p}x"), S.col(f"{p}y")) for p in "abc"]).column().alias("o")).collect()
    zero = 0
    for r in got:
        ax, ay, bx, by, cx, cy = map(Fraction, r[:6])
        d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        assert r["o"] == (d > 0) - (d < 0)
        zero += d == 0
    assert zero < len(rows) / 2


@pytest.mark.parametrize("op", SPATIAL_OPS)
def test_literal_form_equals_pair_form(spark, op):
    rng = random.Random(3)
    geoms = [random_geom(rng) for _ in range(60)]
    df = spark.createDataFrame([(i, row(g)) for i, g in enumerate(geoms)], f"id int, geom {DDL}")
    lit = Geom("Polygon", ((tuple(box(1, 1, 4, 4)), tuple(box(2, 2, 3, 3))),))
    coll = Collection(df, name="mixed", geometry_type="Polygon")
    got = {r[0]: r[1] for r in df.select("id", R.relate_column(coll, op, lit)).collect()}
    assert got == {i: B.relate(kernel(g), kernel(lit), op) for i, g in enumerate(geoms)}


def test_null_and_empty_geometries(spark):
    lit = Geom("Polygon", ((tuple(box(0, 0, 2, 2)),),))
    df = spark.createDataFrame([(1, None), (2, ("Polygon", 4326, [])), (3, ("Polygon", 4326, [[[(0.0, 0.0), (1.0, 1.0)]]])),
                                (4, row(lit))], f"id int, geom {DDL}")
    coll = Collection(df, name="odd", geometry_type="Polygon")
    got = {r[0]: tuple(r[1:]) for r in df.select(
        "id", *[R.relate_column(coll, op, lit).alias(op) for op in ("s_intersects", "s_disjoint", "s_equals")]).collect()}
    assert got == {1: (None,) * 3, 2: (False, True, False), 3: (False, True, False), 4: (True, False, True)}


def test_distances(spark):
    rng = random.Random(4)
    geoms = [random_geom(rng) for _ in range(200)]
    probes = [(rng.uniform(-1, 7), rng.uniform(-1, 7)) if i % 3 else (rng.randint(0, 5), rng.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame([(i, row(g), float(x), float(y)) for i, (g, (x, y)) in enumerate(zip(geoms, probes, strict=True))],
                               f"i int, g {DDL}, x double, y double")
    got = {r[0]: r[1] for r in df.select("i", R.distance_to_point_column(F.col("g"), F.col("x"), F.col("y"))).collect()}
    for i, (g, (x, y)) in enumerate(zip(geoms, probes, strict=True)):
        assert got[i] == pytest.approx(B.min_distance_m(kernel(g), x, y), rel=1e-9, abs=1e-6)


def test_a_box_that_no_edge_meets_decides_contains(spark):
    """Where the box decides, it says what the exact relation says; holes, islands, touching and odd rings included."""
    rng = random.Random(11)
    ring = lambda x, y, w, h: ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))
    star = tuple((5 + (4 if k % 2 else 9) * math.cos(k * math.pi / 7), 5 + (4 if k % 2 else 9) * math.sin(k * math.pi / 7)) for k in range(14))
    areas = [Geom("Polygon", ((ring(0, 0, 10, 10), ring(3, 3, 4, 4)[::-1]),)), Geom("Polygon", (((*star, star[0]),),)),
             Geom("MultiPolygon", ((ring(0, 0, 3, 10),), (ring(5, 0, 5, 10), ring(6, 4, 3, 3)[::-1]), (ring(7, 5, 1, 1),)))]
    small = []
    for _ in range(250):
        x, y, w, h = (rng.choice((rng.uniform(-1, 10), rng.randrange(11))) for _ in range(4))
        w, h = w % 3 + 0.25, h % 3 + 0.25
        small.append(rng.choice((Geom("Polygon", ((ring(x, y, w, h),),)), Geom("LineString", ((((x, y), (x + w, y + h)),),)),
                                 Geom("Polygon", ((((x, y), (x + w, y), (x, y + h), (x, y)),),)), Geom("Point", ((((x, y),),),)))))
    small += [Geom("LineString", ((((1.0, 1.0), (1.0, 1.0)),),)), Geom("Polygon", ((((1.0, 1.0), (2.0, 1.0), (2.0, 1.0), (1.0, 1.0)),),)),
              Geom("MultiPolygon", ((ring(1, 1, 1, 1),), (ring(2.5, 5, 0.25, 1),)))]
    pairs = [(a, b) for a in areas for b in small]
    open_ring = Geom("Polygon", ((ring(0, 0, 10, 10)[:-1],),))
    df = spark.createDataFrame([(i, row(a), row(b)) for i, (a, b) in enumerate([*pairs, (open_ring, small[0])])], f"i int, a {DDL}, b {DDL}")
    xs, ys = F.transform(F.flatten(F.flatten("b.parts")), lambda v: v["x"]), F.transform(F.flatten(F.flatten("b.parts")), lambda v: v["y"])
    said = F.when(R.plain_part(F.col("b")), R.contains_box_column(F.col("a"), F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    got = {r["i"]: r["s"] for r in df.select("i", said.alias("s")).collect()}
    told = [i for i in range(len(pairs)) if got[i] is not None]
    assert len(told) > len(pairs) / 3 and {got[i] for i in told} == {True, False} and got[len(pairs)] is None
    wrong = [(pairs[i][0].to_wkt(), pairs[i][1].to_wkt()) for i in told if got[i] is not B.relate(kernel(pairs[i][0]), kernel(pairs[i][1]), "s_contains")]
    assert not wrong, wrong[:3]
    assert all(got[k * len(small) + i] is None for k in range(3) for i in range(250, 253))


def test_lines_away_from_the_edges_need_no_relation(spark, monkeypatch):
    """JN-10 on lines: with the exact relation left out, only pairs at an edge are missing."""
    from geoplane.functions import geometry as G
    from geoplane.operators import joins as J
    hole = Geom("Polygon", ((((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ((4, 4), (4, 6), (6, 6), (6, 4), (4, 4))),))
    df = spark.createDataFrame([(1, row(hole))], f"id int, geom {DDL}")
    coll = Collection(G.with_bbox(df), name="areas", geometry_type="Polygon")
    lines = [Geom("LineString", (((a, b),),)) for a, b in (
        ((1.0, 1.0), (2.0, 2.0)), ((7.0, 7.0), (9.0, 8.0)),          # held
        ((4.5, 4.5), (5.5, 5.5)), ((20.0, 1.0), (21.0, 2.0)),        # in the hole, outside
        ((3.5, 3.0), (4.5, 5.0)), ((0.0, 0.0), (1.0, 1.0)))]         # over the hole's edge, from a corner
    asked = spark.createDataFrame([(i, row(g)) for i, g in enumerate(lines)], f"gid int, geom {DDL}")
    ask = lambda: sorted(r["gid"] for r in J.batch_predicate(coll, asked, "s_contains").collect())
    assert ask() == [i for i, g in enumerate(lines) if B.relate(kernel(hole), kernel(g), "s_contains")] == [0, 1, 5]
    monkeypatch.setattr(R, "relate_pair_column", lambda *a: F.lit(None).cast("boolean"))
    assert ask() == [0, 1]
