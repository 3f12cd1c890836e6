"""Edges by strips give the answer of all edges, for any polygon and with bounded lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoplane.functions import spatial as K
from geoplane.functions.geometry import Geom, with_bbox
from geoplane.operators import joins as J
from geoplane.operators import strips as ST
from geoplane.plans.collection import Collection
from tests.test_relate_columns import DDL, row


def rings(rng):
    """Stars, combs of tall teeth, flat bars, holes, two parts."""
    star = [((8 + 6 * rng.random()) * math.cos(t / 90 * math.pi), 9 * math.sin(t / 90 * math.pi)) for t in range(180)]
    comb = [(0, 0)] + [(x / 4, (x // 2 % 2) * 50 + 1) for x in range(1, 400)] + [(100, 0)]
    out = [[[star]], [[comb]], [[[(0, 0), (9, 0), (9, 1), (0, 1)]]], [[star, [(-1, -1), (1, -1), (0, 1)]]],
           [[[(0, 0), (5, 5), (0, 5)]], [[(20, 20), (30, 20), (25, 40)]]]]
    return [Geom("MultiPolygon", tuple(tuple(tuple((float(x), float(y)) for x, y in (*r, r[0])) for r in part) for part in g)) for g in out]


@pytest.mark.parametrize("op", ["s_intersects", "s_touches", "s_contains"])
def test_same_as_all_edges(spark, monkeypatch, op):
    monkeypatch.setattr(ST, "EDGES_PER_STRIP", 2)
    rng = random.Random(2)
    geoms = rings(rng)
    df = with_bbox(spark.createDataFrame([(f"g{i}", row(g)) for i, g in enumerate(geoms)], f"id string, geom {DDL}"))
    pts = [(float(x), float(y)) for x in range(-15, 40, 2) for y in range(-12, 52, 3)]
    pts += [v for g in geoms for v in g.vertices][::3] + [(0.0, 1.0), (4.5, 0.0)]
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "pid int, x double, y double")
    got = {(r[0], r[1]) for r in J.batch_point_lookup(Collection(df, name="c", geometry_type="MultiPolygon"), p, op=op).collect()}
    parts, x, y = F.col("geom")["parts"], F.col("x"), F.col("y")
    inside, edge = K.pip_inside(parts, x, y), K.on_boundary(parts, x, y)
    hit = {"s_intersects": inside | edge, "s_touches": edge, "s_contains": inside & ~edge}[op]
    assert got == {(r[0], r[1]) for r in p.join(F.broadcast(df), hit).select("pid", "id").collect()}


def test_lists_are_bounded_and_short(spark):
    rng = random.Random(3)
    geoms = rings(rng)
    wave = [(x / 100, 500 * math.sin(x / 3000)) for x in range(20_000)]
    geoms.append(Geom("Polygon", ((tuple([*wave, (200.0, -600.0), (0.0, -600.0), wave[0]]),),)))
    df = spark.createDataFrame([(i, row(g)) for i, g in enumerate(geoms)], f"id int, geom {DDL}")
    table = ST.strip_table(df, "id", "geom")
    sizes = {r["id"]: (r["n"], r["most"]) for r in table.groupBy("id").agg(
        F.sum(F.size("__edges")).alias("n"), F.max(F.size("__edges")).alias("most")).collect()}
    for i, g in enumerate(geoms):
        assert sizes[i][0] <= 4 * sum(1 for _ in g.edges())
    assert sizes[len(geoms) - 1][1] < 500                    # of 20,002 edges
