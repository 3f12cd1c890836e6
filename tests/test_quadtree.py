"""Tiles of lines and areas by descent: against the per-feature encoder, by plan, and on edge cases."""

import random

from pyspark.sql import functions as F

from geoplane.functions import geometry as G
from geoplane.operators import mvt as M
from geoplane.operators import quadtree as Q
from geoplane.operators import tiles as TL
from geoplane.plans.collection import Collection

from . import mvt_kernel as K

PARTS = "id int, name string, type string, parts array<array<array<struct<x:double,y:double>>>>"


def _collection(spark, rows, kind):
    rows = [(i, n, t, None if parts is None else [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts])
            for i, n, t, parts in rows]
    df = spark.createDataFrame(rows, PARTS)
    geom = F.when(F.col("parts").isNotNull(), F.struct("type", F.lit(4326).alias("srid"), "parts"))
    return Collection(G.with_bbox(df.select("id", "name", geom.alias("geom"))), name="shapes", geometry_type=kind)


def _lines(n=30, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        parts = []
        for _ in range(1 + i % 2):
            x, y = r.uniform(-20, 30), r.uniform(30, 60)
            pts = [(x, y)]
            for _ in range(r.randint(1, 7)):
                pts.append((pts[-1][0] + r.uniform(-4, 4), max(-80, min(80, pts[-1][1] + r.uniform(-3, 3)))))
            parts.append([pts])
        out.append((i, f"n{i % 3}" if i % 4 else None, "MultiLineString", parts))
    return out


def _stars(n=30, seed=9):
    """Polygons around a centre with changing radius (concave), some with a hole."""
    import math
    r = random.Random(seed)
    out = []
    for i in range(n):
        cx, cy, k = r.uniform(-15, 25), r.uniform(35, 55), r.randint(3, 12)
        turn = sorted(r.uniform(0, 2 * math.pi) for _ in range(k))
        radius = [r.uniform(0.5, 6) for _ in range(k)]
        ring = [(cx + q * math.cos(t), cy + q * math.sin(t)) for t, q in zip(turn, radius)]
        rings = [ring + ring[:1]]
        if i % 3 == 0:
            hole = [(cx + 0.2 * math.cos(t), cy + 0.2 * math.sin(t)) for t in (0.1, 2.2, 4.3)]
            rings.append(hole + hole[:1])
        out.append((i, f"n{i % 3}", "Polygon", [rings]))
    return out


def _rings(cmds):
    """Point lists of a geometry's commands."""
    out, x, y, i = [], 0, 0, 0
    while i < len(cmds):
        op, n = cmds[i] & 7, cmds[i] >> 3
        i += 1
        if op == 7:
            continue
        if op == 1:
            out.append([])
        for _ in range(n):
            x += (cmds[i] >> 1) ^ -(cmds[i] & 1)
            y += (cmds[i + 1] >> 1) ^ -(cmds[i + 1] & 1)
            out[-1].append((x, y))
            i += 2
    return out


def _tiles(blobs):
    out = {}
    for r in blobs.collect():
        layer = M.decode(bytes(r["mvt"]))[0]
        feats = []
        for f in layer["features"]:
            tags = {layer["keys"][k]: layer["values"][v] for k, v in zip(f["tags"][::2], f["tags"][1::2])}
            feats.append((sorted(tags.items()), f["type"], _rings(f["geometry"])))
        out[(r["z"], r["x"], r["y"])] = feats
    return out


def _length(lines):
    return sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for q in lines for a, b in zip(q, q[1:]))


def _area(rings):
    return sum(a[0] * b[1] - b[0] * a[1] for q in rings for a, b in zip(q, q[1:] + q[:1])) / 2


def _holds(rings, p):
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0])
               for q in rings for a, b in zip(q, q[1:] + q[:1])) % 2 == 1


def _same(spark, coll, size, slack):
    zooms = [0, 4, 6]
    plain, native = _tiles(K.tile_blobs(coll, zooms, ["name"], salt=3)), _tiles(M.tile_blobs(coll, zooms, ["name"], salt=3))
    assert plain.keys() == native.keys() and len(plain) > 50
    for tile, want in plain.items():
        got = native[tile]
        assert len(got) == len(want), tile
        for (gt, gk, gr), (wt, wk, wr) in zip(got, want):
            assert (gt, gk) == (wt, wk)
            assert abs(size(gr) - size(wr)) <= slack(gr), tile
            if gk == 2:
                for axis in (0, 1):
                    mine, theirs = [p[axis] for q in gr for p in q], [p[axis] for q in wr for p in q]
                    assert abs(min(mine) - min(theirs)) <= 1 and abs(max(mine) - max(theirs)) <= 1
            else:        # clipping may leave spikes without area along a side, so points inside decide
                spots = [(dx * 509 - 243.5, dy * 509 - 244.5) for dx in range(9) for dy in range(9)]
                assert sum(_holds(gr, p) != _holds(wr, p) for p in spots) <= 1, tile


def test_lines_equal_the_plain_encoder(spark):
    _same(spark, _collection(spark, _lines(), "MultiLineString"), _length, lambda q: 3 * sum(map(len, q)))


def test_areas_equal_the_plain_encoder(spark):
    # a vertex may round to the neighbouring unit: at most the outline's length in area
    _same(spark, _collection(spark, _stars(), "Polygon"), _area, lambda q: 4 + _length([r + r[:1] for r in q]))


def test_rounds_are_narrow_and_explode_no_box(spark):
    c = _collection(spark, _stars(5), "Polygon")
    plan = Q.tile_features(c, [6])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "sequence(" not in plan
    assert "Python" not in M.tile_blobs(c, [6], ["name"])._jdf.queryExecution().executedPlan().toString()


def test_a_diagonal_takes_the_tiles_it_crosses_only(spark):
    c = _collection(spark, [(1, "d", "LineString", [[[(-100.0, -60.0), (100.0, 60.0)]]])], "LineString")
    n = Q.tile_features(c, [10]).count()
    assert 500 < n < 3000 and TL.assign_tiles(c, [10]).count() > 200000


def test_spreading_changes_nothing(spark):
    c = _collection(spark, _lines(20), "MultiLineString")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(Q.tile_features(c, [2, 5, 6], spread=2)) == key(Q.tile_features(c, [2, 5, 6]))


def test_edge_cases(spark):
    """Null, empty, collapsed and repeated features, a ring around a tile, and mixed collections."""
    around = [(-30.0, 30.0), (40.0, 30.0), (40.0, 70.0), (-30.0, 70.0), (-30.0, 30.0)]
    inner = [(-29.0, 31.0), (39.0, 31.0), (39.0, 69.0), (-29.0, 69.0), (-29.0, 31.0)]
    dot = [(5.0, 45.0)] * 4
    areas = _collection(spark, [(1, "null", "Polygon", None), (2, "empty", "Polygon", []), (3, "dot", "Polygon", [[dot]]),
                                (4, "frame", "Polygon", [[around, inner]]), (4, "frame", "Polygon", [[around, inner]])], "Polygon")
    tiles = _tiles(M.tile_blobs(areas, [6], ["name"]))
    assert {t[0][1] for fs in tiles.values() for tags, _, _ in fs for t in [tags]} == {"frame"}
    assert all(len(fs) == 2 for fs in tiles.values())
    x, y = 34, 22        # a tile of zoom 6 in the frame's window
    assert (6, x, y) not in tiles
    lines = _collection(spark, [(1, "dot", "LineString", [[dot]]), (2, "one", "LineString", [[[(5.0, 45.0)]]])], "LineString")
    assert M.tile_blobs(lines, [0, 6], ["name"]).count() == 0 and TL.pyramid_counts(lines, [0, 6]).count() == 0
    assert Q.tile_features(lines, []).count() == 0
    mixed = _collection(spark, [(1, "p", "Point", [[[(5.0, 45.0)]]]), (2, "l", "LineString", [[[(4.0, 44.0), (6.0, 46.0)]]]),
                                (3, "a", "Polygon", [[around]]), (4, None, "Polygon", None)], "Geometry")
    assert TL.pyramid_counts(mixed, [0]).first()["n_features"] == 3
    assert sorted(k for _, k, _ in _tiles(M.tile_blobs(mixed, [0], ["name"]))[(0, 0, 0)]) == [1, 2, 3]


def test_few_features_are_dealt_over_the_partitions(spark):
    """Adaptive execution joins small shuffle partitions again unless their number is given."""
    c = _collection(spark, _stars(80), "Polygon")
    c = c.with_df(c.df.coalesce(1))
    d = Q.descend(c, [9])
    assert d._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2      # first, and after eight
    met = d.select(F.spark_partition_id().alias("p")).distinct().count()
    assert met == int(spark.conf.get("spark.sql.shuffle.partitions"))
