"""MVT encoding: decode round trip on the reference's tile smoke cases (FIXTURES 1)."""

from pyspark.sql import functions as F

from geoplane.functions import geometry as G
from geoplane.operators import mvt as M
from geoplane.operators import tiles as TL
from geoplane.plans.collection import Collection

from . import mvt_kernel as K
from .fixtures import sites


def test_tile_smoke(spark):
    s = sites(spark)
    blobs = {(r["z"], r["x"], r["y"]): r["mvt"] for r in M.tile_blobs(s, [5], ["name"], salt=3).collect()}
    assert (5, 16, 11) in blobs                  # Paris tile is non-empty
    assert (5, 0, 0) not in blobs                # empty tile -> no content
    req = spark.createDataFrame([(5, 16, 11), (5, 0, 0), (99, 0, 0)], "z int, x bigint, y bigint")
    counts = TL.pyramid_counts(s, [5])
    out = {(r["z"], r["x"]): (r["valid"], r["n_features"]) for r in TL.tile_requests(req, counts).collect()}
    assert out[(5, 16)][0] and out[(5, 16)][1] >= 1
    assert out[(5, 0)] == (True, None) and out[(99, 0)][0] is False
    layer = M.decode(bytes(blobs[(5, 16, 11)]))[0]
    assert layer["name"] == "sites" and layer["keys"] == ["name"] and layer["extent"] == 4096
    names = {layer["values"][f["tags"][1]] for f in layer["features"]}
    assert "Paris" in names
    assert all(f["type"] == 1 for f in layer["features"])


def test_points_quantized_like_expressions(spark):
    s = sites(spark)
    blobs = M.tile_blobs(s, [7], ["name"], salt=4).collect()
    q = {(r["z"], r["x"], r["y"], r["name"]): (r["qx"], r["qy"])
         for r in TL.point_tile_features(s, [7], ["name"]).collect()}
    for r in blobs:
        for f in M.decode(bytes(r["mvt"]))[0]["features"]:
            g = f["geometry"]
            x = (g[1] >> 1) ^ -(g[1] & 1)
            y = (g[2] >> 1) ^ -(g[2] & 1)
            layer = M.decode(bytes(r["mvt"]))[0]
            name = layer["values"][f["tags"][1]]
            assert q[(r["z"], r["x"], r["y"], name)] == (x, y)


def test_polygon_clipped_and_oriented(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
                     for x, y in [(-10.0, 40.0), (20.0, 40.0), (20.0, 60.0), (-10.0, 60.0), (-10.0, 40.0)]])
    df = spark.createDataFrame([(1, "big")], "id int, name string").withColumn(
        "geom", F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts")))
    c = Collection(G.with_bbox(df), name="areas", geometry_type="Polygon")
    blobs = M.tile_blobs(c, [6], ["name"], salt=2).collect()
    assert len(blobs) > 4
    for r in blobs:
        f = M.decode(bytes(r["mvt"]))[0]["features"][0]
        assert f["type"] == 3
        g = f["geometry"]
        assert g[0] == 9 and g[-1] == 15           # MoveTo(1) ... ClosePath


def test_jvm_point_tiles_byte_identical(spark):
    from .test_skew import _hot_points
    c = _hot_points(spark)
    for salt in (1, 5):
        py = {(r["z"], r["x"], r["y"]): bytes(r["mvt"]) for r in K.tile_blobs(c, [3, 6], salt=salt).collect()}
        jvm = {(r["z"], r["x"], r["y"]): bytes(r["mvt"]) for r in M.tile_blobs(c, [3, 6], salt=salt).collect()}
        assert py == jvm and len(py) > 3


def test_jvm_multipoint_tiles_byte_identical(spark):
    from pyspark.sql import functions as F
    rows = []
    for i in range(200):
        pts = [(2.0 + (i % 17) * 0.3 + k * 0.9, 45.0 + (i % 11) * 0.2 + k * 0.4) for k in range(1 + i % 3)]
        rows.append((i, f"n{i % 7}" if i % 5 else None, [[[{"x": x, "y": y}]] for x, y in pts]))
    df = spark.createDataFrame(rows, "id int, name string, parts array<array<array<struct<x:double,y:double>>>>")
    df = G.with_bbox(df.withColumn("geom", F.struct(F.lit("MultiPoint").alias("type"), F.lit(4326).alias("srid"),
                                                    F.col("parts"))).drop("parts"))
    c = Collection(df, name="mp", geometry_type="MultiPoint")
    py = {(r["z"], r["x"], r["y"]): bytes(r["mvt"]) for r in K.tile_blobs(c, [5, 8], ["name"], salt=3).collect()}
    jvm = {(r["z"], r["x"], r["y"]): bytes(r["mvt"]) for r in M.tile_blobs(c, [5, 8], ["name"], salt=3).collect()}
    assert py == jvm and len(py) > 5


def _joined(parts, layer, props):
    """The tiles that their parts make."""
    tiles = {}
    for r in sorted(parts, key=lambda r: r["part"]):
        f, v = tiles.setdefault((r["z"], r["x"], r["y"]), (bytearray(), bytearray()))
        f += r["features"]
        v += r["values"]
    return {k: M.layer_head(layer, props, len(f) + len(v)) + bytes(f) + bytes(v) + M.LAYER_TAIL
            for k, (f, v) in tiles.items() if f}


def test_parts_make_the_same_tiles(spark):
    from .test_skew import _hot_points
    c = _hot_points(spark)
    props = [a for _, a in c.exposed_columns()]
    for salt in (1, 5):
        whole = {(r["z"], r["x"], r["y"]): bytes(r["mvt"]) for r in M.tile_blobs(c, [3, 6], salt=salt).collect()}
        assert _joined(M.tile_parts(c, [3, 6], salt=salt).collect(), c.name, props) == whole


def test_a_part_is_bounded_whatever_the_tile_holds(spark, monkeypatch):
    from geoplane.plans import queries_imports as QI
    from geoplane.plans import tables as T
    c = T.orders(spark, "/root/testdata/sf0.001")
    c.exposed_fields = [("o_orderstatus", "flag"), ("o_custkey", "qty")]
    n = c.df.count()
    counts = M.part_counts(c, [0, 4], 50)
    assert counts[0] == -(-n // 50) and 1 <= counts[4] <= counts[0] and M.part_counts(c, [0, 4], n) == {0: 1, 4: 1}
    parts = M.tile_parts(c, [0, 4], salt=counts).collect()
    read = {(r["z"], r["x"], r["y"], r["part"]): QI.decoded_part(bytes(r["features"]), bytes(r["values"]), r["first_value"],
                                                                 ["flag", "qty"]) for r in parts}
    assert max(v[0] for v in read.values()) < 120
    assert sum(v[0] for k, v in read.items() if k[0] == 0) == n
    assert sum(v[3] for k, v in read.items() if k[0] == 0) == c.df.agg(F.sum("o_custkey")).first()[0]


def test_points_move_once_and_parts_are_bounded(spark, monkeypatch):
    """Groups of neighbours make the parts of all tiles: same drawn features and values as whole tiles, ids that
    repeat with other values included; no (tile, feature) row is shuffled."""
    monkeypatch.setattr(M, "PART_FEATURES", 50)
    monkeypatch.setattr(M, "GROUP_POINTS", 200)
    rows = [(i % 700, f"n{i % 7}" if i % 5 else None, i, 2.0 + (i % 37) * 0.11 if i % 3 else 2.0, 45.0 + (i % 23) * 0.07 if i % 3 else 45.0)
            for i in range(1500)] + [(9000, "edge", -1, -180.0, 85.0), (9001, None, -2, 180.0, -85.0)]
    df = spark.createDataFrame(rows, "id int, name string, k int, lon double, lat double")
    df = G.with_bbox(df.select("id", "name", "k", G.point(F.col("lon"), F.col("lat")).alias("geom")))
    c = Collection(df, name="pts", geometry_type="Point")
    zooms = [0, 3, 6, 9]

    def drawn(blob):
        layer = M.decode(bytes(blob))[0]
        return sorted((tuple(f["geometry"]), tuple(sorted((layer["keys"][k], layer["values"][v]) for k, v in zip(f["tags"][::2], f["tags"][1::2]))))
                      for f in layer["features"])
    for bound in (M.BROADCAST_PARTS, 0):
        monkeypatch.setattr(M, "BROADCAST_PARTS", bound)
        got = M.tile_parts(c, zooms, ["name", "k"])
        parts = got.collect()
        tiles = {k: drawn(v) for k, v in _joined(parts, "pts", ["name", "k"]).items()}
        for z in zooms:
            assert sum(len(v) for k, v in tiles.items() if k[0] == z) >= len(rows)
        # one id a row: whole tiles name the same values
        ids = Collection(df.withColumn("id", F.col("k")), name="pts", geometry_type="Point")
        assert tiles == {(r["z"], r["x"], r["y"]): drawn(r["mvt"]) for r in M.tile_blobs(ids, zooms, ["name", "k"], salt=3).collect()}
        keys = [(r["z"], r["x"], r["y"], r["part"]) for r in parts]
        assert len(set(keys)) == len(keys)
        assert max(len(M.decode(M.layer_head("p", [], len(r["features"])) + bytes(r["features"]) + M.LAYER_TAIL)[0]["features"])
                   for r in parts) <= 50
        if bound:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(__gx" in plan and "hashpartitioning(z" not in plan.split("BroadcastExchange")[0]


def test_decoded_tiles_shuffle_points_and_sums_only(spark):
    import __spark_entry__ as E
    plan = E.queries()["til5_agg12_decoded_tiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.split("BroadcastExchange")[0].splitlines() if " Exchange " in line or "- Exchange " in line]
    # the sums of a tile's parts, then the points; the parts' starts are broadcast
    assert len(rows) == 2 and "hashpartitioning(z" in rows[0] and "hashpartitioning(__gx" in rows[1]
