"""Hot keys: a third of all features at one location must not change results
(salted shuffle joins, salted MVT chunks) -- SURVEY scale rules."""

from pyspark.sql import functions as F

from geoplane.functions import geometry as G
from geoplane.operators import joins as J
from geoplane.operators import mvt as M
from geoplane.plans.collection import Collection

from . import mvt_kernel as K


def _hot_points(spark, n=3000):
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(2.35)).otherwise(F.lit(-4.0) + (F.col("id") % 97) / 10.0).alias("lon"),
        F.when(F.col("id") % 3 == 0, F.lit(48.86)).otherwise(F.lit(42.0) + (F.col("id") % 89) / 10.0).alias("lat"),
        (F.col("id") % 5).cast("string").alias("cls"))
    df = df.withColumn("geom", G.point(F.col("lon"), F.col("lat"))).drop("lon", "lat")
    return Collection(G.with_bbox(df), name="hot", geometry_type="Point", exposed_fields=[("cls", None)])


def _boxes(spark):
    rows = [(i, 2.0 + (i % 5) * 0.1, 48.5 + (i % 3) * 0.1, 2.6 + (i % 5) * 0.1, 49.0 + (i % 3) * 0.1) for i in range(40)]
    return spark.createDataFrame(rows, "req_id int, _xmin double, _ymin double, _xmax double, _ymax double")


def test_hot_cell_join_same_under_salt_and_shuffle(spark):
    c = _hot_points(spark)
    base = sorted(map(tuple, J.batch_bbox(c, _boxes(spark), cell=0.05).collect()))
    shuffled = sorted(map(tuple, J.batch_bbox(c, _boxes(spark), cell=0.05, broadcast_max_rows=5).collect()))
    salted = sorted(map(tuple, J.batch_bbox(c, _boxes(spark), cell=0.05, broadcast_max_rows=5, salt=6).collect()))
    assert base == shuffled == salted
    assert len(base) > 1000          # every box near Paris sees the 1000 hot points


def _decoded(blobs):
    out = {}
    for r in blobs:
        lay = M.decode(bytes(r["mvt"]))[0]
        feats = sorted((tuple(f["geometry"]), tuple(lay["values"][t] for t in f["tags"][1::2])) for f in lay["features"])
        out[(r["z"], r["x"], r["y"])] = feats
    return out


def test_hot_tile_same_under_salt(spark):
    c = _hot_points(spark)
    one = _decoded(M.tile_blobs(c, [6], salt=1).collect())
    many = _decoded(M.tile_blobs(c, [6], salt=7).collect())
    assert one == _decoded(K.tile_blobs(c, [6], salt=3).collect())
    assert one == many
    assert max(len(v) for v in one.values()) >= 1000
