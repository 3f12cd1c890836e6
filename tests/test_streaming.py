"""Structured Streaming operators (STR-1..4) with availableNow triggers."""

import json
import os

from pyspark.sql import functions as F

from geoplane.operators import predicates as P
from geoplane.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def test_drop_folder_ingest(spark, tmp_dir):
    drop = os.path.join(tmp_dir, "drop")
    os.makedirs(drop)
    with open(os.path.join(drop, "towns.csv"), "w") as f:
        f.write("name;lon;lat\nParis;2.35;48.85\nLyon;4.83;45.76\n")
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5.37, 43.3]}, "properties": {"n": 1}}]}
    with open(os.path.join(drop, "ports.geojson"), "w") as f:
        f.write(json.dumps(fc))
    with open(os.path.join(drop, "broken.csv"), "w") as f:
        f.write("a;b\n1;2\n")
    os.makedirs(os.path.join(drop, "north"))
    with open(os.path.join(drop, "north", "towns.csv"), "w") as f:
        f.write("name;lon;lat\nLille;3.06;50.63\n")
    hist = os.path.join(tmp_dir, "history")
    q = ST.drop_folder_ingest(spark, drop, os.path.join(tmp_dir, "tables"), hist, delete_source=False)
    q.awaitTermination()
    all_rows = spark.read.parquet(hist).collect()
    rows = {r["collection"]: r for r in all_rows if r["workspace"] is None}
    assert rows["towns"]["status"] == "completed" and rows["towns"]["feature_count"] == 2
    north = [r for r in all_rows if r["workspace"] == "north"]
    assert len(north) == 1 and north[0]["feature_count"] == 1 and "/north/towns/" in north[0]["table_path"]
    assert rows["ports"]["feature_count"] == 1
    assert rows["broken"]["status"] == "failed"
    kept = [f for _, _, fs in os.walk(hist + "_failed") for f in fs if f.endswith(".csv")]
    assert kept == ["broken.csv"]


def test_stream_filter_equals_batch(spark, tmp_dir):
    path = f"{SF}/events.parquet"
    stream = (spark.readStream.schema(spark.read.parquet(path).schema)
              .option("pathGlobFilter", "events*.parquet").parquet(SF))
    cond = P.eq(stream, "event_type", "click")
    out = ST.run_available_now(ST.stream_filter(stream, cond, ["event_id"]), os.path.join(tmp_dir, "s"), name="t")
    got = {r[0] for r in spark.read.parquet(out).collect()}
    want = {r[0] for r in spark.read.parquet(path).filter(F.col("event_type") == "click").select("event_id").collect()}
    assert got == want


def test_stream_lookup_large_polygons(spark, tmp_dir):
    import math
    from geoplane.functions.geometry import with_bbox
    from geoplane.operators import joins as J
    from geoplane.plans.collection import Collection
    polys = []
    for k in range(3):
        cx, cy = 1.0 + 2.5 * k, 45.0
        ring = [(cx + (1.0 if i % 2 == 0 else 0.6) * math.cos(i * math.pi / 40),
                 cy + (1.0 if i % 2 == 0 else 0.6) * math.sin(i * math.pi / 40)) for i in range(80)]
        ring.append(ring[0])
        polys.append((k, [[[{"x": a, "y": b} for a, b in ring]]]))
    df = spark.createDataFrame(polys, "id int, parts array<array<array<struct<x:double,y:double>>>>")
    df = with_bbox(df.withColumn("geom", F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.col("parts"))).drop("parts"))
    coll = Collection(df, name="stars", geometry_type="Polygon")
    pts = spark.range(5000).select(F.col("id").alias("pid"), (F.lit(-0.5) + (F.col("id") * 7919 % 8000) / 1000.0).alias("x"),
                                   (F.lit(43.8) + (F.col("id") * 104729 % 2400) / 1000.0).alias("y"))
    src = os.path.join(tmp_dir, "pts")
    pts.write.parquet(src)
    stream = spark.readStream.schema(pts.schema).parquet(src)
    out = ST.run_available_now(ST.stream_point_lookup(coll, stream), os.path.join(tmp_dir, "o"), name="t4")
    got = {tuple(r) for r in spark.read.parquet(out).select("pid", "id").collect()}
    want = {tuple(r) for r in J.batch_point_lookup(coll, pts).collect()}
    assert got == want and len(got) > 100
