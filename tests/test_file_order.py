import json
import os

import pytest

from geoplane import api
from geoplane.session import ensure_checkpoint_dir
from geoplane.sources.csv import read_csv_points
from geoplane.sources.geojson import read_geojson


def test_csv_ids_follow_file_order_whatever_the_file_sizes(spark, tmp_dir):
    for name, n in (("a", 3), ("b", 2000), ("c", 40)):
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w") as f:
            f.write("name;lon;lat\n" + "".join(f"{name}{i};{i % 90};1\n" for i in range(n)))
    feats, report, _ = read_csv_points(spark, tmp_dir)
    got = {r["id"]: r["name"] for r in feats.select("id", "name").collect()}
    want = [f"{name}{i}" for name, n in (("a", 3), ("b", 2000), ("c", 40)) for i in range(n)]
    assert [got[i + 1] for i in range(len(want))] == want
    assert report.first()["imported"] == 2043


def test_rows_of_separators_only_are_counted(spark, tmp_dir):
    path = os.path.join(tmp_dir, "x.csv")
    with open(path, "w") as f:
        f.write("name;lon;lat\nx;1;2\n;;\n\ny;abc;3\nz;4;5\n")
    feats, report, _ = read_csv_points(spark, path)
    assert tuple(report.first())[:2] == (2, 2)
    assert [r["id"] for r in feats.orderBy("id").collect()] == [1, 2]


def test_ids_go_on_over_documents(spark, tmp_dir):
    for d in range(3):
        feats = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [d, i]}, "properties": {"n": d * 10 + i}}
                 for i in range(2)]
        with open(os.path.join(tmp_dir, f"d{d}.json"), "w") as f:
            json.dump({"type": "FeatureCollection", "features": feats}, f)
    out, _ = read_geojson(spark, tmp_dir)
    assert [(r["id"], r["n"]) for r in out.orderBy("id").collect()] == [(1, 0), (2, 1), (3, 10), (4, 11), (5, 20), (6, 21)]


def test_entry_points_check_the_content(spark, tmp_dir):
    header_only = os.path.join(tmp_dir, "h.csv")
    with open(header_only, "w") as f:
        f.write("name;lon;lat\n")
    with pytest.raises(ValueError):
        api.ingest(spark, header_only)
    zipped = os.path.join(tmp_dir, "upload.bin")
    with open(zipped, "wb") as f:
        f.write(b"PK\x03\x04 not a shapefile")
    from geoplane.sources import detect
    assert detect.format_of(spark, zipped) == "shapefile"


def test_no_machine_local_folder_off_local_masters():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_deep_pages_equal_the_plain_order(spark):
    from pyspark.sql import functions as F

    from geoplane.plans.collection import TOP_OFFSET, page_of
    n = TOP_OFFSET + 500
    df = spark.range(n).select(F.when(F.col("id") % 7 == 0, F.lit(3)).otherwise((F.col("id") * 7919) % 100003).alias("k"))
    df = df.unionByName(spark.range(5).select(F.lit(None).cast("long").alias("k")))
    every = sorted(r["k"] for r in df.collect() if r["k"] is not None) + [None] * 5
    for off in (0, 40, TOP_OFFSET, TOP_OFFSET + 1, n - 3, n + 2, n + 50):
        assert [r["k"] for r in page_of(df, "k", off, 6).collect()] == every[off:off + 6], off
