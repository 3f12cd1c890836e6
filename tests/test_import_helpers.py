import os

from pyspark.sql import functions as F

from geoplane.operators import profile as PF
from geoplane.sources import detect
from geoplane.sources import text as TX
from geoplane.sources.export import write_feature_table

from .fixtures import sites


def test_geometry_profile(spark):
    assert PF.geometry_profile(sites(spark)) == {"column_name": "geom", "geometry_type": "Point", "srid": 4326}


def test_geo_column_detection_many_files(spark):
    rows = []
    for f, headers in {"a.csv": ["Name", " LAT ", "Lng", "x"], "b.csv": ["X_L93", "Y_L93"],
                       "c.csv": ["x", "y", "X_WGS84", "Y_WGS84"], "d.csv": ["centroid_x", "centroid_y"]}.items():
        rows += [(f, i, h) for i, h in enumerate(headers)]
    df = spark.createDataFrame(rows, "file string, pos int, header string")
    got = {r["file"]: (r["lon_column"], r["lat_column"]) for r in TX.detect_geo_columns_df(df).collect()}
    assert got == {"a.csv": ("Lng", " LAT "), "c.csv": ("X_WGS84", "Y_WGS84"), "d.csv": ("centroid_x", "centroid_y")}
    for f, headers in {"a.csv": ["Name", " LAT ", "Lng", "x"], "b.csv": ["X_L93", "Y_L93"]}.items():
        want = got.get(f)
        assert TX.detect_geo_columns(headers) == want


def test_separator_and_sanitize_columns(spark):
    df = spark.createDataFrame([("a;b;c",), ("a,b\tc",), ("abc",), ("a\tb\tc,d",)], "h string")
    assert [r[0] for r in df.select(TX.detect_separator(F.col("h"))).collect()] == [";", ",", ";", "\t"]
    assert TX.sanitize_name("Id") == "_id" and TX.sanitize_name("Prix (€)") == "prix____"
    assert TX.strip_bom("﻿x") == "x"


def test_formats_of_listing(spark, tmp_dir):
    for name, content in (("a.csv", b"x"), ("b.zip", b"PK\x03\x04"), ("c.bin", b"PK\x03\x04"), ("d.json", b"{}")):
        with open(os.path.join(tmp_dir, name), "wb") as f:
            f.write(content)
    listing = spark.read.format("binaryFile").load(tmp_dir)
    got = {os.path.basename(r["path"]): r["format"] for r in detect.formats_of(listing).collect()}
    assert got == {"a.csv": "csv", "b.zip": "shapefile", "c.bin": "shapefile", "d.json": "geojson"}


def test_reimport_writes_new_version(spark, tmp_dir):
    s = sites(spark)
    p1 = write_feature_table(s.df, tmp_dir, "sites")
    p2 = write_feature_table(s.df.limit(2), tmp_dir, "sites")
    assert p1 != p2 and spark.read.parquet(p1).count() == 3 and spark.read.parquet(p2).count() == 2
    a = write_feature_table(s.df, tmp_dir, "sites", workspace="ws1", version="v1")
    b = write_feature_table(s.df, tmp_dir, "sites", workspace="ws2", version="v1")
    assert a != b and "/ws1/sites/" in a and "/ws2/sites/" in b


def test_csv_files_checked_in_one_job(spark, tmp_dir):
    from pathlib import Path

    from geoplane.sources import detect
    texts = {"empty.csv": "", "blank.csv": "\n  \n", "head.csv": "a,b\n", "ok.csv": "a,b\n\n1,2\n", "long.csv": "a\n" + "1\n" * 5000}
    for name, text in texts.items():
        Path(tmp_dir, name).write_text(text)
    got = {Path(r["path"]).name: (r["n_lines"], r["ok"], r["reason"]) for r in detect.check_csv_files(spark, tmp_dir).collect()}
    bad = detect.TOO_SHORT
    assert got == {"empty.csv": (0, False, bad), "blank.csv": (0, False, bad), "head.csv": (1, False, bad),
                   "ok.csv": (2, True, None), "long.csv": (5001, True, None)}
    assert all(detect.check_csv(spark, str(Path(tmp_dir, n)))[0] == v[1] for n, v in got.items())
