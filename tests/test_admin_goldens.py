"""Classification, profile, export and import goldens (FIXTURES.md 1-2)."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from geoplane.operators import classify as CL
from geoplane.operators import predicates as P
from geoplane.operators import profile as PF
from geoplane.sources import export as EX
from geoplane.sources.csv import read_csv_points
from geoplane.sources.geojson import read_geojson

from .fixtures import cities, point_collection


def test_categorized_three_values(spark):
    vals = [r["value"] for r in CL.categorized(cities(spark).df, "category").collect()]
    assert vals == ["capital", "major", "medium"]


def test_graduated_three_classes(spark):
    cls = CL.graduated(cities(spark).df, "population", 3)
    assert len(cls) == 3
    assert cls[0]["min"] == 314138 and cls[-1]["max"] == 2161000
    assert all(a["max"] == b["min"] for a, b in zip(cls, cls[1:]))


def test_graduated_errors(spark):
    with pytest.raises(ValueError, match="not numeric"):
        CL.graduated(cities(spark).df, "name", 3)
    with pytest.raises(ValueError, match="not found"):
        CL.categorized(cities(spark).df, "nope")


def test_classes_clamped(spark):
    assert CL.clamp_classes(1) == 2 and CL.clamp_classes(50) == 20 and CL.clamp_classes("x") == 5


def test_palette_interpolation():
    assert CL.interpolate_palette("blues", 1) == ["#6baed6"]
    assert CL.interpolate_palette("blues", 3) == ["#eff3ff", "#6baed6", "#08519c"]
    seven = CL.interpolate_palette("blues", 7)
    assert len(seven) == 7 and seven[0] == "#eff3ff" and seven[-1] == "#08519c"
    assert CL.interpolate_palette("reds", 0) == []


def test_step_and_match_styles(spark):
    c = cities(spark)
    cls = CL.with_colors(CL.graduated(c.df, "population", 3), "greens")
    styled = {r["name"]: (r["class_index"], r["color"]) for r in CL.style_graduated(c.df, "population", cls).collect()}
    assert styled["Paris"][0] == 2 and styled["Nantes"][0] == 0
    cats = spark.createDataFrame([("capital", "#ff0000")], "value string, color string")
    colors = {r["name"]: r["color"] for r in CL.style_categorized(c.df, "category", cats).collect()}
    assert colors["Paris"] == "#ff0000" and colors["Lyon"] == "#cccccc"
    legend = CL.legend(cls)
    assert legend[0]["label"].startswith("314138.00 – ")


def test_profile_text_min_max(spark):
    df = spark.createDataFrame([(10,), (9,), (None,)], "v int")
    r = PF.column_profile(df).first()
    assert (r["min_value"], r["max_value"]) == ("10", "9")      # text order
    assert (r["non_null_count"], r["null_count"], r["distinct_count"], r["total_count"]) == (2, 1, 2, 3)


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float((i * 7919) % 1013) for i in range(120000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.1, 0.25, 0.5, 0.9]
    got = PF.exact_quantiles(df, "v", probs)
    want = np.quantile(np.array(vals), probs, method="linear")
    assert got == pytest.approx(list(want), rel=0, abs=1e-9)


def _export_collection(spark):
    c = cities(spark)
    c.exposed_fields = [("name", None), ("population", None)]
    return c.with_df(c.df.filter(F.col("id") != 4))


def test_export_csv(spark, tmp_dir):
    c = _export_collection(spark)
    header = EX.export_csv(c, tmp_dir + "/out")
    assert header == "id,name,population,geom_wkt"
    text = "".join(open(f, newline="").read() for f in sorted(glob.glob(tmp_dir + "/out/part-*")))
    lines = text.split("\r\n")
    lines = [ln for ln in lines if ln]
    assert lines[0] == header and len(lines) == 5
    assert "POINT(2.35 48.86)" in text


def test_export_filters(spark):
    c = _export_collection(spark)
    _, paris = EX.csv_lines(c, P.eq(c.df, "name", "Paris"))
    assert paris.count() == 1
    _, box = EX.csv_lines(c, bbox=[5, 43, 6, 44])
    assert box.first()["line"].split(",")[1] == "Marseille"
    rows = EX.geojson_features(c).orderBy("id").limit(2).collect()
    assert len(rows) == 2
    f = json.loads(rows[0]["feature"])
    assert f["type"] == "Feature" and f["properties"]["name"] == "Paris" and f["geometry"]["type"] == "Point"


def test_csv_escape(spark):
    from geoplane.sources.text import csv_escape
    df = spark.createDataFrame([('a"b',), ("x,y",), ("plain",), (None,)], "v string")
    out = [r[0] for r in df.select(csv_escape(F.col("v"))).collect()]
    assert out == ['"a""b"', '"x,y"', "plain", ""]


def _write(path, text, mode="w"):
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def test_import_semicolon_csv(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "s.csv"), "CODE;LIBELLE;X_WGS84;Y_WGS84;REGION\n75056;Paris;2.349;48.864;IDF\n"
               "13055;Marseille;5.369;43.296;PACA\n35238;Rennes;-1.677;48.117;BRE\n")
    feats, rep, plan = read_csv_points(spark, p)
    assert feats.count() == 3 and plan.separator == ";"
    assert [c for c in feats.columns if not c.startswith("_") and c not in ("id", "geom")] == ["code", "libelle", "region"]
    assert feats.first()["geom"]["type"] == "MultiPoint"
    explicit, _, _ = read_csv_points(spark, p, separator=";", lon="X_WGS84", lat="Y_WGS84")
    assert explicit.count() == 3


def test_import_comma_csv_with_bom(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "c.csv"), "﻿id,name,longitude,latitude,pop\n1,Paris,2.35,48.85,2100000\n"
               "2,Lyon,4.83,45.76,500000\n")
    feats, rep, plan = read_csv_points(spark, p)
    assert plan.separator == "," and "_id" in feats.columns and feats.count() == 2
    assert plan.types["pop"] == "INTEGER"
    assert [r["id"] for r in feats.orderBy("id").collect()] == [1, 2]


def test_import_csv_without_geo_fails(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "n.csv"), "id;name;value\n1;a;2\n2;b;3\n")
    with pytest.raises(ValueError):
        read_csv_points(spark, p)


def test_import_csv_quotes_and_bad_rows(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "q.csv"), 'name;lon;lat;note\n"a;b";1.5;2.5;"he said ""hi"""\n\nx;bad;3;n\n'
               "y;2;3;1.5\n")
    feats, rep, plan = read_csv_points(spark, p)
    r = rep.first()
    assert (r["imported"], r["skipped"]) == (2, 1)
    rows = feats.orderBy("id").collect()
    assert rows[0]["name"] == "a;b" and rows[0]["note"] == 'he said "hi"'
    assert [x["id"] for x in rows] == [1, 2]


def test_geojson_roundtrip(spark, tmp_dir):
    feats = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [2 + i / 100, 45 + i / 100]},
              "properties": {"name": f"unit {i}", "power": 900 + i, "ratio": 0.5, "ok": True}} for i in range(56)]
    feats[3]["geometry"] = None
    p = _write(os.path.join(tmp_dir, "u.geojson"), json.dumps({"type": "FeatureCollection", "features": feats}))
    df, info = read_geojson(spark, p)
    assert df.count() == 56
    assert info["types"] == {"name": "TEXT", "power": "INTEGER", "ratio": "DOUBLE PRECISION", "ok": "BOOLEAN"}
    assert info["geometry_type"] == "MultiPoint"
    row = df.filter("id = 5").first()
    assert row["power"] == 904 and row["_xmin"] == pytest.approx(2.04)
    assert df.filter("id = 4").first()["geom"] is None


def test_geojson_validation(spark, tmp_dir):
    bad = _write(os.path.join(tmp_dir, "b.geojson"), '{"type": "Feature"}')
    with pytest.raises(ValueError):
        read_geojson(spark, bad)
    empty = _write(os.path.join(tmp_dir, "e.geojson"), '{"type": "FeatureCollection", "features": []}')
    with pytest.raises(ValueError):
        read_geojson(spark, empty)


def test_geojson_gzip(spark, tmp_dir):
    import gzip
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]},
         "properties": {"n": 1}}]}
    p = os.path.join(tmp_dir, "g.geojson.gz")
    with gzip.open(p, "wt") as f:
        f.write(json.dumps(doc))
    df, info = read_geojson(spark, p)
    assert df.count() == 1 and info["geometry_type"] == "MultiPolygon"


def test_feature_table_write_prunes(spark, tmp_dir):
    from geoplane.sources.export import write_feature_table
    c = point_collection(spark, [(i, f"p{i}", -5 + (i % 100) / 10, 41 + (i // 100) / 10) for i in range(1000)],
                         "id int, name string, lon double, lat double")
    path = write_feature_table(c.df, tmp_dir, "pts", partitions=4)
    stored = spark.read.parquet(path)
    assert stored.count() == 1000
    from geoplane.functions.spatial import bbox_overlaps
    plan = stored.filter(bbox_overlaps(0, 42, 1, 43))._jdf.queryExecution().executedPlan().toString()
    assert "_xmin" in plan and "PushedFilters" in plan


def test_geojson_gzip_without_extension(spark, tmp_dir):
    import gzip
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": "x"}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [3, 4]}, "properties": {"a": "y"}}]}
    p = os.path.join(tmp_dir, "hidden.geojson")
    with open(p, "wb") as f:
        f.write(gzip.compress(json.dumps(doc).encode()))
    df, info = read_geojson(spark, p)
    assert df.count() == 2 and info["types"] == {"a": "TEXT"}


def test_csv_inference_deviations(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "d4.csv"), "lon;lat;a;b;c;d\n1;2;1e3;0x10;12;\n3;4;2;5;99999999999;\n")
    feats, rep, plan = read_csv_points(spark, p)
    assert plan.types == {"a": "DOUBLE PRECISION", "b": "TEXT", "c": "BIGINT", "d": "TEXT"}
    rows = feats.orderBy("id").collect()
    assert rows[0]["a"] == 1000.0 and rows[1]["c"] == 99999999999 and rows[0]["d"] is None
    assert rep.first()["rejected_values"] == 0


def test_csv_rejected_values_counted(spark, tmp_dir):
    lines = "lon;lat;n\n" + "".join(f"{i};{i};{i}\n" for i in range(100)) + "1;1;abc\n2;2;7\n"
    p = _write(os.path.join(tmp_dir, "late.csv"), lines)
    feats, rep, plan = read_csv_points(spark, p)
    r = rep.first()
    assert plan.types["n"] == "INTEGER" and r["imported"] == 102 and r["rejected_values"] == 1
    assert feats.filter("n IS NULL").count() == 1


def test_profile_typed_min_max(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (None, None)], "v int, s string")
    rows = {r["column_name"]: r for r in PF.column_profile(df, typed=True).collect()}
    assert (rows["v"]["min_value"], rows["v"]["max_value"]) == ("10", "9")           # text order kept
    assert (rows["v"]["min_typed"], rows["v"]["max_typed"]) == ("9", "10")           # typed order added
    assert rows["s"]["min_typed"] == "a"


def test_geojson_export_documents(spark, tmp_dir):
    c = _export_collection(spark)
    for limit in (None, 2):
        out = os.path.join(tmp_dir, f"fc{limit}")
        EX.export_geojson(c, out, single_file=True, limit=limit)
        text = "".join(open(f).read() for f in sorted(glob.glob(out + "/part-*")))
        doc = json.loads(text)
        assert doc["type"] == "FeatureCollection"
        assert [f["id"] for f in doc["features"]] == ([1, 2, 3, 5] if limit is None else [1, 2])
    lines_dir = os.path.join(tmp_dir, "lines")
    EX.export_geojson(c, lines_dir)
    feats = [json.loads(line) for f in sorted(glob.glob(lines_dir + "/part-*")) for line in open(f) if line.strip()]
    assert [f["id"] for f in feats] == [1, 2, 3, 5]


def test_geojson_first_feature_without_geometry(spark, tmp_dir):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": None, "properties": {}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {}}]}
    p = _write(os.path.join(tmp_dir, "d6.geojson"), json.dumps(doc))
    df, info = read_geojson(spark, p)
    assert df.count() == 2 and info["geometry_type"] == "MultiLineString" and info["types"] == {}


def test_geojson_export_import_roundtrip(spark, tmp_dir):
    """SURVEY slice 7: export -> import gives the same features (text with quotes, commas, unicode, nulls)."""
    rows = [(1, 'Saint-Étienne "la verte"', 172565, 4.39, 45.43), (2, "A, B; C", None, -1.55, 47.22),
            (3, "Nice", 342669, 7.26, 43.70)]
    c = point_collection(spark, rows, "id int, name string, population int, lon double, lat double", name="rt")
    out = os.path.join(tmp_dir, "rt")
    EX.export_geojson(c, out, single_file=True)
    doc = os.path.join(tmp_dir, "rt.geojson")
    with open(doc, "w") as f:
        f.write("".join(open(p).read() for p in sorted(glob.glob(out + "/part-*"))))
    back, info = read_geojson(spark, doc)
    got = {r["id"]: (r["name"], r["population"], r["_xmin"], r["_ymin"]) for r in back.collect()}
    assert got == {1: ('Saint-Étienne "la verte"', 172565, 4.39, 45.43), 2: ("A, B; C", None, -1.55, 47.22),
                   3: ("Nice", 342669, 7.26, 43.70)}
    assert info["types"] == {"name": "TEXT", "population": "INTEGER"}


def test_line_delimited_geojson(spark, tmp_dir):
    lines = [json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 45]},
                         "properties": {"n": i, "tag": f"t{i}"}}) for i in range(30)]
    p = _write(os.path.join(tmp_dir, "f.geojsonl"), "\n".join(lines) + "\n")
    df, info = read_geojson(spark, p, line_delimited=True)
    assert info["types"] == {"n": "INTEGER", "tag": "TEXT"} and info["geometry_type"] == "MultiPoint"
    rows = df.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 31)) and rows[4]["n"] == 4 and rows[4]["_xmin"] == 4.0
