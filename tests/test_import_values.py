"""Values that only look like numbers, and single documents with any ids."""

import json
import os

import pytest
from pyspark.sql import functions as F

from geoplane.functions import geometry as G
from geoplane.plans.collection import Collection
from geoplane.sources import csv as CSVS
from geoplane.sources import text as TX
from geoplane.sources.export import export_geojson


def test_codes_stay_text(spark, tmp_dir):
    path = os.path.join(tmp_dir, "units.csv")
    with open(path, "w") as f:
        f.write("lon,lat,unit,when,w,n,x\n")
        for i in range(1, 10):
            f.write(f"{i},{40 + i},{i}{'DFdf'[i % 4]},NaN,Infinity,{i},{i}.5e0\n")
    feats, report, plan = CSVS.read_csv_points(spark, path)
    assert plan.types == {"unit": "TEXT", "when": "TEXT", "w": "TEXT", "n": "INTEGER", "x": "DOUBLE PRECISION"}
    assert report.first()["rejected_values"] == 0
    rows = feats.orderBy("id").collect()
    assert [(r["unit"], r["when"], r["w"], r["n"], r["x"]) for r in rows] == [
        (f"{i}{'DFdf'[i % 4]}", "NaN", "Infinity", i, i + 0.5) for i in range(1, 10)]


def test_coordinates_must_be_finite_numbers(spark, tmp_dir):
    path = os.path.join(tmp_dir, "p.csv")
    with open(path, "w") as f:
        f.write("lon,lat,n\n1,2,1\nInfinity,2,2\n1D,2,3\n1e999,2,4\n -1.5 ,+2.,5\n.5,-0,6\n")
    feats, report, _ = CSVS.read_csv_points(spark, path)
    assert [r["n"] for r in feats.orderBy("id").collect()] == [1, 5, 6]
    assert tuple(report.first()) == (3, 3, 0)


@pytest.mark.parametrize("text,ok", [("1", True), ("-1.5e+3", True), (".5", True), ("5.", True), (" 7 ", True), ("1D", False),
                                     ("0x1F", False), ("NaN", False), ("Infinity", False), ("1e", False), (".", False)])
def test_number_pattern(spark, text, ok):
    assert spark.range(1).select(TX.is_number(F.lit(text))).first()[0] is ok


@pytest.mark.parametrize("ids", [[1, 1, 2], [None, 3, 3], [None, None], [5], []])
@pytest.mark.parametrize("limit", [None, 10])
def test_single_document_is_json_for_any_ids(spark, tmp_dir, ids, limit):
    df = spark.createDataFrame([(i, float(k), 45.0, f"n{k}") for k, i in enumerate(ids)], "id int, x double, y double, name string")
    df = G.with_bbox(df.withColumn("geom", G.point(F.col("x"), F.col("y"))).drop("x", "y"))
    out = os.path.join(tmp_dir, "doc")
    export_geojson(Collection(df, name="c", geometry_type="Point"), out, single_file=True, limit=limit)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    doc = json.loads("".join(open(os.path.join(out, p)).read() for p in parts))
    assert sorted(str(f["id"]) for f in doc["features"]) == sorted(map(str, ids))
    assert sorted(f["properties"]["name"] for f in doc["features"]) == [f"n{k}" for k in range(len(ids))]
