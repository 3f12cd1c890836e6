import os

from geoplane import api


def test_api_roundtrip(spark, tmp_dir):
    p = os.path.join(tmp_dir, "towns.csv")
    with open(p, "w") as f:
        f.write("name;population;lon;lat\nParis;2161000;2.35;48.86\nLyon;516092;4.83;45.76\nNice;342669;7.26;43.70\n")
    feats, report = api.ingest(spark, p)
    assert report.first()["imported"] == 3
    coll = api.collection(feats, "towns")
    assert coll.geometry_type == "MultiPoint"
    res = api.items(coll, api.P.gt(coll.df, "population", 400000), bbox=[1, 45, 6, 49])
    assert sorted(r["name"] for r in res.page.collect()) == ["Lyon", "Paris"]
    classes = api.classify(coll.df, "population", "graduated", 2)
    styled = api.apply_style(coll.df, {"type": "graduated", "field": "population",
                                       "classes": [{**c, "color": col} for c, col in zip(classes, ["#000000", "#ffffff"])]})
    assert {r["color"] for r in styled.collect()} == {"#000000", "#ffffff"}
    prof = {r["column_name"]: r for r in api.profile(coll.df).collect()}
    assert prof["population"]["distinct_count"] == 3
    req = spark.createDataFrame([(5, 16, 11), (99, 0, 0)], "z int, x bigint, y bigint")
    out = {r["z"]: r["mvt"] for r in api.tiles(coll, requests=req, props=["name"]).collect()}
    assert 5 in out and out[5] is not None and 99 not in out
    prev = api.preview(spark, p)
    assert prev["separator"] == ";"
