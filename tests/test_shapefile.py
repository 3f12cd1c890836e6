"""Zipped shapefile import in EPSG:2154 -> MultiPolygon 4326 (FIXTURES 3, generated)."""

import os

from geoplane.sources.detect import detect_format, import_file
from geoplane.sources.shapefile import preview_shapefile, read_shapefile

from .shpgen import write_zip


def _fixture(tmp_dir, n=120):
    polys, recs = [], []
    for i in range(n):
        x0, y0 = 380000 + (i % 12) * 10000, 6500000 + (i // 12) * 10000
        shell = [(x0, y0), (x0, y0 + 8000), (x0 + 8000, y0 + 8000), (x0 + 8000, y0), (x0, y0)]   # clockwise
        rings = [shell]
        if i == 0:
            rings.append([(x0 + 2000, y0 + 2000), (x0 + 4000, y0 + 2000), (x0 + 4000, y0 + 4000),
                          (x0 + 2000, y0 + 4000), (x0 + 2000, y0 + 2000)])      # hole, counter-clockwise
        polys.append(rings)
        recs.append((i + 1, f"zone {i}", f"{(i % 4) * 1.25:.2f}"))
    fields = [("ID", "N", 10, 0), ("NAME", "C", 20, 0), ("LEVEL", "N", 8, 2)]
    p = os.path.join(tmp_dir, "clay.zip")
    write_zip(p, polys, recs, fields)
    return p


def test_shapefile_import(spark, tmp_dir):
    p = _fixture(tmp_dir)
    assert detect_format(p) == "shapefile"
    df, info = read_shapefile(spark, p)
    assert info["srid"] == 2154 and df.count() == 120
    rows = df.orderBy("id").collect()
    assert {r["geom"]["type"] for r in rows} == {"MultiPolygon"}
    assert all(-2 < r["_xmin"] < 3 and 44 < r["_ymin"] < 48 for r in rows)
    assert rows[0]["_id"] == 1 and rows[0]["name"] == "zone 0" and rows[1]["level"] == 1.25
    assert len(rows[0]["geom"]["parts"][0]) == 2          # shell + hole
    again, _ = import_file(spark, p)
    assert again.count() == 120                            # re-import replaces, same count


def test_shapefile_preview(spark, tmp_dir):
    prev = preview_shapefile(spark, _fixture(tmp_dir, 30))
    assert len(prev["sample_rows"]) == 5 and prev["features"].count() == 30
    assert prev["bbox"][0] < prev["bbox"][2]
