import json
import os

from geoplane.sources import geojson as GJ


def test_preview_numbers_only_the_first_documents(spark, tmp_dir, monkeypatch):
    for d, n in enumerate((0, 700, 0, 700, 3000, 5)):
        feats = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [d, i % 90]},
                  "properties": {"n": d * 10_000 + i if d == 1 else "x"}} for i in range(n)]
        with open(os.path.join(tmp_dir, f"d {d}.json"), "w") as f:
            json.dump({"type": "FeatureCollection", "features": feats or None}, f)
    numbered, plain = [], GJ.with_sequential_id
    monkeypatch.setattr(GJ, "with_sequential_id", lambda df, *a, **kw: numbered.append(df) or plain(df, *a, **kw))
    monkeypatch.setattr(GJ, "validate_collection", lambda *a: None)
    p = GJ.preview_geojson(spark, tmp_dir)
    assert p["feature_count"] == 4405 and p["bbox"] == [1.0, 0.0, 3.0, 89.0] and p["fields"] == {"n": "INTEGER"}
    assert [r["n"] for r in p["sample_rows"]] == [10_000, 10_001, 10_002, 10_003, 10_004]
    assert [r["id"] for r in p["features"].collect()] == list(range(1, 101))
    assert [df.count() for df in numbered] == [1400]
