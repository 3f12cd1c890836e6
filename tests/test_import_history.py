import datetime as dt
import os

from geoplane.operators import catalog as CT
from geoplane.sources.csv import preview_csv, read_csv_points


def test_progress_rows(spark):
    rows = [tuple(r) for r in CT.progress_rows(spark, 1234).orderBy("done").collect()]
    assert rows == [(500, 41), (1000, 81), (1234, 100)]


def test_history_row_and_preview(spark, tmp_dir):
    p = os.path.join(tmp_dir, "pts.csv")
    with open(p, "w") as f:
        f.write("name,lon,lat\n" + "".join(f"p{i},{i / 100},{45 + i / 100}\n" for i in range(150)) + "bad,x,1\n")
    feats, report, plan = read_csv_points(spark, p)
    t0, t1 = dt.datetime(2024, 1, 1, 10, 0, 0), dt.datetime(2024, 1, 1, 10, 0, 2)
    h = CT.import_history_row(spark, 7, "pts.csv", report, t0, t1).first()
    assert (h["imported_features"], h["total_features"], h["duration_ms"], h["progress"]) == (150, 151, 2000, 100)
    assert [e["level"] for e in h["logs"]] == ["info", "warn", "info"]
    prev = preview_csv(spark, p)
    assert prev["separator"] == "," and prev["points"].count() == 100 and len(prev["sample_rows"]) == 5
    assert prev["fields"] == {"name": "TEXT"}
