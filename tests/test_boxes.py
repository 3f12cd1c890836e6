"""Counts and first pages of boxes over points, without all pairs."""

import random

from geoplane.operators import boxes as B
from geoplane.operators import joins as J
from geoplane.plans import queries as Q
from geoplane.plans.collection import Collection


def _points(spark, rows):
    df = spark.createDataFrame(rows, "id long, _xmin double, _ymin double")
    return Collection(df.selectExpr("*", "_xmin AS _xmax", "_ymin AS _ymax"), name="p")


def _case(n=900, boxes=60, seed=3):
    r = random.Random(seed)
    rows = [(i * 7 % n, 2.0 if i % 3 == 0 else float(r.randint(0, 20)), -0.0 if i % 5 == 0 else r.random() * 10) for i in range(n)]
    rows += [(None, 2.0, 1.0), (n + 1, None, 1.0), (n + 2, 2.0, None), (5, 2.0, 0.0)]
    asked = []
    for i in range(boxes):
        x, y = r.randint(-2, 20), r.choice([0.0, r.random() * 10])
        asked.append((i // 2, float(x), y, float(x + r.randint(0, 9)), y + r.random() * 5))
    return rows, asked + [(90, 3.0, 0.0, 2.0, 9.0), (91, None, 0.0, 2.0, 9.0), (92, -90.0, -90.0, 90.0, 90.0), (None, 0.0, 0.0, 9.0, 9.0)]


def _requests(spark, asked):
    return spark.createDataFrame(asked, "req_id int, _xmin double, _ymin double, _xmax double, _ymax double")


def _met(rows, asked):
    out = {}
    for q, *box in asked:
        if None in box:
            continue
        out.setdefault(q, []).extend(i for i, x, y in rows if None not in (x, y) and box[0] <= x <= box[2] and box[1] <= y <= box[3])
    return {q: sorted(v, key=lambda i: (i is None, i or 0)) for q, v in out.items()}


def test_counts_equal_brute_force_and_make_no_pairs(spark, monkeypatch):
    rows, asked = _case()
    monkeypatch.setattr(J, "batch_bbox", None)
    got = {r["req_id"]: r["n"] for r in B.batch_bbox_counts(_points(spark, rows), _requests(spark, asked)).collect()}
    assert {q: n for q, n in got.items() if n} == {q: len(v) for q, v in _met(rows, asked).items() if v}
    none = B.batch_bbox_counts(_points(spark, []), _requests(spark, asked)).collect()
    assert not any(r["n"] for r in none) and not B.batch_bbox_counts(_points(spark, rows), _requests(spark, [])).collect()


def test_links_query_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "batch_bbox", None)
    assert Q.QUERIES["pag3_batch_links"](spark, "/root/testdata/sf0.001").count() == 10


def test_first_ids_equal_brute_force_in_any_rounds(spark, monkeypatch):
    rows, asked = _case()
    want = {(q, i) for q, v in _met(rows, asked).items() for i in v[:15]}
    pairs, plain = [0], J.batch_bbox

    def counted(*args, **kw):
        out = plain(*args, **kw).cache()
        pairs[0] += out.count()
        return out

    monkeypatch.setattr(J, "batch_bbox", counted)
    for first in (40, 10_000):
        pairs[0] = 0
        monkeypatch.setattr(B, "FIRST_ROWS", first)
        got = B.batch_bbox_first(_points(spark, rows), _requests(spark, asked), 15).collect()
        assert {tuple(r) for r in got} == want and len(got) == sum(len(v[:15]) for v in _met(rows, asked).values())
        every = sum(map(len, _met(rows, asked).values()))
        assert pairs[0] == every if first > len(rows) else pairs[0] < 0.8 * every


def test_pages_query_ends_before_all_pairs(spark, monkeypatch):
    rounds, plain = [], J.batch_bbox
    monkeypatch.setattr(J, "batch_bbox", lambda coll, *a, **kw: rounds.append(coll) or plain(coll, *a, **kw))
    monkeypatch.setattr(B, "FIRST_ROWS", 100)
    Q.QUERIES["pag1_batch_pages"](spark, "/root/testdata/sf0.001").collect()
    assert len(rounds) > 1
