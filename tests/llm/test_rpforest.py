import numpy as np
import pytest
from pyspark.sql import functions as F

from geoplane.llm import rpforest as R
from geoplane.llm.queries import op2_rpforest

SF = "/root/testdata/sf0.01"


def brute(rows, k, asks):
    use = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == 3
           and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    use = sorted({(i, tuple(v)) for i, v in use})
    out = []
    for q, x in use:
        if asks(q):
            near = sorted((-float(np.dot(x, y)), i) for i, y in use if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


def test_small_table_is_exact_with_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in rng.integers(-2, 3, 3)]) for i in range(120)]
    rows += [(1000 + i, [1.0, 2.0, 0.0]) for i in range(90)]
    rows += [(2000, None), (2020, [0.0, 0.0, 0.0]), (2040, [1.0, None, 2.0]), (2060, [1.0, float("nan"), 1.0]),
             (2080, [float("inf"), 0.0, 1.0]), (2100, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = R.nearest(df, F.col("vec_id") % 20 == 0, k=7, block=16).orderBy("query_id", "rank").collect()
    want = sorted(brute(rows, 7, lambda q: q % 20 == 0))
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [w[:3] for w in want]
    assert np.allclose([r["score"] for r in got], [w[3] for w in want], atol=1e-12)


def test_recall_against_brute_force(spark):
    got = op2_rpforest(spark, SF).toPandas()
    src = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(src["embedding"].tolist(), dtype=float)
    ids = src["vec_id"].to_numpy()
    found = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        found.append(np.isin(ids[np.lexsort((ids, -s))[:20]], got.vec_id[got.query_id == ids[i]]).mean())
    assert np.mean(found) >= 0.9


def test_a_bounded_sample_still_indexes_every_row(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)) * rng.uniform(0.5, 2, (1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = R.nearest(df, F.col("vec_id") % 20 == 0, k=10, sample=300, leaf=8, block=50).toPandas()
    assert len(got) == 75 * 10
    hit = [np.isin(np.argsort(-np.where(np.arange(1500) == q, -np.inf, x @ x[q]))[:10], got.vec_id[got.query_id == q]).mean()
           for q in range(0, 1500, 20)]
    assert np.mean(hit) >= 0.9


def test_recall_holds_where_the_search_prunes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    took = []
    measured = R.measured_budget
    monkeypatch.setattr(R, "measured_budget", lambda *a: took.append(measured(*a)) or took[-1])
    got = R.nearest(df, F.col("vec_id") % 80 == 0, k=20, trees=4, sample=2000).toPandas()
    hit = [np.isin(np.argsort(-np.where(np.arange(8000) == q, -np.inf, x @ x[q]))[:20], got.vec_id[got.query_id == q]).mean()
           for q in range(0, 8000, 80)]
    assert np.mean(hit) >= 0.95
    assert R.budget(8000, 4) < took[0] < 4 * 8000


def test_leaves_hold_the_sample_and_the_queue_visits_everything_on_demand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    f = R.fit(x, float(np.linalg.norm(x, axis=1).max()), trees=3, leaf=10)
    sizes = np.array([len(p) for p in f.leaf_points])
    assert sizes.sum() == 600
    every = f.visited(x[0], sizes, 600)
    assert sorted(every) == list(range(len(sizes)))
    assert len(f.visited(x[0], sizes, 1)) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(20, [1.0, 0.0])]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert R.nearest(df, F.col("vec_id") % 20 == 0).count() == 0
