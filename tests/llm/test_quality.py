import numpy as np
import pytest

from geoplane.llm import quality as Q
from geoplane.llm.common import crc_mod
from geoplane.llm.queries import op7_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = op7_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(crc_mod(r["doc_id"], 5) == 0 for r in got)
    good = [r["predicted"] for r in got if r["quality"] == 1]
    bad = [r["predicted"] for r in got if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_risk_is_unbiased_and_clipped_training_uses_no_negatives():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1, 1, 4000), rng.normal(-1, 1, 4000)
    unl = np.concatenate([rng.normal(1, 1, 7000), rng.normal(-1, 1, 3000)])
    r_pos, r_neg = Q.nn_pu_risk(pos, unl, 0.7)
    assert r_pos == pytest.approx(0.7 * np.logaddexp(0, -pos).mean())
    assert r_neg == pytest.approx(0.3 * np.logaddexp(0, neg).mean(), abs=0.05)


def test_prior_and_separation_on_a_known_mixture():
    rng = np.random.default_rng(1)
    x = lambda mean, n: np.pad(rng.normal(mean, 1, (n, 3)), ((0, 0), (0, Q.WIDTH - 3))).astype(np.float32)
    xp, xu = x(2.0, 1500), np.vstack([x(2.0, 2100), x(-2.0, 900)])
    m = Q.fit(xp, xu)
    assert m.prior == pytest.approx(0.7, abs=0.08)
    assert (m.probability(x(2.0, 500)) >= 0.3).mean() > 0.98
    assert (m.probability(x(-2.0, 500)) >= 0.3).mean() < 0.05


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (None, "Some words here.", 1.0), (3, "", 0.0), (3, "", 0.0),
                                  (4, "again " * 200_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (4, None)], "doc_id long, quality int")
    rows = Q.score(docs, Q.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), labels.limit(0))).count() == 0
    assert Q.features([]).shape == (0, Q.WIDTH)
