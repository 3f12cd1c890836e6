import itertools

import numpy as np
import pytest

from geoplane.llm import toxicity as X
from geoplane.llm.common import crc_mod
from geoplane.llm.queries import op9_toxicity

SF = "/root/testdata/sf0.1"


def plain_kernel(a, b):
    """Sum over common subsequences of three characters, spans up to X.SPAN."""
    def table(w):
        w = f"\x02{w}\x03"
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < X.SPAN:
                s = w[i] + w[j] + w[k]
                out[s] = out.get(s, 0) + X.DECAY ** (k - i + 1)
        return out

    def dot(x, y):
        return sum(v * y.get(s, 0) for s, v in x.items())

    x, y = table(a), table(b)
    n = (dot(x, x) * dot(y, y)) ** 0.5
    return dot(x, y) / n if n else 0.0


def test_kernel_equals_enumeration():
    words = ["idiot", "idxiot", "i-d-i-o-t", "banana", "ab", "a", "nanana", "stupid", "tupids"]
    k = X.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert k[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-9)


def corpus(n=300):
    rng = np.random.default_rng(2)
    clean = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 8))) for _ in range(600)]
    bad = ["grumblefus", "snarkwit", "blithertop"]
    docs = []
    for i in range(n):
        sentences = [[str(clean[k]) for k in rng.integers(0, 600, 8)] for _ in range(4)]
        toxic = i % 4 == 0
        if toxic:
            sentences[int(rng.integers(4))].append(bad[i // 4 % 3])
        docs.append((toxic, sentences))
    return docs, bad


def test_gapped_and_inserted_forms_are_caught():
    docs, bad = corpus()
    scorer = X.Scorer(X.fit(docs))
    p = lambda t: float(scorer.model.probability(scorer.margins([t]))[0])
    for w in bad:
        for form in (w, w.upper(), f"({w})!", " ".join(w), "-".join(w), f"{w[:4]}x{w[4:]}", f"{w[:3]}*{w[3:]}", w + "s"):
            assert p(f"you are a {form} really") >= 0.5, form
    # texts of words that the training texts hold as clean
    clean = [" ".join(w for s in sentences for w in s) for t, sentences in docs if not t]
    assert np.mean(scorer.model.probability(scorer.margins(clean)) >= 0.5) < 0.02


def test_a_word_cache_that_starts_anew_changes_nothing():
    docs, bad = corpus(80)
    m = X.fit(docs)
    texts = [" ".join(w for s in ss for w in s) for _, ss in docs]
    small, large = X.Scorer(m, cache_words=5), X.Scorer(m)
    assert all(np.array_equal(small.margins(texts[i:i + 20]), large.margins(texts[i:i + 20])) for i in range(0, 80, 20))


def test_held_out_accuracy(spark):
    got = op9_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(crc_mod(r["doc_id"], 5) == 0 for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "plain words"), (3, ""), (3, ""), (4, "x" * 300_000), (5, "... ! ?")],
                                 "doc_id long, text string").selectExpr("*", "'s' as score", "1 as __n")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = X.train(docs, none)
    rows = X.score(docs, m).collect()
    assert len(rows) == 6 and all(r["score"] < 0.5 for r in rows)
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (4, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    assert X.score(docs, X.train(docs, labels)).count() == 6
    assert X.score(docs.limit(0), m).count() == 0
