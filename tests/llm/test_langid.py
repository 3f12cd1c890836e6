import numpy as np
import pytest
from pyspark.sql import functions as F

from geoplane.llm import langid as L
from geoplane.llm.common import crc_mod
from geoplane.llm.queries import op1_langid

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [2, 3, 4, 7, 9, 30])
def test_codewords_are_far_apart(n):
    c = L.codewords(n)
    distance = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
    assert min(distance) >= (2 ** (n - 2) if n <= 7 else c.shape[1] // 4)
    assert all(len(set(col)) == 2 for col in c.T)


def test_decoding_corrects_one_wrong_bit():
    code = L.codewords(5)
    m = L.LanguageModel(tuple("abcde"), code, np.eye(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    for i, word in enumerate(code):
        for bit in range(code.shape[1]):
            x = word.copy()
            x[bit] *= -1
            best, p, second, _ = m.decode(x[None])
            assert best[0] == i and 0 <= p[0] <= 1 and second[0] != i
    half = (code[0] + code[1]) / 2
    assert m.decode(half[None])[3][0]                      # as near to two codewords: ambiguous


def test_held_out_accuracy(spark):
    got = op1_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out").collect()
    assert all(crc_mod(r["doc_id"], 3) == 1 for r in rows) and len(rows) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert got.filter("not held_out").count() + len(rows) == 1000


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog are here", "en"), (2, "der hund und die katze sind da", "de"), (3, None, "en"),
         (4, "12 34 !!", "de"), (None, "the hat and the log", None), (5, "", None), (5, "", None),
         (6, "the dog " * 400_000, None)],
        "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = L.train(docs)
    rows = L.predict(docs, model).collect()
    assert len(rows) == 8
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert all(r["score"] == 0.0 for r in rows if r["lang_pred"] == "und")
    assert {r["doc_id"]: r["lang_pred"] for r in rows}[6] == "en"
    assert L.predict(docs.limit(0), model).count() == 0
    nothing = L.train(docs.limit(0))
    assert {r["lang_pred"] for r in L.predict(docs, nothing).collect()} == {"und"}
    kept = L.identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 6}
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({3, 4, 5})


def test_chunks_change_no_feature(monkeypatch):
    import numpy as np

    from geoplane.llm import langid as L

    texts = ["the quick brown fox, " * 40, "ab", "", None, "zażółć gęślą jaźń " * 33]
    whole = L.features(texts)[0]
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(L, "CHUNK", size)
        assert np.array_equal(L.features(texts)[0], whole)
