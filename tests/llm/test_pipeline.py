import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from geoplane.llm import queries as Q
from geoplane.llm import secrets, simhash
from geoplane.llm.common import table, written

SF = "/root/testdata/sf0.01"


def test_every_operator_is_registered_once():
    names = sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES)
    assert names == list(range(1, 14))
    assert set(Q.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan",
                                        "sentencepiece"]


def test_each_stage_takes_effect_on_what_its_predecessor_kept(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] > 800
    fps = simhash.fingerprints(docs).collect()
    assert len({r["doc_id"] for r in fps}) == len(fps)
    assert all(not secrets.base_spans(r["text"]) for r in docs.collect())
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[-1] and last.filter("not restored").count() == 0
    assert sorted(r["doc_id"] for r in last.select("doc_id").collect()) == sorted(
        r["doc_id"] for r in P.run(spark, SF).select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(Q.ORACLE[name]).df()
    got = Q.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).reset_index(drop=True).astype(str).equals(
        want.sort_values(key).reset_index(drop=True).astype(str))


def test_stages_take_rows_with_nulls_and_empty_tables(spark):
    rows = [(1, None, "en", None, None), (None, "plain words of some text here", None, "s", 3), (2, "", None, None, 0),
            (2, "", None, None, 0), (3, "another little text in this table", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() <= 5
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """(1, A), (5, A), (5, B): the copy goes, both texts stay; of (7, item), (7, clean) the clean one stays."""
    a, b = "first text " * 30 + "of the little corpus", "quite another " * 25 + "piece of prose here"
    item = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ((1, a), (5, a), (5, b), (5, b), (None, a))], schema)
    got = sorted((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, SF).collect())
    assert got == sorted([(1, a), (5, b)])
    rows = [(7, item), (7, a), (None, item), (None, b), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    got = [(r["doc_id"], r["text"]) for r in P.benchmark_overlap(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(7, a), (None, b), (8, None), (9, "")], key=str)
