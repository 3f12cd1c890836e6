"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoplane.llm import bpetree as _bpetree
from geoplane.llm import bwtdedup as _bwtdedup
from geoplane.llm import decontaminate as _decontaminate
from geoplane.llm import htmltext as _htmltext
from geoplane.llm import kmeans as _kmeans
from geoplane.llm import langid as _langid
from geoplane.llm import merkle as _merkle
from geoplane.llm import quality as _quality
from geoplane.llm import rpforest as _rpforest
from geoplane.llm import secrets as _secrets
from geoplane.llm import sentencepiece as _sentencepiece
from geoplane.llm import simhash as _simhash
from geoplane.llm import toxicity as _toxicity
from geoplane.llm.common import fold, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = _langid.train(_langid.train_rows(docs))
    found = _langid.predict(docs, model)
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "lang_second", "ambiguous")


def op2_rpforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rpforest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentencepiece.encode_documents(table(spark, sf_dir, "documents"))


def op5_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _htmltext.extract_text(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = _quality.train(docs, _quality.train_labels(table(spark, sf_dir, "labels")))
    return _judged(_quality.score(docs, model), 0.3)


def op8_bwtdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bwtdedup.remove_repeats(table(spark, sf_dir, "documents"), length=400).drop("spans")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = _toxicity.train(docs, _toxicity.train_labels(table(spark, sf_dir, "labels")))
    return _judged(_toxicity.score(docs, model), 0.5)


def _judged(scores: DataFrame, cut: float) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score",
                         F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kmeans.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, salt="2:")[0]


def op12_bpetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _bpetree.encode_documents(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _merkle.manifest(table(spark, sf_dir, "documents"), _merkle.one_in_five(F.col("doc_id")))
    return rows.select("doc_id", "leaf", "subroot", "root", _merkle.proof(F.col("path")).alias("proof_sha256"),
                       "folded_root", "verified")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                        F.col("span_list").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_rpforest": op2_rpforest,
    "op3_secrets": op3_secrets,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_htmltext": op5_htmltext,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_bwtdedup": op8_bwtdedup,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_kmeans": op11_kmeans,
    "op12_bpetree": op12_bpetree,
    "op13_merkle": op13_merkle,
}
ORACLE: dict[str, str] = {
    "op6_decontaminate": _decontaminate.SQL,
    "op11_kmeans": _kmeans.SQL,
    "op13_merkle": _merkle.SQL,
}
