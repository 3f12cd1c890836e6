"""The keyed upsert sink: batches replayed, unfinished and read half-way, full versions, the running statistics."""

import os

from pyspark.sql import functions as F

from geoplane.streaming import streams as ST


def _batch(spark, rows):
    return spark.createDataFrame(rows, "k string, n bigint")


def _state(spark, sink):
    return {r["k"]: r["n"] for r in ST.read_upserts(spark, sink, ["k"]).collect()}


def test_replayed_unfinished_and_full_versions(spark, tmp_dir):
    sink = os.path.join(tmp_dir, "sink")
    ST.upsert_batch(_batch(spark, [("a", 1), ("b", 1), (None, 1)]), 0, sink, ["k"], full_every=3)
    ST.upsert_batch(_batch(spark, [("a", 2), ("c", None)]), 1, sink, ["k"], full_every=3)
    want = {"a": 2, "b": 1, None: 1, "c": None}
    assert _state(spark, sink) == want
    ST.upsert_batch(_batch(spark, [("a", 99)]), 1, sink, ["k"], full_every=3)         # a complete batch is not written again
    assert _state(spark, sink) == want
    reader = ST.read_upserts(spark, sink, ["k"])                                     # listed before the next batches
    _batch(spark, [("a", 50)]).write.parquet(f"{sink}/delta-2")
    os.remove(f"{sink}/delta-2/_SUCCESS")                                            # lost before its commit
    assert _state(spark, sink) == want
    ST.upsert_batch(_batch(spark, [("b", 3)]), 2, sink, ["k"], full_every=3)
    ST.upsert_batch(_batch(spark, [("d", 4), (None, 7)]), 3, sink, ["k"], full_every=3)
    assert os.path.exists(f"{sink}/full-3")
    assert {r["k"]: r["n"] for r in reader.collect()} == want
    want |= {"b": 3, "d": 4, None: 7}
    assert _state(spark, sink) == want
    for n in range(4, 7):
        ST.upsert_batch(_batch(spark, [("e", n)]), n, sink, ["k"], full_every=3)
    ST.upsert_batch(_batch(spark, []), 7, sink, ["k"], full_every=3)
    assert _state(spark, sink) == want | {"e": 6}
    assert sorted(p for p in os.listdir(sink)) == ["delta-4", "delta-5", "delta-7", "full-3", "full-6"]


def test_running_stats_over_several_batches_and_a_restart(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, n) for n in ("src", "sink", "ckpt"))
    rows = spark.range(300).select((F.col("id") % 4).cast("string").alias("collection"),
                                   *[(F.col("id") * k).cast("double").alias(c) for k, c in
                                     ((1, "_xmin"), (2, "_ymin"), (3, "_xmax"), (4, "_ymax"))])
    schema = rows.schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        ST.run_upserts(ST.running_collection_stats(stream), ["collection"], sink, full_every=2, checkpoint=ckpt)
        return {tuple(r) for r in ST.read_upserts(spark, sink, ["collection"]).collect()}

    def whole():
        return {tuple(r) for r in ST.running_collection_stats(spark.read.parquet(src)).collect()}
    rows.repartition(3).write.parquet(src)
    assert run() == whole()
    rows.filter("collection = '1'").write.mode("append").parquet(src)
    assert run() == whole()
