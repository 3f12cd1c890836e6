"""Plan-shape assertions: no nested loops or cartesian products in batch joins,
bbox filters reach the Parquet scan, bounded top-k per request."""

from pyspark.sql import functions as F

from geoplane.operators import joins as J
from geoplane.plans import collection as C
from geoplane.plans import tables as T

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _boxes(spark):
    s = T.suppliers(spark, SF).df
    return s.select(F.col("id").alias("req_id"), (F.col("_xmin") - 0.3).alias("_xmin"), (F.col("_ymin") - 0.3).alias("_ymin"),
                    (F.col("_xmax") + 0.3).alias("_xmax"), (F.col("_ymax") + 0.3).alias("_ymax"))


def test_batch_joins_are_hash_joins(spark):
    for df in (J.batch_bbox(T.orders(spark, SF), _boxes(spark)),
               J.batch_point_lookup(T.nations(spark, SF), T.orders(spark, SF).df.select(
                   F.col("id").alias("pid"), F.col("_xmin").alias("x"), F.col("_ymin").alias("y")))):
        p = plan_of(df)
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
        assert "HashJoin" in p or "SortMergeJoin" in p


def test_unbounded_sides_shuffle_instead_of_broadcast(spark):
    df = J.batch_bbox(T.orders(spark, SF), _boxes(spark), broadcast_max_rows=10)
    p = plan_of(df)
    assert "NestedLoopJoin" not in p and "BroadcastHashJoin" not in p


def test_salted_join_same_result(spark):
    a = J.batch_bbox(T.orders(spark, SF), _boxes(spark))
    b = J.batch_bbox(T.orders(spark, SF), _boxes(spark), salt=4, broadcast_max_rows=10)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_multilevel_grid_handles_huge_boxes(spark):
    """A box covering the world lives at a coarse level; results equal the nested loop."""
    o = T.orders(spark, SF)
    reqs = spark.createDataFrame([(1, -180.0, -90.0, 180.0, 90.0), (2, 1.0, 44.0, 1.2, 44.2)],
                                 "req_id int, _xmin double, _ymin double, _xmax double, _ymax double")
    got = J.batch_bbox(o, reqs, cell=0.01).groupBy("req_id").count().orderBy("req_id").collect()
    n_all = o.df.count()
    n_small = o.df.filter("_xmin BETWEEN 1.0 AND 1.2 AND _ymin BETWEEN 44.0 AND 44.2").count()
    want = [(1, n_all)] + ([(2, n_small)] if n_small else [])
    assert [tuple(r) for r in got] == want


def test_batch_pages_use_group_limit(spark):
    pairs = J.batch_bbox(T.orders(spark, SF), _boxes(spark))
    p = plan_of(C.batch_pages(pairs, "req_id", "id", limit=10, offset=0))
    assert "WindowGroupLimit" in p


def test_work_of_few_rows_is_dealt_over_the_partitions(spark):
    """One file is one scan task: rows with many partners, and pairs with a costly test, are dealt first."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = T.orders(spark, SF).df.limit(400).select(F.col("id").alias("req_id"), *[
        (F.col(c) + d).alias(c) for c, d in (("_xmin", -0.5), ("_ymin", -0.5), ("_xmax", 0.5), ("_ymax", 0.5))])
    met = J.batch_bbox(T.orders(spark, SF), wide)
    assert "REPARTITION_BY_NUM" in plan_of(met) and met.select(F.spark_partition_id()).distinct().count() == n
    areas = T.customer_areas(spark, SF)
    asked = areas.df.select(F.col("id").alias("gid"), "geom")
    pairs = J.batch_predicate(areas, asked, "s_contains")
    assert "REPARTITION_BY_NUM" in plan_of(pairs)
    assert {(r["gid"], r["gid"]) for r in asked.collect()} <= {tuple(r) for r in pairs.collect()}
