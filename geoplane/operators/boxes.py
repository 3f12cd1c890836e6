"""Counts and first pages of many boxes over points (PAG-1, PAG-3 batch forms) without their pairs.

Counts: a box is a range of the points' ranks by x, cut into aligned nodes of
1, 16, 256, ... ranks.  Each point lies in one node of each size in use and each
box in a few, so one running count over (size, node, y) gives every box's number
of points: the rows are points and boxes times the number of sizes, whatever the
boxes hold.

Pages: the features with the smallest ids come first, eight times as many in each
round; a box stays in the rounds until its page is full.  Boxes that hold fewer
points than a page end meet all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from . import joins as J

NODE_BITS = 4                  # a node has 16 children
PARTITION_ROWS = 500_000
FIRST_ROWS = 4096              # features of the first round of pages
ROUND_FACTOR = 8
LEAST_SHARE = 1 / 4096         # of the features, in the first round: what the approximate quantiles can tell apart


def _written(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared folder and read back."""
    path = f"{session.ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/boxes-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_count(rows: DataFrame, order: list[str], keep: list[str], n_rows: int) -> DataFrame:
    """``keep`` and ``__before`` of the rows with ``__ask``: the sum of ``__w`` over all rows before them in ``order``.

    The rows are dealt by ranges of ``order``, each partition counts its own, and
    the partitions' totals (one row each) are added up.
    """
    types = {c: rows.schema[c].dataType for c in keep} | {
        "__part": T.IntegerType(), "__before": T.LongType(), "__total": T.BooleanType()}
    schema = T.StructType([T.StructField(c, t) for c, t in types.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            w = b.column("__w").to_numpy(zero_copy_only=False).astype(np.int64)
            before = seen + np.cumsum(w) - w
            seen, last = seen + int(w.sum()), b
            asked = b.append_column("__before", pa.array(before)).filter(b.column("__ask"))
            n = asked.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(asked.column(c) for c in keep), pa.array(np.full(n, part, np.int32)), asked.column("__before"),
                 pa.array(np.zeros(n, bool))], [*keep, "__part", "__before", "__total"])
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, last.column(c).type) for c in keep), pa.array([part], pa.int32()),
                 pa.array([seen], pa.int64()), pa.array([True])], [*keep, "__part", "__before", "__total"])

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // PARTITION_ROWS))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # written once: a second reading could deal the rows by other ranges
    counted = _written(dealt.select(*keep, "__w", "__ask", *[c for c in order if c not in keep]).mapInArrow(run, schema))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)     # one row a partition
    offsets = counted.filter("__total").select(
        F.col("__part"), F.coalesce(F.sum("__before").over(earlier), F.lit(0)).alias("__off"))
    return counted.filter(~F.col("__total")).join(F.broadcast(offsets), "__part").select(
        *keep, (F.col("__before") + F.col("__off")).alias("__before"))


def _nodes(low: Column, high: Column, top: int) -> Column:
    """The aligned nodes (level, node) that cover the ranks from ``low`` to below ``high``."""
    def between(a: Column, b: Column, level: int) -> Column:
        each = F.transform(F.sequence(a, b - 1), lambda v: F.struct(F.lit(level).alias("lv"), v.alias("node")))
        return F.when(a < b, each).otherwise(F.array().cast("array<struct<lv:int,node:bigint>>"))

    parts = []
    for level in range(top + 1):
        size = 1 << (NODE_BITS * level)
        lo, hi = F.shiftright(low + F.lit(size - 1), NODE_BITS * level), F.shiftright(high, NODE_BITS * level)
        if level == top:
            parts.append(between(lo, hi, level))
            continue
        up = size << NODE_BITS
        lo_up, hi_up = F.shiftright(low + F.lit(up - 1), NODE_BITS * (level + 1)), F.shiftright(high, NODE_BITS * (level + 1))
        whole = lo_up < hi_up
        parts.append(between(lo, F.when(whole, F.shiftleft(lo_up, NODE_BITS)).otherwise(hi), level))
        parts.append(between(F.when(whole, F.shiftleft(hi_up, NODE_BITS)).otherwise(hi), hi, level))
    return F.concat(*parts)


def batch_bbox_counts(coll, requests: DataFrame, req_id: str = "req_id") -> DataFrame:
    """(req_id, n): number of features whose envelope meets the request's box; requests without any may be missing.

    Points are counted without pairs; other features by their pairs.
    """
    if coll.geometry_type != "Point":
        return J.batch_bbox(coll, requests, req_id).groupBy(req_id).agg(F.count(F.lit(1)).alias("n"))
    key = requests.schema[req_id].dataType
    boxes = requests.filter("_xmin <= _xmax AND _ymin <= _ymax").select(
        F.col(req_id).alias("__q"), *[(F.col(c) + F.lit(0.0)).alias(c) for c in J._BOX])
    points = coll.df.filter("_xmin IS NOT NULL AND _ymin IS NOT NULL").select(
        (F.col("_xmin") + F.lit(0.0)).alias("__x"), (F.col("_ymin") + F.lit(0.0)).alias("__y"),
        F.xxhash64(coll.id_column).alias("__tie"))
    n_points, n_boxes = points.count(), boxes.count()
    # ranks by x: of the points, and of the first point inside and the first beyond each box
    none = F.lit(None).cast(key)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("_xmin").alias("v")),
                              F.struct(F.lit(2).alias("k"), F.col("_xmax").alias("v"))))
    number = F.monotonically_increasing_id()
    numbered = _written(boxes.withColumn("__b", number))
    ends = numbered.select("__b", sides.alias("s")).select(
        F.col("s.v").alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(0).cast("long").alias("__tie"),
        F.col("s.k").alias("__k"), F.lit(0).alias("__w"), F.col("__b"))
    rows = points.select("__x", "__y", "__tie", F.lit(1).alias("__k"), F.lit(1).alias("__w"),
                         F.lit(None).cast("long").alias("__b")).unionByName(ends).withColumn("__ask", F.lit(True))
    ranked = running_count(rows, ["__x", "__k", "__y", "__tie"], ["__y", "__k", "__b"], n_points + 2 * n_boxes)
    bounds = ranked.filter("__k <> 1").groupBy("__b").agg(
        F.min("__before").alias("__low"), F.max("__before").alias("__high"))
    boxes = numbered.join(bounds, "__b").select("__q", F.col("_ymin"), F.col("_ymax"), "__low", "__high")
    widest = boxes.agg(F.max(F.col("__high") - F.col("__low")).alias("w")).first()["w"] or 0
    top = max(0, (widest.bit_length() - 1) // NODE_BITS)
    # one running count by y in every node
    levels = F.explode(F.array(*[F.struct(F.lit(v).alias("lv"), F.shiftright("__before", NODE_BITS * v).alias("node"))
                                 for v in range(top + 1)]))
    inside = ranked.filter("__k = 1").select("__before", "__y", levels.alias("at")).select(
        "at.lv", "at.node", "__y", F.lit(1).alias("__k"), F.col("__before").alias("__tie"), F.lit(1).alias("__w"),
        F.lit(False).alias("__ask"), none.alias("__q"))
    asked = boxes.select("__q", "_ymin", "_ymax", F.explode(_nodes(F.col("__low"), F.col("__high"), top)).alias("at"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("_ymin").alias("v")),
                              F.struct(F.lit(2).alias("k"), F.col("_ymax").alias("v"))))
    asked = asked.select("__q", "at", sides.alias("s")).select(
        "at.lv", "at.node", F.col("s.v").alias("__y"), F.col("s.k").alias("__k"), F.lit(0).cast("long").alias("__tie"),
        F.lit(0).alias("__w"), F.lit(True).alias("__ask"), "__q")
    counted = running_count(inside.unionByName(asked), ["lv", "node", "__y", "__k", "__tie"], ["__q", "__k"],
                            (top + 1) * (n_points + 30 * n_boxes))
    return counted.groupBy(F.col("__q").alias(req_id)).agg(F.sum((F.col("__k") - 1) * F.col("__before")).alias("n"))


def batch_bbox_first(coll, requests: DataFrame, k: int, req_id: str = "req_id") -> DataFrame:
    """(req_id, id): the ``k`` smallest ids (nulls last) of every request's box.

    Ids that are no numbers go through all pairs.
    """
    ident = F.col(coll.id_column)
    if not isinstance(coll.df.schema[coll.id_column].dataType, T.NumericType):
        return J.batch_bbox(coll, requests, req_id)
    n = coll.df.count()
    share, shares = max(FIRST_ROWS / n, LEAST_SHARE) if n else 1.0, []
    while share < 1:
        shares.append(share)
        share *= ROUND_FACTOR
    cuts = coll.df.select(F.percentile_approx(ident, F.array(*map(F.lit, shares)), 20_000).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []))
    first = Window.partitionBy(req_id).orderBy(F.col("id").asc_nulls_last())
    found, open_ = None, requests
    for low, high in zip([None, *cuts], [*cuts, None]):
        limits = ([] if low is None else [(ident > low) | ident.isNull()]) + ([] if high is None else [ident <= high])
        part = replace(coll, df=coll.df.filter(reduce(lambda a, b: a & b, limits))) if limits else coll
        pairs = J.batch_bbox(part, open_, req_id)
        met = pairs if found is None else found.unionByName(pairs)
        found = _written(met.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= k).drop("__n"))
        if high is None:
            break
        full = found.groupBy(F.col(req_id).alias("__q")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= k)
        open_ = requests.join(full, F.col(req_id).eqNullSafe(F.col("__q")), "left_anti")
        if open_.isEmpty():
            break
    return found
