"""Aggregations of a collection (AGG-1..8, AGG-14) and exact quantiles.

All of them are global aggregates with partial (map-side) aggregation; none
gathers a column into one task.  Exact ``percentile_cont`` is computed by
:func:`exact_quantiles` by distributed rank selection instead of Spark's
``percentile`` (whose buffer holds every distinct value in one final task).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs as _crs
from ..schema import BBOX_COLUMNS, pg_type

APPROX_ACCURACY = 10_000


# ---------------------------------------------------------------- AGG-1
def number_matched(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("number_matched"))


# ---------------------------------------------------------------- AGG-2
def column_profile(df: DataFrame, exclude=("geom", *BBOX_COLUMNS), approx_distinct: bool = False,
                   typed: bool = False) -> DataFrame:
    """Per column: type, non-null / null counts, distinct count, min / max as text.

    Text min/max compare lexicographically ('10' < '9') as the reference's
    ``::text`` does.  Counts, minima and maxima come from one map-side
    combined aggregate; for the distinct counts, a 128-bit hash of every
    (column, value) is de-duplicated, map-side first, so neither texts nor a
    hot value cross the shuffle more than once a task.  An empty table gives
    its columns with zero counts.  ``approx_distinct`` uses one HyperLogLog++
    aggregate instead.
    ``typed`` adds ``min_typed`` / ``max_typed``: min / max in the column's own
    order (numbers numerically, dates chronologically), shown as text.
    """
    out = _column_profile(df, exclude, approx_distinct)
    if not typed:
        return out
    cols = [f for f in df.schema.fields if f.name not in exclude]
    aggs = []
    for i, f in enumerate(cols):
        c = F.col(f"`{f.name}`")
        aggs += [F.min(c).cast("string").alias(f"tn{i}"), F.max(c).cast("string").alias(f"tx{i}")]
    wide = df.agg(*aggs)                                        # one row
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"tn{i}").alias("min_typed"),
                              F.col(f"tx{i}").alias("max_typed")) for i in range(len(cols))])
    typed_rows = wide.select(F.inline(rows))                    # one row per column
    return out.join(F.broadcast(typed_rows), "ordinal", "left")


def _column_profile(df: DataFrame, exclude, approx_distinct: bool) -> DataFrame:
    cols = [f for f in df.schema.fields if f.name not in exclude]
    meta = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"),
                              F.lit(pg_type(f.dataType)).alias("data_type"),
                              F.lit(bool(f.nullable)).alias("nullable")) for i, f in enumerate(cols)])
    if approx_distinct:
        aggs = [F.count(F.lit(1)).alias("__total")]
        for i, f in enumerate(cols):
            c = F.col(f"`{f.name}`")
            aggs += [F.count(c).alias(f"nn{i}"), F.approx_count_distinct(c).alias(f"nd{i}"),
                     F.min(c.cast("string")).alias(f"mn{i}"), F.max(c.cast("string")).alias(f"mx{i}")]
        wide = df.agg(*aggs)
        rows = F.array(*[F.struct(F.col(f"nn{i}").alias("non_null_count"),
                                  (F.col("__total") - F.col(f"nn{i}")).alias("null_count"),
                                  F.col(f"nd{i}").alias("distinct_count"),
                                  F.col(f"mn{i}").alias("min_value"), F.col(f"mx{i}").alias("max_value"))
                         for i in range(len(cols))])
        z = F.arrays_zip(meta.alias("m"), rows.alias("r"))
        return wide.select(F.col("__total").alias("total_count"), F.explode(z).alias("e")).select(
            "total_count", "e.m.*", "e.r.*")
    # counts, minima and maxima: one aggregate row, present for an empty table too
    aggs = [F.count(F.lit(1)).alias("__total")]
    for i, f in enumerate(cols):
        c = F.col(f"`{f.name}`").cast("string")
        aggs += [F.count(c).alias(f"nn{i}"), F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}")]
    stats = F.array(*[F.struct(F.col(f"nn{i}").alias("non_null_count"), F.col(f"mn{i}").alias("min_value"),
                               F.col(f"mx{i}").alias("max_value")) for i in range(len(cols))])
    z = F.arrays_zip(meta.alias("m"), stats.alias("r"))
    per_col = df.agg(*aggs).select(F.col("__total").alias("total_count"), F.explode(z).alias("e")).select(
        "total_count", "e.m.*", "e.r.*")
    # distinct values: only a 128-bit hash of (column, value) is shuffled
    hashed = []
    for i, f in enumerate(cols):
        v = F.col(f"`{f.name}`").cast("string")
        hashed.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("k"), F.xxhash64(v).alias("h"),
                                                     F.xxhash64(F.lit(i), v, F.lit("distinct")).alias("g"))))
    pairs = df.select(F.explode(F.array_compact(F.array(*hashed))).alias("p")).select("p.*").distinct()
    distinct = pairs.groupBy("k").agg(F.count(F.lit(1)).alias("distinct_count"))
    out = per_col.join(distinct, per_col["ordinal"] == distinct["k"], "left")
    return out.select("total_count", "ordinal", "column_name", "data_type", "nullable",
                      F.col("non_null_count").cast("bigint").alias("non_null_count"),
                      (F.col("total_count") - F.col("non_null_count")).cast("bigint").alias("null_count"),
                      F.coalesce("distinct_count", F.lit(0)).cast("bigint").alias("distinct_count"),
                      "min_value", "max_value")


def geometry_profile(coll) -> dict:
    """AGG-3: the geometry column reports only its type and SRID."""
    return {"column_name": coll.geometry_column, "geometry_type": coll.geometry_type, "srid": coll.srid}


# ---------------------------------------------------------------- AGG-4, AGG-5
def extent(coll, target_srid: int = 4326) -> DataFrame:
    """AGG-4 ST_Extent(ST_Transform(geom, 4326)): null when the collection is empty.

    Point collections transform their bbox corner (the point); other kinds
    transform every vertex before taking min/max.
    """
    if coll.srid == target_srid:
        src = coll.df.select(*BBOX_COLUMNS)
    elif coll.geometry_type == "Point":
        x, y = _crs.transform_xy(F.col("_xmin"), F.col("_ymin"), coll.srid, target_srid)
        src = coll.df.select(x.alias("_xmin"), y.alias("_ymin"), x.alias("_xmax"), y.alias("_ymax"))
    else:
        from ..functions.geometry import bbox_columns, transform_geom
        bb = bbox_columns(transform_geom(F.col(coll.geometry_column), coll.srid, target_srid))
        src = coll.df.select(*[bb[c].alias(c) for c in BBOX_COLUMNS])
    return src.agg(F.min("_xmin").alias("xmin"), F.min("_ymin").alias("ymin"),
                   F.max("_xmax").alias("xmax"), F.max("_ymax").alias("ymax"))


def sample_extent(coll, n: int = 1000) -> DataFrame:
    """AGG-5: bbox of the first ``n`` features by id, native coordinates (top-n per partition)."""
    first = coll.df.select(coll.id_column, *BBOX_COLUMNS).orderBy(coll.id_column).limit(n)
    return first.agg(F.min("_xmin").alias("xmin"), F.min("_ymin").alias("ymin"),
                     F.max("_xmax").alias("xmax"), F.max("_ymax").alias("ymax"))


# ---------------------------------------------------------------- AGG-6, AGG-8, AGG-14
def numeric_range(df: DataFrame, field: str) -> DataFrame:
    c = F.col(f"`{field}`").cast("double")
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"))


def distinct_values(df: DataFrame, field: str, limit: int = 50) -> DataFrame:
    """AGG-8 / SET-1: non-null distinct values ascending, first ``limit``."""
    c = F.col(f"`{field}`")
    return df.select(c.alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value").limit(limit)


def temporal_extent(coll) -> DataFrame:
    """AGG-14: [start, end] of the datetime column (stored but never computed by the reference)."""
    if not coll.datetime_column:
        raise ValueError("Collection has no datetime column")
    c = F.col(coll.datetime_column)
    return coll.df.agg(F.min(c).alias("start"), F.max(c).alias("end"))


# ---------------------------------------------------------------- AGG-7 exact quantiles
def exact_quantiles(df: DataFrame, field: str, probs: list[float], n: int | None = None) -> list[float | None]:
    """Exact ``percentile_cont`` (linear interpolation, nulls and NaN excluded).

    Two ranks a probability are read by :func:`select_ranks`; only those values
    reach the driver.
    """
    v = F.col(f"`{field}`").cast("double")
    base = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = base.count() if n is None else n
    if n == 0:
        return [None for _ in probs]
    at = [(n - 1) * float(p) for p in probs]
    low = [math.floor(h) for h in at]
    found = select_ranks(base, "v", sorted({*low, *(min(k + 1, n - 1) for k in low)}))
    values = {k: float(v) for k, (v, _) in found.items()}
    return [values[k] + (h - k) * (values[min(k + 1, n - 1)] - values[k]) for h, k in zip(at, low)]


def select_ranks(base: DataFrame, col: str, ranks: list[int]) -> dict[int, tuple]:
    """``rank: (value, values below it)`` for ascending 0-based ranks of ``col``; one path for every size.

    Equal values are counted first (map-side, so a hot value is one row), the
    distinct values are range-partitioned and checkpointed, and each
    partition's count tells which partition holds a rank.  Only those
    partitions -- one for each rank at most -- are ordered, each in its own
    window, and the row whose running count passes the rank is read.  Nulls
    are left out.
    """
    counted = base.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = (counted.repartitionByRange("v").withColumn("p", F.spark_partition_id()).checkpoint())
    sums = sorted((r["p"], r["n"]) for r in parts.groupBy("p").agg(F.sum("n").alias("n")).collect())   # one row each
    wanted, below, at = [], 0, 0
    for p, n in sums:
        while at < len(ranks) and ranks[at] < below + n:
            wanted.append((p, ranks[at], ranks[at] - below))
            at += 1
        below += n
    if at < len(ranks):
        raise ValueError(f"rank {ranks[at]} of {below} values")
    asked = base.sparkSession.createDataFrame(wanted, "p int, rank bigint, inside bigint")    # the caller's ranks
    running = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    inside = parts.filter(F.col("p").isin(sorted({w[0] for w in wanted}))).withColumn("upto", running)
    hit = inside.join(F.broadcast(asked), "p").filter(
        (F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
    ends = hit.select("rank", "v", (F.col("rank") - F.col("inside") + F.col("upto") - F.col("n")).alias("below"))
    return {r["rank"]: (r["v"], r["below"]) for r in ends.collect()}


def quantile_breaks(df: DataFrame, field: str, classes: int = 5, exact: bool = True,
                    n: int | None = None) -> list[float]:
    """AGG-7: breakpoints at i/n for i = 1..n-1 (``percentile_approx`` when not exact).

    ``n``: the number of non-null, non-NaN values when the caller already has it.
    """
    fracs = [(i + 1) / classes for i in range(classes - 1)]
    if exact:
        return exact_quantiles(df, field, fracs, n)
    row = df.agg(F.percentile_approx(F.col(f"`{field}`").cast("double"), fracs, APPROX_ACCURACY).alias("q")).first()
    return list(row["q"] or [])
