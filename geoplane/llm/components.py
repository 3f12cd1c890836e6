"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoplane.llm.common import written


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node that has an edge to another node.

    ``root`` is the smallest node value of the component.  Alternating large-
    and small-star steps: every step is a map-side combined minimum and an
    equality join, a component of any diameter needs a logarithmic number of
    rounds, and each round's edges are written to the shared folder.  Self
    loops, repeated edges and null ends are ignored; no edges gives no rows.
    """
    e = (edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
         .filter("a > b").distinct())
    e = written(e, "edges")
    before = _signature(e)
    while before[0]:
        e = written(_star(_star(e, True), False), "edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
