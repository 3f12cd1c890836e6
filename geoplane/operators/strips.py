"""Edges of (multi)polygons by horizontal strips (JN-7, JN-10, STR-4).

A point's even-odd test and its boundary test concern only the edges whose
height range holds the point.  Each polygon is cut into strips of equal height,
each strip lists the edges that reach into it, and a candidate pair joins its
strip: a point meets a few edges of a polygon of any size, and the answer is
that of all edges.  The number of strips keeps the lists of a polygon at four
entries an edge at most, however tall its edges are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spatial as K

# Edges of a strip aimed at; polygons of fewer than two strips are one list.
EDGES_PER_STRIP = 8
BROADCAST_BYTES = 64 << 20
EDGE_BYTES = 48


def edges(geom: Column) -> Column:
    """All ring segments in their own direction: array of (a, b) vertices."""
    return F.flatten(F.transform(F.flatten(geom["parts"]), lambda ring: F.transform(
        K.segment_indexes(ring), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))))


def layout(geom: Column) -> Column:
    """(y0, y1, n): height range of a geometry and its number of strips."""
    def strips(e: Column) -> Column:
        low = F.array_min(F.transform(e, lambda s: F.least(s["a"]["y"], s["b"]["y"])))
        high = F.array_max(F.transform(e, lambda s: F.greatest(s["a"]["y"], s["b"]["y"])))
        tall = F.aggregate(e, F.lit(0.0), lambda t, s: t + F.abs(s["b"]["y"] - s["a"]["y"]))
        size = F.size(e).cast("double")
        # an edge of height h reaches into h / height * n + 1 strips at most
        n = F.floor(F.least(size / EDGES_PER_STRIP, F.coalesce(F.try_divide(3.0 * size * (high - low), tall), F.lit(1.0))))
        return F.struct(low.alias("y0"), high.alias("y1"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("int").alias("n"))
    return F.get(F.transform(F.array(edges(geom)), strips), 0)


def strip_of(y: Column, at: Column) -> Column:
    """The strip of a height; it never falls as y grows, so an edge's strips hold those of all its heights."""
    k = F.floor((y - at["y0"]) * (at["n"] / (at["y1"] - at["y0"])))
    return F.when(at["n"] <= 1, 0).otherwise(F.least(at["n"] - 1, F.greatest(F.lit(0), k))).cast("int")


def strip_table(geoms: DataFrame, key: str, geom_col: str) -> DataFrame:
    """``key, __strip, __edges`` of every strip with an edge; broadcast behind a bound of its bytes."""
    rows = geoms.select(key, edges(F.col(geom_col)).alias("e"), layout(F.col(geom_col)).alias("at"))
    whole = rows.filter("at.n <= 1").select(key, F.lit(0).alias("__strip"), F.col("e").alias("__edges"))
    each = rows.filter("at.n > 1").select(key, "at", F.explode("e").alias("e"))
    low, high = F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y")
    cut = each.select(key, F.explode(F.sequence(strip_of(low, F.col("at")), strip_of(high, F.col("at")))).alias("__strip"), "e")
    table = whole.unionByName(cut.groupBy(key, "__strip").agg(F.collect_list("e").alias("__edges")))
    vertices = F.size(F.flatten(F.flatten(F.col(geom_col)["parts"])))
    size = geoms.agg(F.sum(F.coalesce(vertices, F.lit(0)) * 4 * EDGE_BYTES + 64).alias("b")).first()["b"] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("merge")


def point_hits(pairs: DataFrame, geoms: DataFrame, key: str, geom_col: str, op: str,
               px: str = "__px", py: str = "__py", at: str = "__at") -> DataFrame:
    """Candidate pairs (with the polygon's ``layout`` in ``at``) whose point holds ``op`` against the polygon.

    ``op``: s_intersects (boundary counts), s_touches (boundary only), else interior only.
    """
    x, y, e = F.col(px), F.col(py), F.col("__edges")
    placed = pairs.withColumn("__strip", strip_of(y, F.col(at)))
    met = placed.join(strip_table(geoms, key, geom_col), [key, "__strip"])
    inside = F.size(F.filter(e, lambda s: K.edge_crosses(s["a"], s["b"], x, y))) % 2 == 1
    edge = F.exists(e, lambda s: K.edge_touches(s["a"], s["b"], x, y))
    hit = {"s_intersects": inside | edge, "s_touches": edge}.get(op, inside & ~edge)
    return met.filter(hit).drop("__strip", "__edges")
