"""Vector tiles in the WebMercatorQuad matrix set (TIL-1..7).

A feature belongs to every tile whose envelope, expanded by the 256/4096
buffer on each side, overlaps its bbox (the reference's ``&&`` prefilter
against ``ST_TileEnvelope(z, x, y, margin)``).  Assignment is pure column
arithmetic: the tile index range of the expanded bbox is exploded, so a
whole pyramid is one ``explode`` + ``groupBy(z, x, y)`` job with partial
aggregation (a hot tile costs no more than any other group key).
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as _crs

# Tile extent and buffer (tile units), highest valid zoom.
EXTENT = 4096
BUFFER = 256
MARGIN = BUFFER / EXTENT           # 1/16 of a tile on each side
MAX_ZOOM = 30
# WebMercatorQuad scale denominator at zoom 0, tile size, matrix zooms.
SCALE_DENOMINATOR_Z0 = 559082264.0287178
TILE_SIZE = 256
MATRIX_MAX_ZOOM = 24
H = _crs.MERC_HALF_WORLD


def tile_matrix(spark, max_zoom: int = MATRIX_MAX_ZOOM) -> DataFrame:
    """TIL-1: one row per zoom of the WebMercatorQuad tile matrix set."""
    z = F.col("id").cast("int")
    n = F.pow(F.lit(2.0), z)
    return spark.range(max_zoom + 1).select(
        z.alias("z"), (F.lit(SCALE_DENOMINATOR_Z0) / n).alias("scale_denominator"),
        (F.lit(2 * H) / (n * TILE_SIZE)).alias("cell_size"),
        n.cast("bigint").alias("matrix_width"), n.cast("bigint").alias("matrix_height"),
        F.lit(-H).alias("origin_x"), F.lit(H).alias("origin_y"),
        F.lit(TILE_SIZE).alias("tile_width"), F.lit(TILE_SIZE).alias("tile_height"))


def tile_width(z) -> Column:
    z = z if isinstance(z, Column) else F.lit(int(z))
    return F.lit(2 * H) / F.pow(F.lit(2.0), z.cast("double"))


def tile_envelope(z: Column, x: Column, y: Column, margin: float = 0.0) -> dict[str, Column]:
    """TIL-2 ST_TileEnvelope in EPSG:3857 (y counted from the north edge), optionally buffered."""
    w = tile_width(z)
    return {"txmin": x * w - H - margin * w, "txmax": (x + 1) * w - H + margin * w,
            "tymax": H - y * w + margin * w, "tymin": H - (y + 1) * w - margin * w}


def is_valid_tile(z: Column, x: Column, y: Column) -> Column:
    """TIL-6: integers with 0 <= z <= 30 and 0 <= x, y < 2^z."""
    in_range = (z >= 0) & (z <= MAX_ZOOM)
    n = F.when(in_range, F.pow(F.lit(2.0), z.cast("double")).cast("bigint"))
    return F.when(in_range, (x >= 0) & (y >= 0) & (x < n) & (y < n)).otherwise(F.lit(False))


def mercator_bbox(coll) -> dict[str, Column]:
    """The collection's bbox columns in EPSG:3857 (corners transformed; monotone in both axes)."""
    x1, y1 = _crs.transform_xy(F.col("_xmin"), F.col("_ymin"), coll.srid, 3857)
    x2, y2 = _crs.transform_xy(F.col("_xmax"), F.col("_ymax"), coll.srid, 3857)
    return {"mx1": x1, "my1": y1, "mx2": x2, "my2": y2}


def _range(lo_expr: Column, hi_expr: Column, n: Column) -> Column:
    lo = F.greatest(F.ceil(lo_expr), F.lit(0))
    hi = F.least(F.floor(hi_expr), n - 1)
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def assign_tiles(coll, zooms, keep: list[str] | None = None) -> DataFrame:
    """TIL-3: (feature, z, x, y) for every tile whose buffered envelope overlaps the bbox.

    ``zooms``: an iterable of zoom levels.  ``keep``: feature columns to carry.
    """
    keep = list(keep or [coll.id_column])
    return assign_wide(coll, zooms, keep).select(*keep, "z", "x", "y", "mx1", "my1", "mx2", "my2")


def assign_wide(coll, zooms, keep: list[str]) -> DataFrame:
    """:func:`assign_tiles` with the tile's width ``__w``: each zoom's numbers are literals, and every range bound
    is a column of its own, since generated code beyond 8,000 bytes a method is never compiled."""
    mb = mercator_bbox(coll)
    df = coll.df.select(*keep, *[v.alias(k) for k, v in mb.items()]).filter(F.col("mx1").isNotNull())
    levels = [F.struct(F.lit(int(z)).alias("z"), F.lit(2 * H / 2.0 ** int(z)).alias("__w"),
                       F.lit(2 ** int(z)).cast("bigint").alias("__n")) for z in zooms]
    df = df.select("*", F.inline(F.array(*levels)))
    w, n = F.col("__w"), F.col("__n")
    df = df.select("*", F.ceil((F.col("mx1") + H) / w - 1 - MARGIN).alias("__xa"), F.floor((F.col("mx2") + H) / w + MARGIN).alias("__xb"),
                   F.ceil((H - F.col("my2")) / w - 1 - MARGIN).alias("__ya"), F.floor((H - F.col("my1")) / w + MARGIN).alias("__yb"))
    xs, ys = (_range(F.col(f"__{a}a"), F.col(f"__{a}b"), n) for a in "xy")
    df = df.select(*keep, *mb, "z", "__w", xs.alias("__xs"), ys.alias("__ys"))
    return (df.withColumn("x", F.explode("__xs")).withColumn("y", F.explode("__ys"))
            .select(*keep, "z", "x", "y", *mb, "__w"))


def quantize_point(mx: Column, my: Column, z: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """TIL-4 for points: tile-local integer coordinates, 0..4096, y down (half-up rounding)."""
    w = tile_width(z)
    env = tile_envelope(z, x, y)
    qx = F.floor((mx - env["txmin"]) / w * EXTENT + 0.5).cast("int")
    qy = F.floor((env["tymax"] - my) / w * EXTENT + 0.5).cast("int")
    return qx, qy


def point_tile_features(coll, zooms, props: list[str] | None = None) -> DataFrame:
    """TIL-3 + TIL-4 + PRJ-10 for a point collection: one row per (tile, feature)
    with quantized coordinates and properties cast to text."""
    props = props or []
    t = assign_tiles(coll, zooms, [coll.id_column, *props])
    qx, qy = quantize_point(F.col("mx1"), F.col("my1"), F.col("z"), F.col("x"), F.col("y"))
    return t.select("z", "x", "y", F.col(coll.id_column).alias("id"), qx.alias("qx"), qy.alias("qy"),
                    *[F.col(p).cast("string").alias(p) for p in props])


def families(coll) -> list[tuple[str, object]]:
    """A collection as its point, line and area parts; one part where the geometry type tells."""
    found = [k for k in ("Point", "LineString", "Polygon") if coll.geometry_type in (k, f"Multi{k}")]
    if found:
        return [(found[0], coll)]
    kind = F.col(coll.geometry_column)["type"]
    return [(k, replace(coll, df=coll.df.filter(kind.isin(k, f"Multi{k}")), geometry_type=f"Multi{k}"))
            for k in ("Point", "LineString", "Polygon")]


def pyramid_counts(coll, zooms) -> DataFrame:
    """TIL-7: features per tile over a zoom range (partial aggregation before the shuffle).

    Point collections are pre-aggregated first (:func:`_point_bins`), so the
    explode runs over occupied bins instead of features.  Lines and areas count
    in the tiles that still hold some of them after clipping (:mod:`quadtree`).
    """
    zooms = sorted({int(z) for z in zooms})
    if coll.geometry_type == "Point" and zooms:
        return _point_pyramid(coll, zooms)
    from .quadtree import tile_features
    keys = ["z", "x", "y"]
    rows = [(assign_tiles(c, zooms) if family == "Point" else tile_features(c, zooms)).select(*keys)
            for family, c in families(coll)]
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"))


def _point_bins(coll, zmax: int) -> DataFrame:
    """Points counted per bin of 1/16 tile at ``zmax`` (the margin's resolution).

    In bin units u = (X + H) / (2H) * 2^(zmax+4) every margin threshold of
    every zoom <= zmax is an integer, and scaling by powers of two is exact in
    floating point, so all points strictly inside a bin share their tile
    memberships at every zoom; points exactly on a bin edge get their own bin
    (flag).  A hot location collapses into one row before any explode.
    """
    scale = float(2 ** (zmax + 4))
    mx, my = _crs.transform_xy(F.col("_xmin"), F.col("_ymin"), coll.srid, 3857)
    u = (mx + H) / F.lit(2 * H) * F.lit(scale)
    v = (F.lit(H) - my) / F.lit(2 * H) * F.lit(scale)
    pts = coll.df.filter(F.col("_xmin").isNotNull()).select(u.alias("u"), v.alias("v"))
    return (pts.select(F.floor("u").alias("bx"), F.floor("v").alias("by"),
                       (F.col("u") == F.floor("u")).alias("ex"), (F.col("v") == F.floor("v")).alias("ey"))
            .groupBy("bx", "by", "ex", "ey").agg(F.count(F.lit(1)).alias("n")))


def _point_pyramid(coll, zooms) -> DataFrame:
    """Explode occupied bins (not features) into their tiles at every zoom.

    All points strictly inside a deepest-level bin (and all points on one bin
    edge) share their tiles at every coarser zoom too: a coarser zoom divides
    u by a power of two, which maps an open bin into an open interval holding
    no threshold.  So the bin's representative coordinate, scaled exactly,
    decides its tiles at each zoom.  Sparse data costs one extra partially
    aggregated shuffle; dense or skewed data (a third of all points at one
    place) shrinks to a handful of bins before the explode.
    """
    zmax = max(zooms)
    bins = _point_bins(coll, zmax)
    ru = F.when(F.col("ex"), F.col("bx").cast("double")).otherwise(F.col("bx") + 0.5)
    rv = F.when(F.col("ey"), F.col("by").cast("double")).otherwise(F.col("by") + 0.5)
    b = bins.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    per_tile = F.pow(F.lit(2.0), (F.lit(zmax + 4) - F.col("z")).cast("double"))   # bins per tile side
    n = F.pow(F.lit(2.0), F.col("z").cast("double")).cast("bigint")
    tu, tv = ru / per_tile, rv / per_tile
    xs = _range(tu - 1 - MARGIN, tu + MARGIN, n)
    ys = _range(tv - 1 - MARGIN, tv + MARGIN, n)
    return (b.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))
            .groupBy("z", "x", "y").agg(F.sum("n").alias("n_features")))


def tile_requests(requests: DataFrame, tile_counts: DataFrame) -> DataFrame:
    """TIL-6 batch: request (z, x, y) -> valid flag and feature count (null when valid but empty)."""
    valid = is_valid_tile(F.col("z"), F.col("x"), F.col("y"))
    r = requests.withColumn("valid", valid)
    return r.join(tile_counts, ["z", "x", "y"], "left").withColumn(
        "n_features", F.when(F.col("valid"), F.col("n_features")))
