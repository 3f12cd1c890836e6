"""Batch spatial joins (JN-6, JN-7, JN-8, JN-10): many requests in one job.

The single-request operators answer one box / point / radius per call.  The
batch forms join a DataFrame of requests to the features with a *multi-level
grid* equi-join, so Catalyst plans a hash join instead of a nested loop:

1. Each object (feature or request) gets a grid level: the finest level
   ``l`` (cell side ``base * 8**l``) at which its bbox covers at most
   ``MAX_CELLS`` cells.  Nothing is capped or dropped: a huge polygon simply
   lives at a coarser level.
2. A pair (f, r) is matched at level ``m = max(level_f, level_r)``.  Each side
   therefore emits its cells at its own level plus every coarser level used
   by the other side (a tiny set, collected once: at most ``N_LEVELS``
   values).  Point-only sides are level 0 and skip that pass.
3. Equi-join on (level, cx, cy); keep rows whose level is ``m``; refine
   with the exact predicate; keep a pair only in the cell that holds the
   lower-left corner of the two boxes' intersection -- exactly one cell, so
   no ``distinct`` shuffle is needed.

Join strategy:

* one statistics pass per extended side gives its grid levels, its exact
  number of own-level cells and its envelope; the envelope filters the other
  side with a literal bbox predicate that reaches the Parquet scan;
* a side is broadcast only behind a proven bound on its exploded rows (exact
  cell totals for extended sides, ``count()`` for point sides) -- the
  smaller bounded side wins; otherwise both sides are shuffled on the cell
  key in a sort-merge join;
* the streamed side of a broadcast join is dealt over all partitions first
  where its rows meet ``DEAL_PARTNERS`` or more on the mean: its few files
  would otherwise do the work of all pairs in as few tasks;
* hot cells (one cell holding a large share of the features) are split by
  AQE's skew-join handling, and ``salt > 1`` additionally spreads every
  cell's features over ``salt`` buckets while replicating the request rows
  ``salt`` times.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import geometry as G
from ..functions import spatial as K
from . import strips

LEVEL_FACTOR = 8
N_LEVELS = 10
MAX_CELLS = 1024
# Grid rows hold ids, boxes and cell numbers only (about 100 bytes): geometries are attached after the join.
BROADCAST_MAX_ROWS = 500_000     # 50 MB
SMALL_BROADCAST_ROWS = 200_000   # proven this small: broadcast without sizing the other side
DEFAULT_CELL = 0.05            # degrees, when neither side suggests a size
DEAL_PARTNERS = 4              # mean partners of a streamed row from which dealing it first costs less than it saves

_BOX = ("_xmin", "_ymin", "_xmax", "_ymax")
_RBOX = ("__r_xmin", "__r_ymin", "__r_xmax", "__r_ymax")


# ---------------------------------------------------------------- sizing helpers
def bounded_count(df: DataFrame, max_rows: int) -> int | None:
    """Row count if it is at most ``max_rows``, else None.

    A plain ``count()``: one pass whose partial counts leave each task as a
    single row (and a bare Parquet scan is counted from footers).  A
    ``limit(n).count()`` would instead funnel up to n rows per partition
    through one single-partition exchange.
    """
    n = df.count()
    return n if n <= max_rows else None


def suggest_cell(df: DataFrame, box=_BOX, fallback: float = DEFAULT_CELL) -> float:
    """Median box side of one side (approximate percentile, one aggregate row)."""
    side = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1]))
    v = df.select(F.percentile_approx(side, 0.5, 1000).alias("m")).first()["m"]
    return float(v) if v and v > 0 else fallback


# ---------------------------------------------------------------- grid cells
def _cell_size(base: float, level) -> Column:
    return F.lit(float(base)) * F.pow(F.lit(float(LEVEL_FACTOR)), level.cast("double"))


def level_of(box_cols, base: float) -> Column:
    """Finest level whose cell cover of the bbox has at most MAX_CELLS cells."""
    xmin, ymin, xmax, ymax = box_cols
    expr = None
    for lvl in range(N_LEVELS):
        g = float(base) * LEVEL_FACTOR ** lvl
        # counted in double: a huge box at a fine level would overflow a bigint product
        n = ((F.floor(xmax / g) - F.floor(xmin / g) + 1).cast("double")
             * (F.floor(ymax / g) - F.floor(ymin / g) + 1).cast("double"))
        expr = F.when(n <= MAX_CELLS, F.lit(lvl)) if expr is None else expr.when(n <= MAX_CELLS, F.lit(lvl))
    return expr.otherwise(F.lit(N_LEVELS - 1))


def _cells_at(box_cols, base: float, level: Column) -> Column:
    xmin, ymin, xmax, ymax = box_cols
    g = _cell_size(base, level)
    xs = F.sequence(F.floor(xmin / g), F.floor(xmax / g))
    ys = F.sequence(F.floor(ymin / g), F.floor(ymax / g))
    return F.flatten(F.transform(xs, lambda cx: F.transform(
        ys, lambda cy: F.struct(level.alias("lv"), cx.alias("cx"), cy.alias("cy")))))


def explode_cells(df: DataFrame, box_cols, base: float, own_level: Column, extra_levels: list[int],
                  prefix: str) -> DataFrame:
    """One row per covered cell at the object's level and at each coarser level in ``extra_levels``."""
    lv = prefix + "lv"
    df = df.withColumn(lv, own_level)
    cells = _cells_at(box_cols, base, F.col(lv))
    for extra in sorted(set(extra_levels)):
        cells = F.concat(cells, F.when(F.col(lv) < extra, _cells_at(box_cols, base, F.lit(extra)))
                         .otherwise(F.array().cast(cells_type())))
    return (df.withColumn("__cell", F.explode(cells))
            .withColumn("__clv", F.col("__cell.lv")).withColumn("__cx", F.col("__cell.cx"))
            .withColumn("__cy", F.col("__cell.cy")).drop("__cell"))


def explode_point_cells(df: DataFrame, x: Column, y: Column, base: float, levels: list[int], prefix: str) -> DataFrame:
    """Point side: one cell per level in ``levels`` as plain arithmetic (no array lambdas)."""
    lv = prefix + "lv"
    levels = sorted(set(levels)) or [0]
    if len(levels) == 1:
        return df.withColumns({lv: F.lit(0), "__clv": F.lit(levels[0]),
                               "__cx": F.floor(x / _cell_size(base, F.lit(levels[0]))),
                               "__cy": F.floor(y / _cell_size(base, F.lit(levels[0])))})
    cells = F.array(*[F.struct(F.lit(l).alias("lv"), F.floor(x / _cell_size(base, F.lit(l))).alias("cx"),
                               F.floor(y / _cell_size(base, F.lit(l))).alias("cy")) for l in levels])
    return (df.withColumn(lv, F.lit(0)).withColumn("__cell", F.explode(cells))
            .withColumn("__clv", F.col("__cell.lv")).withColumn("__cx", F.col("__cell.cx"))
            .withColumn("__cy", F.col("__cell.cy")).drop("__cell"))


def cells_type() -> str:
    return "array<struct<lv:int,cx:bigint,cy:bigint>>"


def side_stats(df: DataFrame, box_cols, level: Column, base: float, with_envelope: bool = False):
    """Levels used by one side and its total number of own-level cells (one aggregate row);
    with ``with_envelope`` also the side's overall bbox (None when empty)."""
    xmin, ymin, xmax, ymax = box_cols
    g = _cell_size(base, level)
    cells = (F.floor(xmax / g) - F.floor(xmin / g) + 1) * (F.floor(ymax / g) - F.floor(ymin / g) + 1)
    row = df.select(level.alias("__l"), cells.alias("__c"), xmin.alias("__a"), ymin.alias("__b"),
                    xmax.alias("__d"), ymax.alias("__e")).agg(
        F.collect_set("__l").alias("l"), F.sum("__c").alias("c"), F.min("__a").alias("a"), F.min("__b").alias("b"),
        F.max("__d").alias("d"), F.max("__e").alias("e")).first()
    levels, n = sorted(row["l"] or []), int(row["c"] or 0)
    if not with_envelope:
        return levels, n
    env = None if row["a"] is None else (row["a"], row["b"], row["d"], row["e"])
    return levels, n, env


def _exploded_bound(df: DataFrame, own_cells: int | None, other_levels: list[int], max_rows: int) -> int | None:
    """Upper bound of a side's exploded rows, or None when it exceeds ``max_rows``."""
    extra = len([lv for lv in other_levels if lv > 0])
    if own_cells is None:                      # point side: one cell per level
        n = bounded_count(df, max_rows)
        return None if n is None else n * (1 + extra)
    bound = own_cells * (1 + extra)
    return bound if bound <= max_rows else None


def _partners(rows: int, env, base: float) -> float:
    """Mean rows of a cell when ``rows`` grid rows lie in the envelope."""
    if env is None:
        return 0.0
    return rows / ((math.floor(env[2] / base) - math.floor(env[0] / base) + 1)
                   * (math.floor(env[3] / base) - math.floor(env[1] / base) + 1))


def _levels_used(df: DataFrame, level: Column) -> list[int]:
    """Distinct grid levels of one side (at most N_LEVELS values)."""
    row = df.select(F.collect_set(level).alias("l")).first()
    return sorted(row["l"] or [])


# ---------------------------------------------------------------- generic join
def grid_join(features: DataFrame, requests: DataFrame, refine: Callable[[], Column] | None = None, *,
              cell: float | None = None, features_are_points: bool = False,
              requests_are_points: bool = False, salt: int = 1,
              broadcast_max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join two frames whose boxes overlap, then apply the exact ``refine``.

    ``features`` carries ``_xmin.._ymax``; ``requests`` carries the same four
    columns, renamed here to ``__r_xmin..__r_ymax`` (``refine`` may use both
    sets).  Other column names must not collide.  Returns every column of
    both inputs except the internal grid columns.
    """
    req = requests
    for a, b in zip(_BOX, _RBOX):
        req = req.withColumnRenamed(a, b)
    fbox = [F.col(c) for c in _BOX]
    rbox = [F.col(c) for c in _RBOX]
    if cell is None:
        cell = suggest_cell(requests) if not requests_are_points else (
            suggest_cell(features) if not features_are_points else DEFAULT_CELL)
    f_level = F.lit(0) if features_are_points else level_of(fbox, cell)
    r_level = F.lit(0) if requests_are_points else level_of(rbox, cell)
    # one statistics pass per extended side: levels used, own-level cell count (bounded driver data)
    f_levels, f_cells, f_env = ([0], None, None) if features_are_points else side_stats(
        features, fbox, f_level, cell, with_envelope=True)
    r_levels, r_cells, r_env = ([0], None, None) if requests_are_points else side_stats(
        req, rbox, r_level, cell, with_envelope=True)
    # An extended side's envelope (free from its statistics pass) bounds the other side:
    # a literal bbox filter that Parquet statistics prune on, before any explode or shuffle.
    if not requests_are_points:
        features = features.filter(K.bbox_overlaps(*r_env) if r_env else F.lit(False))
    if not features_are_points:
        req = req.filter(K.bbox_overlaps(*f_env, prefix="__r") if f_env else F.lit(False))

    # Broadcast a side only behind a proven bound on its exploded rows: an extended
    # side emits at most its own-level cells again at each coarser level of the
    # other side (bound free from its stats); a point side emits one row per level
    # (bound from a count, skipped when the other side is already proven small).
    bound_r = _exploded_bound(req, r_cells, f_levels, broadcast_max_rows) if r_cells is not None else None
    bound_f = _exploded_bound(features, f_cells, r_levels, broadcast_max_rows) if f_cells is not None else None
    if bound_r is not None:
        bound_r *= salt
    small = SMALL_BROADCAST_ROWS
    if not ((bound_r is not None and bound_r <= small) or (bound_f is not None and bound_f <= small)):
        if r_cells is None:
            bound_r = _exploded_bound(req, None, f_levels, broadcast_max_rows)
            bound_r = None if bound_r is None else bound_r * salt
        if f_cells is None:
            bound_f = _exploded_bound(features, None, r_levels, broadcast_max_rows)
    small_r = bound_r is not None and bound_r <= broadcast_max_rows and (bound_f is None or bound_r <= bound_f)
    small_f = not small_r and bound_f is not None and bound_f <= broadcast_max_rows
    if small_r and _partners(bound_r, r_env or f_env, cell) >= DEAL_PARTNERS:
        features = session.spread(features, *features.columns)
    elif small_f and _partners(bound_f, f_env or r_env, cell) >= DEAL_PARTNERS:
        req = session.spread(req, *req.columns)

    fc = (explode_point_cells(features, fbox[0], fbox[1], cell, [0, *r_levels], "__f") if features_are_points
          else explode_cells(features, fbox, cell, f_level, r_levels, "__f"))
    rc = (explode_point_cells(req, rbox[0], rbox[1], cell, [0, *f_levels], "__r") if requests_are_points
          else explode_cells(req, rbox, cell, r_level, f_levels, "__r"))
    fc = fc.withColumnRenamed("__clv", "__f_clv").withColumnRenamed("__cx", "__f_cx").withColumnRenamed("__cy", "__f_cy")

    keys = [F.col("__f_clv") == F.col("__clv"), F.col("__f_cx") == F.col("__cx"), F.col("__f_cy") == F.col("__cy")]
    if salt > 1:
        fc = fc.withColumn("__f_salt", F.pmod(F.xxhash64(*[F.col(c) for c in features.columns[:1]]), F.lit(salt)))
        rc = rc.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys.append(F.col("__f_salt") == F.col("__salt"))
    if small_r:
        rc = F.broadcast(rc)
    elif small_f:
        fc = F.broadcast(fc)
    else:
        # neither side is provably small: a shuffled sort-merge join on the cell key,
        # whose hot partitions AQE splits (spark.sql.adaptive.skewJoin.enabled)
        rc = rc.hint("merge")

    joined = fc.join(rc, keys, "inner")
    m = F.greatest(F.col("__flv"), F.col("__rlv"))
    g = _cell_size(cell, m)
    own_x = F.floor(F.greatest(F.col("_xmin"), F.col("__r_xmin")) / g)
    own_y = F.floor(F.greatest(F.col("_ymin"), F.col("__r_ymin")) / g)
    cond = ((F.col("__clv") == m) & K.boxes_overlap(fbox, rbox)
            & (F.col("__cx") == own_x) & (F.col("__cy") == own_y))
    if refine is not None:
        cond = cond & refine()
    grid_cols = {"__flv", "__f_clv", "__f_cx", "__f_cy", "__f_salt", "__clv", "__cx", "__cy", "__rlv", "__salt"}
    internal = [c for c in joined.columns if c in grid_cols]
    return joined.filter(cond).drop(*internal)


# ---------------------------------------------------------------- JN-6
def batch_bbox(coll, requests: DataFrame, req_id: str = "req_id", cell: float | None = None,
               **kw) -> DataFrame:
    """JN-6: requests(req_id, _xmin, _ymin, _xmax, _ymax) x features -> (req_id, id) whose envelopes overlap."""
    feats = coll.df.select(F.col(coll.id_column).alias("id"), *_BOX)
    out = grid_join(feats, requests.select(req_id, *_BOX), None, cell=cell,
                    features_are_points=coll.geometry_type == "Point", **kw)
    return out.select(req_id, "id")


# ---------------------------------------------------------------- JN-7
GEOMETRY_BROADCAST_BYTES = 64 << 20


def attach_geometry(pairs: DataFrame, geoms: DataFrame, key: str, geom_col: str, deal: bool = False) -> DataFrame:
    """Add ``geom_col`` of ``geoms`` to candidate pairs by ``key``.

    The grid rows carry no geometry, so a polygon is not copied into each of
    its cells.  The table is broadcast only when its vertices (16 bytes each)
    and rows are proven to stay below ``GEOMETRY_BROADCAST_BYTES``; otherwise
    the pairs are shuffled on the key (AQE splits hot ones).  ``deal``: pairs
    for a test that costs far more than a shuffled row are dealt over all
    partitions before a broadcast join.
    """
    vertices = F.size(F.flatten(F.flatten(F.col(geom_col)["parts"])))
    size = geoms.agg(F.sum(F.coalesce(vertices, F.lit(0)) * 16 + 64).alias("b")).first()["b"] or 0
    if size > GEOMETRY_BROADCAST_BYTES:
        return pairs.join(geoms.hint("merge"), key)
    return (session.spread(pairs, *pairs.columns) if deal else pairs).join(F.broadcast(geoms), key)


def batch_point_lookup(coll, points: DataFrame, point_id: str = "pid", x: str = "x", y: str = "y",
                       op: str = "s_intersects", cell: float | None = None, **kw) -> DataFrame:
    """JN-7: probe points x (multi)polygon features -> (pid, id) of the feature(s) containing each point.

    ``op``: ``s_intersects`` (boundary counts, SPA-3) or ``s_contains``
    (feature contains the point: interior only, SPA-7).  The grid gives
    candidate pairs; each is tested against the original edges at the point's
    height (:mod:`.strips`), so the answer depends neither on the cell size nor
    on the polygon's size, and the feature id keeps its type.
    """
    feats = coll.df.select(F.col(coll.id_column).alias("id"), *_BOX, strips.layout(F.col(coll.geometry_column)).alias("__at"))
    geoms = coll.df.select(F.col(coll.id_column).alias("id"), F.col(coll.geometry_column).alias("__geom"))
    probes = points.select(point_id, F.col(x).alias("__px"), F.col(y).alias("__py"),
                           F.col(x).alias("_xmin"), F.col(y).alias("_ymin"),
                           F.col(x).alias("_xmax"), F.col(y).alias("_ymax"))
    pairs = grid_join(feats, probes, None, cell=cell or suggest_cell(feats), requests_are_points=True, **kw)
    pairs = pairs.select(point_id, "id", "__px", "__py", "__at")
    return strips.point_hits(pairs, geoms, "id", "__geom", op).select(point_id, "id")


# ---------------------------------------------------------------- JN-8
def batch_radius(coll, probes: DataFrame, probe_id: str = "pid", lon: str = "lon", lat: str = "lat",
                 radius: str = "radius_m", cell: float | None = None, **kw) -> DataFrame:
    """JN-8: probes(pid, lon, lat, radius_m) x features (4326) -> (pid, id, distance_m) within the radius.

    Points: haversine; MultiPoints: the nearest vertex (Catalyst ``aggregate``);
    lines and polygons: true minimum distance over their segments (D1),
    evaluated only on grid candidates.
    """
    bx = K.radius_box_columns(F.col(lon), F.col(lat), F.col(radius))
    req = probes.select(probe_id, F.col(lon).alias("__plon"), F.col(lat).alias("__plat"),
                        F.col(radius).alias("__prad"),
                        bx[0].alias("_xmin"), bx[1].alias("_ymin"), bx[2].alias("_xmax"), bx[3].alias("_ymax"))
    if coll.geometry_type == "Point":
        feats = coll.df.select(F.col(coll.id_column).alias("id"), *_BOX)
        dist = K.haversine_m(F.col("_xmin"), F.col("_ymin"), F.col("__plon"), F.col("__plat"))
        out = grid_join(feats, req, lambda: dist <= F.col("__prad"), cell=cell, features_are_points=True, **kw)
        return out.select(probe_id, "id", dist.alias("distance_m"))
    feats = coll.df.select(F.col(coll.id_column).alias("id"), *_BOX)
    geoms = coll.df.select(F.col(coll.id_column).alias("id"), F.col(coll.geometry_column).alias("__fgeom"))
    if coll.geometry_type == "MultiPoint":
        vs = F.flatten(F.flatten(F.col("__fgeom")["parts"]))
        dist = F.array_min(F.transform(vs, lambda v: K.haversine_m(v["x"], v["y"], F.col("__plon"), F.col("__plat"))))
    else:
        from .relate import distance_to_point_column
        dist = distance_to_point_column(F.col("__fgeom"), F.col("__plon"), F.col("__plat"))
    pairs = grid_join(feats, req, None, cell=cell, **kw).select(probe_id, "id", "__plon", "__plat", "__prad")
    # exploded, not filtered: a filter would be moved below the projection and the distance worked out twice
    near = F.explode(F.filter(F.array(dist), lambda d: d <= F.col("__prad")))
    return attach_geometry(pairs, geoms, "id", "__fgeom").select(probe_id, "id", near.alias("distance_m"))


# ---------------------------------------------------------------- JN-10
def batch_predicate(coll, geoms: DataFrame, op: str, geom_id: str = "gid", geom_col: str = "geom",
                    cell: float | None = None, **kw) -> DataFrame:
    """JN-10: a table of literal geometries x features under one S_* predicate -> (gid, id).

    Point features against (multi)polygon request geometries run as Catalyst
    expressions; any other pairing to the exact relations of ``relate``.
    ``s_disjoint`` would be (almost) all pairs, so it is answered as a count
    per request geometry instead of pairs (see :func:`batch_disjoint_counts`).
    """
    op = op.lower()
    if op == "s_disjoint":
        raise ValueError("use batch_disjoint_counts for s_disjoint")
    from ..functions.geometry import bbox_columns
    bb = bbox_columns(F.col(geom_col))
    req = geoms.select(geom_id, F.col(geom_col).alias("__rgeom"), *[bb[c].alias(c) for c in _BOX])
    from .relate import contains_box_column, plain_part, relate_pair_column
    if coll.geometry_type == "Point":
        # polygon requests: ray casting as Catalyst expressions; other request kinds: exact relations
        is_poly = F.col("__rgeom")["type"].isin("Polygon", "MultiPolygon")
        feats = coll.df.select(F.col(coll.id_column).alias("id"), *_BOX)
        parts = []
        polys_req = req.filter(is_poly)
        if op in ("s_intersects", "s_within", "s_touches") and not polys_req.isEmpty():
            # contains / crosses / overlaps / equals never hold between a point and an area
            asked = polys_req.withColumn("__at", strips.layout(F.col("__rgeom"))).drop("__rgeom")
            pairs = grid_join(feats, asked, None, cell=cell, features_are_points=True, **kw)
            pairs = pairs.select(geom_id, "id", F.col("_xmin").alias("__px"), F.col("_ymin").alias("__py"), "__at")
            parts.append(strips.point_hits(pairs, polys_req.select(geom_id, "__rgeom"), geom_id, "__rgeom", op))
        if not req.filter(~is_poly).isEmpty():
            others = req.filter(~is_poly)
            pairs = grid_join(feats, others.drop("__rgeom"), None, cell=cell, features_are_points=True, **kw)
            pairs = attach_geometry(pairs.select(geom_id, "id", G.point(F.col("_xmin"), F.col("_ymin")).alias("__fgeom")),
                                    others.select(geom_id, "__rgeom"), geom_id, "__rgeom")
            parts.append(pairs.filter(relate_pair_column(op, "__fgeom", "__rgeom")))
        if not parts:
            schema = geoms.select(geom_id).schema.add("id", coll.df.schema[coll.id_column].dataType)
            return geoms.sparkSession.createDataFrame([], schema)
        out = parts[0].select(geom_id, "id")
        for extra in parts[1:]:
            out = out.unionByName(extra.select(geom_id, "id"))
        return out
    feats = coll.df.select(F.col(coll.id_column).alias("id"), *_BOX)
    geoms_f = coll.df.select(F.col(coll.id_column).alias("id"), F.col(coll.geometry_column).alias("__fgeom"))
    # what holds a geometry holds its box: the other pairs need no geometry
    holds = (F.col("_xmin") <= F.col("__r_xmin")) & (F.col("_ymin") <= F.col("__r_ymin")) & (
        F.col("_xmax") >= F.col("__r_xmax")) & (F.col("_ymax") >= F.col("__r_ymax"))
    if op == "s_contains" and cell is None:
        cell = suggest_cell(feats)              # the larger boxes: the smaller ones meet few cells of any size
    pairs = grid_join(feats, req.drop("__rgeom"), (lambda: holds) if op == "s_contains" else None, cell=cell,
                      **kw).select(geom_id, "id")
    pairs = attach_geometry(pairs, geoms_f, "id", "__fgeom", deal=True)
    related = relate_pair_column(op, "__fgeom", "__rgeom")
    if op != "s_contains":
        pairs = attach_geometry(pairs, req.select(geom_id, "__rgeom"), geom_id, "__rgeom")
        return pairs.filter(related).select(geom_id, "id")
    # most pairs are decided by the asked geometry's box; the relation is worked out where an edge can meet it
    boxes = [F.col(c).alias(f"__r{c}") for c in _BOX]
    pairs = attach_geometry(pairs, req.select(geom_id, "__rgeom", *boxes, plain_part(F.col("__rgeom")).alias("__plain")),
                            geom_id, "__rgeom")
    decided = F.when(F.col("__plain"), contains_box_column(F.col("__fgeom"), *[F.col(c) for c in _RBOX]))
    return pairs.filter(F.coalesce(decided, related)).select(geom_id, "id")


def batch_disjoint_counts(coll, geoms: DataFrame, geom_id: str = "gid", geom_col: str = "geom", **kw) -> DataFrame:
    """S_DISJOINT in batch form: per request geometry, the number of disjoint features
    (= non-null features minus intersecting ones), without emitting all pairs."""
    total = coll.df.filter(F.col(coll.geometry_column).isNotNull()).count()     # one scalar
    hits = batch_predicate(coll, geoms, "s_intersects", geom_id, geom_col, **kw).groupBy(geom_id).agg(
        F.count(F.lit(1)).alias("__hits"))
    return (geoms.select(geom_id).join(hits, geom_id, "left").withColumn("__n", F.lit(total).cast("bigint"))
            .select(geom_id, (F.col("__n") - F.coalesce(F.col("__hits"), F.lit(0))).alias("n_disjoint")))
