"""Registered queries of tiles of lines and areas: the descent's pieces, its counts and the decoded bytes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import mvt as MV
from ..operators import quadtree as QT
from ..operators import tiles as TL
from . import tables as T
from .collection import Collection
from .queries import _2H, _H, CBOX, CUST, query
from .queries_imports import part_features, part_values

# Each customer's line leaves its place by a step between -0.3 and 0.3 degrees on each axis; one in 35 has no length.
DX = "(CAST(id % 7 AS DOUBLE) - 3) * 0.1"
DY = "(CAST(id % 5 AS DOUBLE) - 2) * 0.15"


def customer_lines(spark, sf_dir) -> Collection:
    c = T.customers(spark, sf_dir).df
    x, y = F.col("_xmin"), F.col("_ymin")
    ends = [(x, y), (x + F.expr(DX), y + F.expr(DY))]
    line = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ends])
    geom = F.struct(F.lit("LineString").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(line)).alias("parts"))
    df = c.select("id", "c_mktsegment", geom.alias("geom"),
                  *[fn(ends[0][k], ends[1][k]).alias(n) for fn, k, n in (
                      (F.least, 0, "_xmin"), (F.least, 1, "_ymin"), (F.greatest, 0, "_xmax"), (F.greatest, 1, "_ymax"))])
    return Collection(df, name="customer_lines", geometry_type="LineString", workspace="sales")


def _merc(x: str, y: str, z: str) -> tuple[str, str]:
    """Tile units of a longitude and a latitude over the whole world at zoom ``z``, y down."""
    return (f"((6378137.0 * radians({x}) + {_H}) / {_2H} * 4096 * pow(2.0, {z}))",
            f"(({_H} - 6378137.0 * ln(tan(pi() / 4 + radians({y}) / 2))) / {_2H} * 4096 * pow(2.0, {z}))")


def _tiles_of(src: str, zooms) -> str:
    """Every tile whose buffered square the box (u1, v1)..(u2, v2) may meet; src has world units for zoom 0."""
    zs = ", ".join(str(z) for z in zooms)
    return f"""(SELECT f.*, x, y FROM (SELECT s.*, CAST(z AS INTEGER) AS z, pow(2.0, z) AS k FROM {src} s, unnest([{zs}]) t(z)) f,
  LATERAL (SELECT unnest(range(CAST(greatest(floor(least(u1, u2) * k / 4096) - 1, 0) AS BIGINT),
    CAST(least(floor(greatest(u1, u2) * k / 4096) + 1, k - 1) AS BIGINT) + 1)) AS x) tx,
  LATERAL (SELECT unnest(range(CAST(greatest(floor(least(v1, v2) * k / 4096) - 1, 0) AS BIGINT),
    CAST(least(floor(greatest(v1, v2) * k / 4096) + 1, k - 1) AS BIGINT) + 1)) AS y) ty)"""


def _whole(v: str) -> str:
    return f"CAST(floor({v} + 0.5) AS BIGINT)"


# Boxes stay boxes in Mercator, so a clipped one has its corners moved to the buffered tile's sides.
_X1, _Y2 = _merc("xmin", "ymin", "0")
_X2, _Y1 = _merc("xmax", "ymax", "0")
_AREA = f"(SELECT id, {_X1} AS u1, {_Y1} AS v1, {_X2} AS u2, {_Y2} AS v2 FROM {CBOX})"


def _clipped_areas(zooms) -> str:
    def side(v, t):
        return _whole(f"least(greatest({v} * k - 4096 * {t}, -256), 4352)")
    return f"""(SELECT * FROM (SELECT z, x, y, id, {side('u1', 'x')} AS qx1, {side('v1', 'y')} AS qy1,
  {side('u2', 'x')} AS qx2, {side('v2', 'y')} AS qy2 FROM {_tiles_of(_AREA, zooms)}) WHERE qx1 < qx2 AND qy1 < qy2)"""


def _til4_areas(spark, sf_dir):
    t = QT.tile_features(T.customer_areas(spark, sf_dir), [6, 9, 12])

    def end(fn, axis):
        return fn(F.transform(F.col("rings")[0], lambda v: v[axis])).alias(("qx" if axis == "x" else "qy") + ("1" if fn is F.array_min else "2"))
    return t.select("z", "x", "y", "id", F.size(F.col("rings")[0]).cast("bigint").alias("n"),
                    *[end(fn, a) for fn in (F.array_min, F.array_max) for a in ("x", "y")])


query("til3_til4_clipped_areas", f"SELECT z, x, y, id, CAST(4 AS BIGINT) AS n, qx1, qy1, qx2, qy2 FROM {_clipped_areas([6, 9, 12])}")(_til4_areas)

# The part of a segment inside of the buffered tile, by the parameters at which it enters and leaves.
_PX, _PY = _merc("x", "y", "0")
_EX, _EY = _merc(f"(x + {DX})", f"(y + {DY})", "0")
_LINE = f"(SELECT id, {_PX} AS u1, {_PY} AS v1, {_EX} AS u2, {_EY} AS v2 FROM {CUST})"


def _clipped_lines(zooms) -> str:
    def bounds(fn, inside, outside):
        return ", ".join(f"CASE WHEN {d} = 0 THEN CASE WHEN {a} BETWEEN -256 AND 4352 THEN {inside} ELSE {outside} END "
                         f"ELSE {fn}((-256 - {a}) / {d}, (4352 - {a}) / {d}) END" for a, d in (("lx", "dx"), ("ly", "dy")))
    enter, leave = f"greatest(0, {bounds('least', 0, 2)})", f"least(1, {bounds('greatest', 1, -1)})"
    return f"""(SELECT z, x, y, id, qx1, qy1, qx2, qy2 FROM (SELECT *, {_whole('lx + t0 * dx')} AS qx1, {_whole('ly + t0 * dy')} AS qy1,
  {_whole('CASE WHEN t1 = 1 THEN ex ELSE lx + t1 * dx END')} AS qx2, {_whole('CASE WHEN t1 = 1 THEN ey ELSE ly + t1 * dy END')} AS qy2
  FROM (SELECT *, {enter} AS t0, {leave} AS t1 FROM (SELECT *, ex - lx AS dx, ey - ly AS dy FROM (
    SELECT z, x, y, id, u1 * k - 4096 * x AS lx, v1 * k - 4096 * y AS ly, u2 * k - 4096 * x AS ex, v2 * k - 4096 * y AS ey
    FROM {_tiles_of(_LINE, zooms)}))) WHERE t0 <= t1) WHERE qx1 <> qx2 OR qy1 <> qy2)"""


def _til4_lines(spark, sf_dir):
    t = QT.tile_features(customer_lines(spark, sf_dir), [6, 9, 12])
    first, last = F.col("rings")[0][0], F.element_at(F.col("rings")[0], -1)
    return t.select("z", "x", "y", "id", first["x"].alias("qx1"), first["y"].alias("qy1"),
                    last["x"].alias("qx2"), last["y"].alias("qy2"))


query("til3_til4_clipped_lines", f"SELECT * FROM {_clipped_lines([6, 9, 12])}")(_til4_lines)


def _til7_areas(spark, sf_dir):
    return TL.pyramid_counts(T.customer_areas(spark, sf_dir), range(0, 11))


query("til7_area_pyramid", f"SELECT z, x, y, count(*) AS n_features FROM {_clipped_areas(range(0, 11))} GROUP BY z, x, y")(_til7_areas)


# ---------------------------------------------------------------- the bytes
def decoded_shapes(features: bytes, values: bytes, first_value: int) -> tuple[int, int, int, int, int]:
    """Features, vertices, sums of x and y, and number of features with segment BUILDING of a part of a tile."""
    n = points = sx = sy = building = 0
    if not features:
        return n, points, sx, sy, building
    texts = part_values(values)
    v, *at = part_features(features)
    cmds = v.tolist()
    for tag0, tag1, i, end in zip(*[a.tolist() for a in at]):
        n += 1
        building += any(texts[k - first_value] == "BUILDING" for k in cmds[tag0 + 1:tag1:2])
        x = y = 0
        while i < end:
            steps = cmds[i] >> 3 if cmds[i] & 7 != 7 else 0
            i += 1
            for _ in range(steps):
                x += (cmds[i] >> 1) ^ -(cmds[i] & 1)
                y += (cmds[i + 1] >> 1) ^ -(cmds[i + 1] & 1)
                points, sx, sy, i = points + 1, sx + x, sy + y, i + 2
    return n, points, sx, sy, building


def _decoded(make):
    def run(spark, sf_dir):
        import pandas as pd
        coll = replace(make(spark, sf_dir), exposed_fields=[("c_mktsegment", "segment")])
        names = ["n_features", "n_points", "sum_x", "sum_y", "n_building"]

        def read(batches):
            for b in batches:
                rows = pd.DataFrame([decoded_shapes(bytes(f), bytes(v), k) for f, v, k in
                                     zip(b["features"], b["values"], b["first_value"])], columns=names)
                yield pd.concat([b[["z", "x", "y"]].reset_index(drop=True), rows], axis=1)
        parts = MV.tile_parts(coll, range(4, 10)).mapInPandas(
            read, "z int, x bigint, y bigint, " + ", ".join(f"{n} bigint" for n in names))
        return parts.groupBy("z", "x", "y").agg(*[F.sum(n).alias(n) for n in names]).filter("n_features > 0")
    return run


def _decoded_sql(rows: str, points: int, x: str, y: str) -> str:
    return f"""SELECT z, x, y, count(*) AS n_features, CAST(count(*) * {points} AS BIGINT) AS n_points,
  CAST(sum({x}) AS BIGINT) AS sum_x, CAST(sum({y}) AS BIGINT) AS sum_y,
  count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_building
FROM {rows} JOIN customer ON c_custkey = id GROUP BY z, x, y"""


query("til5_area_tiles_decoded", _decoded_sql(_clipped_areas(range(4, 10)), 4, "2 * (qx1 + qx2)", "2 * (qy1 + qy2)"))(_decoded(T.customer_areas))
query("til5_line_tiles_decoded", _decoded_sql(_clipped_lines(range(4, 10)), 2, "qx1 + qx2", "qy1 + qy2"))(_decoded(customer_lines))
