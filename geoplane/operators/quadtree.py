"""Vector tiles of lines and areas by descending the tile quadtree (TIL-3, TIL-4, TIL-7).

A feature starts in the tile of zoom 0.  Each round clips what is left of it to
the four child tiles and passes on only the children that keep something, so a
long diagonal line reaches the tiles it crosses and never the bounding box's
tiles.  A round is one ``explode`` over an array of at most four clipped
children: no join, no group, no Python.  Coordinates are tile units; going down
doubles them and subtracts a multiple of 4096, both exact in floating point, so
only the cut points are rounded.

Scale: rounds are narrow.  For more than ``spread`` levels the features are dealt
over all partitions first, however few files hold them; after every ``spread``
levels the rows are hashed by (feature, tile), so a feature that covers the
world is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions.geometry import transform_geom
from . import tiles as TL

LO, HI = float(-TL.BUFFER), float(TL.EXTENT + TL.BUFFER)
SPREAD = 8
RING = "struct<hole:boolean,k:int,p:array<struct<x:double,y:double>>>"
TILE = f"struct<z:int,x:bigint,y:bigint,g:array<{RING}>>"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


# ---------------------------------------------------------------- clipping, as SQL text
# One entry a side of the buffered tile: horizontal axis, sign, offset (signed distance = sign * v + offset), bound.
_SIDES = "array(" + ", ".join(
    f"named_struct('h', {h}, 'm', {m}, 'c', {c}, 'b', {b})"
    for h in ("true", "false") for m, c, b in (("1D", f"{-LO}D", f"{LO}D"), ("-1D", f"{HI}D", f"{HI}D"))) + ")"


def _ring_clip(pts: str, sides: str) -> str:
    """A ring without its closing vertex, cut by ``sides`` one after the other."""
    def dist(v):
        return f"(s.m * if(s.h, {v}.x, {v}.y) + s.c)"

    cut = ("if(s.h, named_struct('x', s.b, 'y', v0.y + (s.b - v0.x) / (v.x - v0.x) * (v.y - v0.y)), "
           "named_struct('x', v0.x + (s.b - v0.y) / (v.y - v0.y) * (v.x - v0.x), 'y', s.b))")
    kept = (f"CASE WHEN {dist('v')} >= 0 THEN if({dist('v0')} >= 0, array(v), array({cut}, v)) "
            f"WHEN {dist('v0')} >= 0 THEN array({cut}) ELSE slice(array(v), 1, 0) END")
    before = "concat(slice(acc, -1, 1), slice(acc, 1, size(acc) - 1))"
    return (f"aggregate({sides}, {pts}, (acc, s) -> "
            f"if(size(acc) = 0, acc, flatten(zip_with(acc, {before}, (v, v0) -> {kept}))))")


def _line_clip(pts: str) -> str:
    """The pieces of a line inside the buffered tile: each segment's parameter range, then runs of joined segments."""
    def enter(axis):
        a, b = f"e.a.{axis}", f"e.b.{axis}"
        return (f"if({a} = {b}, if({a} BETWEEN {LO}D AND {HI}D, 0D, 2D), "
                f"least(({LO}D - {a}) / ({b} - {a}), ({HI}D - {a}) / ({b} - {a})))")

    def leave(axis):
        a, b = f"e.a.{axis}", f"e.b.{axis}"
        return (f"if({a} = {b}, if({a} BETWEEN {LO}D AND {HI}D, 1D, -1D), "
                f"greatest(({LO}D - {a}) / ({b} - {a}), ({HI}D - {a}) / ({b} - {a})))")

    def at(t):
        return f"named_struct('x', e.a.x + {t} * (e.b.x - e.a.x), 'y', e.a.y + {t} * (e.b.y - e.a.y))"

    segments = f"zip_with(slice({pts}, 1, size({pts}) - 1), slice({pts}, 2, size({pts}) - 1), (a, b) -> named_struct('a', a, 'b', b))"
    ranged = (f"transform({segments}, e -> named_struct('a', e.a, 'b', e.b, 't0', greatest(0D, {enter('x')}, {enter('y')}), "
              f"'t1', least(1D, {leave('x')}, {leave('y')})))")
    cut = (f"transform({ranged}, e -> named_struct('a', if(e.t0 > 0, {at('e.t0')}, e.a), 'b', if(e.t1 < 1, {at('e.t1')}, e.b), "
           "'ok', e.t0 <= e.t1, 'in', e.t0 > 0, 'out', e.t1 < 1))")
    joined = "(get(c, {0}).ok AND get(c, {1}).ok AND NOT get(c, {0}).out AND NOT get(c, {1}).in)"
    index = "transform(c, (k, i) -> i)"
    starts = f"filter({index}, i -> get(c, i).ok AND NOT (i > 0 AND {joined.format('i - 1', 'i')}))"
    ends = f"filter({index}, i -> get(c, i).ok AND NOT (i < size(c) - 1 AND {joined.format('i', 'i + 1')}))"
    pieces = (f"zip_with({starts}, {ends}, (s, e) -> named_struct('hole', false, 'k', 0, 'p', "
              "concat(array(get(c, s).a), transform(slice(c, s + 1, e - s + 1), k -> k.b))))")
    return _let("c", cut, pieces)


def _crossed(scale: int, cx: str, cy: str) -> str:
    """The sides that the box ``b`` goes over; a cut by any other changes no ring."""
    def nearest(axis, c):
        return f"if(s.m > 0, {scale} * b.{axis}1, -({scale} * b.{axis}2)) - s.m * 4096 * {c} + s.c < 0"
    return f"filter({_SIDES}, s -> if(s.h, {nearest('x', cx)}, {nearest('y', cy)}))"


def _clip(rings: str, areas: bool, sides: str) -> str:
    if not areas:
        return f"flatten(transform({rings}, r -> {_line_clip('r.p')}))"
    following = "concat(slice(r.p, 2, size(r.p)), slice(r.p, 1, 1))"
    on_side = " OR ".join(f"(u.{a} = v.{a} AND u.{a} IN ({LO}D, {HI}D))" for a in "xy")
    border = f"forall(zip_with(r.p, {following}, (u, v) -> {on_side}), e -> e)"
    area2 = f"aggregate(zip_with(r.p, {following}, (u, v) -> u.x * v.y - v.x * u.y), 0D, (a, c) -> a + c)"
    cut = f"transform({rings}, r -> named_struct('hole', r.hole, 'k', r.k, 'p', {_ring_clip('r.p', 'sides')}))"
    # a ring along the border alone holds the whole square (1) or nothing of it (-1), here and in every deeper tile
    marked = (f"transform(filter({cut}, r -> size(r.p) >= 3), r -> named_struct('r', r, 's', "
              f"CASE WHEN NOT {border} THEN 0 WHEN abs({area2}) > {(HI - LO) ** 2}D THEN 1 ELSE -1 END))")
    return _let("sides", sides, _let("c", marked, "transform(filter(c, m -> m.s >= 0 AND NOT exists(c, o -> o.s = 1 AND o.r.hole AND o.r.k = m.r.k)), "
                             "m -> m.r)"))


def _into(t: str, scale: int, cx: str, cy: str, areas: bool) -> str:
    """The geometry of tile ``t`` in the units of its child (cx, cy), clipped unless it lies wholly inside."""
    moved = (f"transform({t}.g, r -> named_struct('hole', r.hole, 'k', r.k, 'p', transform(r.p, v -> "
             f"named_struct('x', {scale} * v.x - 4096 * {cx}, 'y', {scale} * v.y - 4096 * {cy}))))")
    inside = " AND ".join(f"{scale} * b.{a}1 - 4096 * {c} >= {LO}D AND {scale} * b.{a}2 - 4096 * {c} <= {HI}D"
                          for a, c in (("x", cx), ("y", cy)))
    meets = " AND ".join(f"{scale} * b.{a}1 - 4096 * {c} <= {HI}D AND {scale} * b.{a}2 - 4096 * {c} >= {LO}D"
                         for a, c in (("x", cx), ("y", cy)))
    none = f"slice({t}.g, 1, 0)"
    return f"CASE WHEN {inside} THEN {moved} WHEN {meets} THEN {_let('m', moved, _clip('m', areas, _crossed(scale, cx, cy)))} ELSE {none} END"


def _box(t: str) -> str:
    def end(fn, a):
        return f"{fn}(transform({t}.g, r -> {fn}(transform(r.p, v -> v.{a}))))"
    return (f"named_struct('x1', {end('array_min', 'x')}, 'x2', {end('array_max', 'x')}, "
            f"'y1', {end('array_min', 'y')}, 'y2', {end('array_max', 'y')})")


def _children(t: str, areas: bool) -> str:
    corners = "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for y in (0, 1) for x in (0, 1)) + ")"
    child = (f"named_struct('z', {t}.z + 1, 'x', 2 * {t}.x + q.x, 'y', 2 * {t}.y + q.y, "
             f"'g', {_into(t, 2, 'q.x', 'q.y', areas)})")
    return _let("b", _box(t), f"filter(transform({corners}, q -> CAST({child} AS {TILE})), k -> size(k.g) > 0)")


# ---------------------------------------------------------------- the descent
def descend(coll, zooms, keep: list[str] | None = None, spread: int = SPREAD) -> DataFrame:
    """TIL-3: (keep columns, z, x, y, g) for every tile whose buffered square meets a line or an area.

    ``g``: what is left of the geometry in tile units, y down: rings without
    their closing vertex, or the pieces of lines.  Null and empty geometries
    have no rows; a polygon whose hole holds a whole square is not in it.
    """
    wanted = sorted({int(z) for z in zooms})
    keep = list(keep or [coll.id_column])
    areas = coll.geometry_type.endswith("Polygon")
    if not wanted:
        return coll.df.select(*keep, F.expr(f"CAST(NULL AS {TILE})").alias("__t")).limit(0).select(*keep, "__t.*")
    if wanted[0] < 0 or wanted[-1] > TL.MAX_ZOOM:
        raise ValueError(f"zoom levels lie between 0 and {TL.MAX_ZOOM}")
    merc = transform_geom(F.col("__f"), coll.srid, 3857)
    world = 2 * TL.H

    def ring(pts, i, part):
        pts = F.transform(pts, lambda v: F.struct(((v["x"] + TL.H) / world * TL.EXTENT).alias("x"),
                                                  ((TL.H - v["y"]) / world * TL.EXTENT).alias("y")))
        if areas:
            closed = (F.size(pts) > 1) & (F.get(pts, F.lit(0)) == F.get(pts, F.size(pts) - 1))
            pts = F.when(closed, F.slice(pts, F.lit(1), F.size(pts) - 1)).otherwise(pts)
        return F.struct((F.lit(areas) & (i > 0)).alias("hole"), part.cast("int").alias("k"), pts.alias("p"))

    rings = F.filter(F.flatten(F.transform("__m", lambda part, j: F.transform(part, lambda pts, i: ring(pts, i, j)))), lambda r: F.size(r["p"]) > 0)
    df = coll.df.select(*keep, F.col(coll.geometry_column).alias("__f"))
    if wanted[-1] > spread:
        df = session.spread(df, keep[0], "__f")
    df = df.select(*keep, merc["parts"].alias("__m")).filter(F.size("__m") > 0)
    df = df.select(*keep, F.struct(F.lit(0).alias("z"), F.lit(0).cast("bigint").alias("x"),
                                   F.lit(0).cast("bigint").alias("y"), rings.alias("g")).cast(TILE).alias("__w"))
    root = f"CAST(named_struct('z', 0, 'x', 0, 'y', 0, 'g', {_into('__w', 1, '0', '0', areas)}) AS {TILE})"
    df = df.filter("size(__w.g) > 0").select(
        *keep, F.explode(F.expr("filter(" + _let("b", _box("__w"), f"array({root})") + ", k -> size(k.g) > 0)")).alias("__t"))
    for z in range(1, wanted[-1] + 1):
        if z > spread and (z - 1) % spread == 0:
            df = session.spread(df, keep[0], F.col("__t.z"), F.col("__t.x"), F.col("__t.y"))
        down = _children("__t", areas)
        grown = f"concat(array(__t), {down})" if z - 1 in wanted else down
        df = df.select(*keep, F.explode(F.expr(f"if(__t.z = {z - 1}, {grown}, array(__t))")).alias("__t"))
    return df.select(*keep, "__t.z", "__t.x", "__t.y", "__t.g")


def quantized(g: Column, areas: bool) -> Column:
    """TIL-4: integer tile coordinates, repeated vertices dropped; rings without area and single points go.

    Exterior rings run with positive area (y down), holes with negative.
    """
    def whole(r):
        return F.transform(r["p"], lambda v: F.struct(F.floor(v["x"] + 0.5).cast("bigint").alias("x"),
                                                      F.floor(v["y"] + 0.5).cast("bigint").alias("y")))

    def bind(value, body):
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def distinct(r):
        return bind(whole(r), lambda q: F.filter(q, lambda v, i: (i == 0) | (F.get(q, i - 1) != v)))

    if not areas:
        return F.filter(F.transform(g, distinct), lambda q: F.size(q) > 1)

    def opened(q):
        again = (F.size(q) > 1) & (F.get(q, F.lit(0)) == F.get(q, F.size(q) - 1))
        return F.when(again, F.slice(q, F.lit(1), F.size(q) - 1)).otherwise(q)

    def area2(q):
        following = F.concat(F.slice(q, 2, F.size(q)), F.slice(q, 1, 1))
        return F.aggregate(F.zip_with(q, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]),
                           F.lit(0).cast("bigint"), lambda s, v: s + v)

    def ring(r):
        return bind(bind(distinct(r), opened), lambda q: F.struct(r["hole"].alias("hole"), q.alias("q"), area2(q).alias("a")))

    rings = F.filter(F.transform(g, ring), lambda r: (F.size(r["q"]) > 2) & (r["a"] != 0))
    return F.transform(rings, lambda r: F.when(r["hole"] == (r["a"] > 0), F.reverse(r["q"])).otherwise(r["q"]))


def tile_features(coll, zooms, keep: list[str] | None = None, spread: int = SPREAD) -> DataFrame:
    """TIL-3 + TIL-4: (keep columns, z, x, y, rings) with integer coordinates, only features that keep something."""
    keep = list(keep or [coll.id_column])
    areas = coll.geometry_type.endswith("Polygon")
    d = descend(coll, zooms, keep, spread)
    d = d.select(*keep, "z", "x", "y", F.array(quantized(F.col("g"), areas)).alias("__a"))
    return d.select(*keep, "z", "x", "y", F.explode(F.filter("__a", lambda r: F.size(r) > 0)).alias("rings"))
