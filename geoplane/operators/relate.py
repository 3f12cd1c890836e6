"""Exact spatial relations for lines and polygons (SPA-5..12 on extended
features, JN-10, SPA-4 and JN-8 on lines and areas), as Spark expressions.

No point is ever constructed.  Everything follows from the sign of the cross
product of input vertices, which is exact: a floating filter decides nearly all
cases, and the rest sums the six products as an expansion of doubles.

Method for two valid geometries: a pair of segments that cross properly decides
its cells at once.  Every other meeting point is an input vertex of one of the
two.  At such a contact both geometries are corners (a vertex with its
neighbours, or a segment passing through), and each direction of one is inside,
along or outside the corners of the other.  Each stretch of boundary between two
contacts has its relation at its ends; a ring or line without any contact has
that of its first vertex.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as SF

from ..functions import spatial as K
from ..functions import sqltext as F
from ..functions.geometry import Geom
from ..functions.sqltext import Sql, let

XY = tuple[Sql, Sql]
# part: number of the polygon a ring belongs to
CORNER = "struct<x:double,y:double,px:double,py:double,nx:double,ny:double,part:int>"
EDGE = "struct<x1:double,y1:double,x2:double,y2:double,part:int>"
POINT = "struct<x:double,y:double>"
SHAPE = (f"struct<dim:int,corners:array<{CORNER}>,edges:array<{EDGE}>,reps:array<{POINT}>,"
         "xmin:double,ymin:double,xmax:double,ymax:double>")

# The error bound of the cross product's floating filter, (3 + 16 e) e with
# e = 2^-53, and the factor 2^27 + 1 that splits a double in two halves of 26 bits.
FILTER, SPLIT = 3.3306690738754716e-16, 134217729.0


def any_of(array: Sql, test: Callable[[Sql], Sql]) -> Sql:
    return F.coalesce(F.exists(array, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))


def keep(array: Sql, test: Callable[[Sql], Sql]) -> Sql:
    return F.filter(array, lambda v: F.coalesce(test(v), F.lit(False)))


# ================================================================ orientation
def _two_product(t: Sql) -> Sql:
    """A product of doubles and its rounding error."""
    p, u, v = t["u"] * t["v"], t["u"], t["v"]
    uh, vh = SPLIT * u - (SPLIT * u - u), SPLIT * v - (SPLIT * v - v)
    ul, vl = u - uh, v - vh
    return F.array(p, ul * vl - (((p - uh * vh) - ul * vh) - uh * vl))


def _grow(expansion: Sql, term: Sql) -> Sql:
    """An expansion (parts that do not overlap, by size) plus one double, exactly."""
    def step(acc: Sql, e: Sql) -> Sql:
        q = acc["q"]
        s = q + e
        lost = (q - (s - (s - q))) + (e - (s - q))
        return F.struct(s.alias("q"), F.concat(acc["h"], F.array(lost)).alias("h"))

    start = F.struct(term.alias("q"), F.array().cast("array<double>").alias("h"))
    return F.aggregate(expansion, start, step, lambda acc: F.concat(acc["h"], F.array(acc["q"])))


def _exact_sign(a: XY, b: XY, c: XY) -> Sql:
    pairs = F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in (
        (a[0], b[1]), (-a[0], c[1]), (-c[0], b[1]), (-a[1], b[0]), (a[1], c[0]), (c[1], b[0]))])
    terms = F.flatten(F.transform(pairs, _two_product))
    total = F.aggregate(terms, F.array().cast("array<double>"), _grow)
    return F.aggregate(total, F.lit(0.0), lambda sign, e: F.when(e != 0, F.signum(e)).otherwise(sign))


def orient(a: XY, b: XY, c: XY) -> Sql:
    """1.0, 0.0 or -1.0: c left of, on, or right of the line from a to b; exact for all finite doubles."""
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    flat = (((ax == cx) | (by == cy)) & ((ay == cy) | (bx == cx))) | ((ax == bx) & (ay == by))
    products = F.struct(((ax - cx) * (by - cy)).alias("l"), ((ay - cy) * (bx - cx)).alias("r"))
    return let(products, lambda p: F.when(F.abs(p["l"] - p["r"]) > FILTER * (F.abs(p["l"]) + F.abs(p["r"])),
                                          F.signum(p["l"] - p["r"])).when(flat, 0.0).otherwise(_exact_sign(a, b, c)))


def orients(triples: list[tuple[XY, XY, XY]]) -> Sql:
    """The signs of several triples as an array (one instance of the expression for all)."""
    rows = F.array(*[F.struct(*[v.alias(n) for v, n in zip([x for p in t for x in p], ("ax", "ay", "bx", "by", "cx", "cy"),
                                                          strict=True)]) for t in triples])
    return F.transform(rows, lambda t: orient((t["ax"], t["ay"]), (t["bx"], t["by"]), (t["cx"], t["cy"])))


def _p(v: Sql) -> XY:
    return v["x"], v["y"]


def _ends(e: Sql) -> tuple[XY, XY]:
    return (e["x1"], e["y1"]), (e["x2"], e["y2"])


def _same(a: XY, b: XY) -> Sql:
    return (a[0] == b[0]) & (a[1] == b[1])


def _in_box(p: XY, e: Sql) -> Sql:
    return ((p[0] >= F.least(e["x1"], e["x2"])) & (p[0] <= F.greatest(e["x1"], e["x2"]))
            & (p[1] >= F.least(e["y1"], e["y2"])) & (p[1] <= F.greatest(e["y1"], e["y2"])))


def on_edge(p: XY, e: Sql) -> Sql:
    """p on the closed segment e."""
    return _in_box(p, e) & (orient(*_ends(e), p) == 0)


def proper_crossing(e: Sql, f: Sql) -> Sql:
    """The open segments meet in one point that is no end of either."""
    boxes = ((F.least(e["x1"], e["x2"]) <= F.greatest(f["x1"], f["x2"]))
             & (F.greatest(e["x1"], e["x2"]) >= F.least(f["x1"], f["x2"]))
             & (F.least(e["y1"], e["y2"]) <= F.greatest(f["y1"], f["y2"]))
             & (F.greatest(e["y1"], e["y2"]) >= F.least(f["y1"], f["y2"])))
    (e1, e2), (f1, f2) = _ends(e), _ends(f)
    return boxes & let(orients([(e1, e2, f1), (e1, e2, f2), (f1, f2, e1), (f1, f2, e2)]),
                       lambda o: (o[0] * o[1] < 0) & (o[2] * o[3] < 0))


def inside_rings(p: XY, edges: Sql) -> Sql:
    """Even-odd test of a point that is on no edge."""
    crossed = keep(edges, lambda e: ((e["y1"] > p[1]) != (e["y2"] > p[1])) & (
        orient(*_ends(e), p) == F.when(e["y2"] > e["y1"], 1.0).otherwise(-1.0)))
    return F.size(crossed) % 2 == 1


# ================================================================ shapes
def _dimension(geom_type: Sql) -> Sql:
    return F.when(F.endswith(geom_type, "Point"), 0).when(F.contains(geom_type, "Line"), 1).otherwise(2)


def _ring(ring: Sql, hole: Sql, part: Sql, dim: Sql) -> Sql:
    """Corners, edges and first vertex of one ring or line; an area lies left of its edges."""
    n = F.size(ring)
    at = (lambda i: F.get(ring, i))
    closed = (n > 2) & _same(_p(at(F.lit(0))), _p(at(n - 1)))
    least = F.array_min(F.transform(ring, lambda v, i: F.struct(v["x"], v["y"], i.alias("i"))))["i"]

    def neighbours(f: Sql) -> Sql:
        """The neighbours of every vertex in the ring's own direction; the last vertex of a closed one is its first."""
        m = f["m"]
        return F.transform(F.slice(ring, 1, m), lambda v, i: F.struct(
            v["x"], v["y"], F.when(f["closed"] | (i > 0), at((i + m - 1) % m)).otherwise(None).alias("p"),
            F.when(f["closed"] | (i < m - 1), at((i + 1) % m)).otherwise(None).alias("n")))

    def body(own: Sql) -> Sql:
        def build(flip: Sql) -> Sql:
            corners = F.transform(own, lambda v: F.struct(
                v["x"], v["y"], *[F.when(flip, v[o][c]).otherwise(v[s][c]).alias(s + c)
                                  for s, o in (("p", "n"), ("n", "p")) for c in ("x", "y")], part.alias("part")))
            # from each vertex to its next one, turned where the area lies right of it
            lines = F.transform(keep(own, lambda v: v["n"].isNotNull()), lambda v: F.struct(
                *[F.when(flip, v["n"][c]).otherwise(v[c]).alias(c + "1") for c in ("x", "y")],
                *[F.when(flip, v[c]).otherwise(v["n"][c]).alias(c + "2") for c in ("x", "y")], part.alias("part")))
            return F.struct(corners.alias("corners"), lines.alias("edges"), F.struct(own[0]["x"], own[0]["y"]).alias("rep"))

        turn = let(F.get(own, least), lambda v: F.when((dim == 2) & v["p"].isNotNull(), orient(_p(v["p"]), _p(v), _p(v["n"]))))
        return let(let(turn, lambda t: F.coalesce(F.when(hole, t > 0).otherwise(t < 0), False)), build)

    return let(let(F.struct(closed.alias("closed"), F.when(closed, n - 1).otherwise(n).alias("m")), neighbours), body)


def shape(geom: Sql) -> Sql:
    """A geometry column as corners, edges, one vertex of each ring, and its box (null for null)."""
    return F.when(geom["type"].isNotNull() & geom["parts"].isNotNull(),
                  let(_dimension(geom["type"]), lambda dim: _shape(geom, dim))).cast(SHAPE)


def _shape(geom: Sql, dim: Sql) -> Sql:
    def plain(ring: Sql) -> Sql:                # no vertex twice in a row
        return F.filter(ring, lambda v, i: F.coalesce((i == 0) | ~_same(_p(v), _p(F.get(ring, i - 1))), False))

    least = F.when(dim == 0, 1).when(dim == 1, 2).otherwise(4)
    rings = F.flatten(F.transform(geom["parts"], lambda part, k: F.transform(
        part, lambda r, i: F.struct(plain(r).alias("v"), (i > 0).alias("hole"), k.alias("part")))))
    parts = F.transform(keep(rings, lambda r: F.size(r["v"]) >= least),
                        lambda r: let(r["v"], lambda v: _ring(v, r["hole"], r["part"], dim)))

    def whole(own: Sql) -> Sql:
        corners = F.flatten(F.transform(own, lambda r: r["corners"]))
        xs, ys = F.transform(corners, lambda v: v["x"]), F.transform(corners, lambda v: v["y"])
        return F.struct(dim.alias("dim"), corners.alias("corners"),
                        F.flatten(F.transform(own, lambda r: r["edges"])).alias("edges"),
                        F.transform(own, lambda r: r["rep"]).alias("reps"),
                        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))

    return let(parts, whole)


def literal_shape(g: Geom) -> Sql:
    """A literal geometry in the same form, as a constant."""
    corners, edges, reps = [], [], []
    for n, part in enumerate(g.parts):
        for k, ring in enumerate(part):
            v = [p for i, p in enumerate(ring) if i == 0 or tuple(p) != tuple(ring[i - 1])]
            if len(v) < (1, 2, 4)[g.dimension]:
                continue
            closed = len(v) > 2 and tuple(v[0]) == tuple(v[-1])
            own = v[:-1] if closed else v
            m = len(own)
            if g.dimension == 2 and (_turn(own) > 0) == (k > 0):
                own = own[::-1]
            at = (lambda i, own=own, m=m, closed=closed: own[i % m] if closed or 0 <= i < m else (None, None))
            corners += [(*own[i], *at(i - 1), *at(i + 1), n) for i in range(m)]
            edges += [(*own[i], *at(i + 1), n) for i in range(m) if at(i + 1)[0] is not None]
            reps.append(own[0])

    def rows(values, names, kind):
        return F.array(*[F.struct(*[F.lit(None if x is None else float(x)).cast("double").alias(n)
                                    for x, n in zip(row, names, strict=True)]) for row in values]).cast(f"array<{kind}>")

    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    box = (min(xs), min(ys), max(xs), max(ys)) if corners else (math.nan,) * 4
    return F.struct(F.lit(g.dimension).alias("dim"), rows(corners, ("x", "y", "px", "py", "nx", "ny", "part"), CORNER).alias("corners"),
                    rows(edges, ("x1", "y1", "x2", "y2", "part"), EDGE).alias("edges"), rows(reps, ("x", "y"), POINT).alias("reps"),
                    *[F.lit(float(b)).alias(n) for b, n in zip(box, ("xmin", "ymin", "xmax", "ymax"), strict=True)]).cast(SHAPE)


def _turn(ring) -> int:
    """1 for a counter-clockwise ring, by its corner at the least vertex."""
    i = min(range(len(ring)), key=lambda k: tuple(ring[k]))
    (ax, ay), (bx, by), (cx, cy) = (tuple(map(Fraction, ring[k % len(ring)])) for k in (i - 1, i, i + 1))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


# ================================================================ contacts
INSIDE, SAME, OTHER, OUTSIDE = 1, 2, 3, 0
IN_WEDGE, NEXT, PREVIOUS, APART = 1, 2, 3, 0


def _seen_from(p: XY, c: Sql, d: XY, dim: Sql) -> Sql:
    """A direction from p against one corner: in its wedge (area left of previous - p - next), or along an arm."""
    a, b = (c["nx"], c["ny"]), (c["px"], c["py"])

    def same_way(u: XY) -> Sql:
        return (F.signum(u[0] - p[0]) == F.signum(d[0] - p[0])) & (F.signum(u[1] - p[1]) == F.signum(d[1] - p[1]))

    def code(o: Sql) -> Sql:
        turn, after_next, before_previous = o[0], o[1], o[2]
        wedge = F.when(turn > 0, (after_next > 0) & (before_previous > 0)).when(
            turn < 0, (after_next > 0) | (before_previous > 0)).otherwise(after_next > 0)
        return F.when((after_next == 0) & same_way(a), NEXT).when((before_previous == 0) & same_way(b), PREVIOUS).when(
            (dim == 2) & wedge, IN_WEDGE).otherwise(APART)

    # a corner of a line may lack an arm: its signs are null, and no branch holds
    return let(orients([(a, b, p), (a, d, p), (d, b, p)]), code)


def _directions(corners: Sql) -> Sql:
    """Neighbours of the corners; ``ahead`` tells next from previous, so the area's side."""
    both = F.flatten(F.transform(corners, lambda c: F.array(
        F.struct(c["nx"].alias("x"), c["ny"].alias("y"), F.lit(True).alias("ahead")),
        F.struct(c["px"].alias("x"), c["py"].alias("y"), F.lit(False).alias("ahead")))))
    return keep(both, lambda d: d["x"].isNotNull())


def _relations(p: XY, directions: Sql, corners: Sql, dim: Sql) -> Sql:
    """For each direction: inside, along an equal side, along the other side, or outside of the other geometry."""
    def one(d: Sql) -> Sql:
        equal, other = F.when(d["ahead"], NEXT).otherwise(PREVIOUS), F.when(d["ahead"], PREVIOUS).otherwise(NEXT)
        codes = F.transform(corners, lambda c: F.struct(_seen_from(p, c, _p(d), dim).alias("code"), c["part"].alias("part")))

        def verdict(seen: Sql) -> Sql:
            has = (lambda kind: any_of(seen, lambda c: c["code"] == kind))
            # a polygon's interior at p is what all of its rings there have on their left
            part = (lambda own: (own["code"] == IN_WEDGE) & ~any_of(
                seen, lambda c: (c["part"] == own["part"]) & (c["code"] != IN_WEDGE)))
            return F.when(has(equal), SAME).when(has(other), F.when(dim < 2, SAME).otherwise(OTHER)).when(
                (dim == 2) & any_of(seen, part), INSIDE).otherwise(OUTSIDE)

        return let(codes, verdict)
    return F.transform(directions, one)


def _corners_at(p: XY, corners: Sql, edges: Sql) -> Sql:
    """The corners of a geometry at p: its vertices there and the segments that pass through."""
    passing = keep(edges, lambda e: on_edge(p, e) & ~_same(p, _ends(e)[0]) & ~_same(p, _ends(e)[1]))
    through = F.transform(passing, lambda e: F.struct(
        p[0].alias("x"), p[1].alias("y"), e["x1"].alias("px"), e["y1"].alias("py"), e["x2"].alias("nx"), e["y2"].alias("ny"), e["part"]))
    return F.concat(keep(corners, lambda c: _same(_p(c), p)), through)


def _open_ends(corners: Sql) -> Sql:
    return F.aggregate(corners, F.lit(0), lambda n, c: n + c["px"].isNull().cast("int") + c["nx"].isNull().cast("int"))


def _contact(p: XY, pair: Sql, dims: Sql) -> Sql:
    """The cells that one contact proves: II, II along a line, IE, EI.  ``pair``: the corners of both geometries there."""
    def cells(r: Sql) -> Sql:
        has = (lambda side, kind: F.array_contains(r[side], kind))
        areas, lines = (dims[0] == 2) & (dims[1] == 2), (dims[0] == 1) & (dims[1] == 1)
        inner = [(dims[i] == 0) | ((dims[i] == 1) & (_open_ends(pair[i]) % 2 == 0)) for i in (0, 1)]
        ii = F.when(areas, has(0, INSIDE) | has(0, SAME) | has(1, INSIDE)).when(dims[1] == 2, has(0, INSIDE)) \
            .when(dims[0] == 2, has(1, INSIDE)).otherwise((inner[0] & inner[1]) | (lines & has(0, SAME)))
        ie = has(0, OUTSIDE) | (areas & (has(0, OTHER) | has(1, INSIDE)))
        ei = has(1, OUTSIDE) | (areas & (has(1, OTHER) | has(0, INSIDE)))
        return F.struct(ii.alias("ii"), (lines & has(0, SAME)).alias("ii1"), ie.alias("ie"), ei.alias("ei"))

    both = F.array(F.struct(pair[0].alias("own"), pair[1].alias("other"), dims[1].alias("dim")),
                   F.struct(pair[1].alias("own"), pair[0].alias("other"), dims[0].alias("dim")))
    return let(F.transform(both, lambda s: _relations(p, _directions(s["own"]), s["other"], s["dim"])), cells)


def _near(array: Sql, box: Sql, vertex: bool) -> Sql:
    """The corners or edges that can meet the box."""
    def test(v: Sql) -> Sql:
        x1, y1, x2, y2 = (v["x"], v["y"]) * 2 if vertex else (v["x1"], v["y1"], v["x2"], v["y2"])
        return ((F.least(x1, x2) <= box["xmax"]) & (F.greatest(x1, x2) >= box["xmin"])
                & (F.least(y1, y2) <= box["ymax"]) & (F.greatest(y1, y2) >= box["ymin"]))
    return keep(array, test)


def _side(own: Sql, other: Sql) -> Sql:
    """One geometry beside the other: all of it, and the part that can meet the other's box."""
    return F.struct(own["dim"].alias("dim"), own["reps"].alias("reps"), _near(own["corners"], other, True).alias("c"),
                    _near(own["edges"], other, False).alias("e"), other["dim"].alias("odim"), other["edges"].alias("oedges"),
                    _near(other["corners"], own, True).alias("oc"), _near(other["edges"], own, False).alias("oe"))


def _touching(s: Sql) -> Sql:
    """The vertices of one geometry that lie on the other."""
    met = keep(s["c"], lambda v: any_of(s["oe"], lambda e: on_edge(_p(v), e)) | (
        (s["odim"] == 0) & any_of(s["oc"], lambda q: _same(_p(v), _p(q)))))
    return F.transform(met, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))


def _free(s: Sql, contacts: Sql) -> Sql:
    """For each ring without contact at its first vertex: whether that lies inside the other."""
    free = keep(s["reps"], lambda r: ~any_of(contacts, lambda p: _same(_p(p), _p(r))))
    return F.transform(free, lambda r: (s["odim"] == 2) & inside_rings(_p(r), s["oedges"]))


def _cells(sides: Sql) -> Sql:
    """inter, II, II along a line, IE and EI of two shapes, given as the pair of their sides."""
    a, b = sides[0], sides[1]
    dims = F.array(a["dim"], b["dim"])
    crossing = any_of(a["e"], lambda e: any_of(b["e"], lambda f: proper_crossing(e, f)))

    def from_contacts(points: Sql) -> Sql:
        proofs = F.transform(points, lambda p: let(F.transform(sides, lambda s: _corners_at(_p(p), s["c"], s["e"])),
                                                   lambda pair: _contact(_p(p), pair, dims)))
        found = F.struct(proofs.alias("p"), F.transform(sides, lambda s: _free(s, points)).alias("free"),
                         crossing.alias("x"), (F.size(points) > 0).alias("met"))
        return let(found, total)

    def total(r: Sql) -> Sql:
        proof = (lambda name: any_of(r["p"], lambda p: p[name]))
        in_b, out_b = F.array_contains(r["free"][0], True), F.array_contains(r["free"][0], False)
        in_a, out_a = F.array_contains(r["free"][1], True), F.array_contains(r["free"][1], False)
        full = (F.size(a["reps"]) > 0) & (F.size(b["reps"]) > 0)
        return F.struct((r["x"] | r["met"] | in_a | in_b).alias("inter"), (r["x"] | proof("ii") | in_a | in_b).alias("ii"),
                        proof("ii1").alias("ii1"),
                        (full & ((a["dim"] > b["dim"]) | r["x"] | proof("ie") | in_a | out_b)).alias("ie"),
                        (full & ((b["dim"] > a["dim"]) | r["x"] | proof("ei") | in_b | out_a)).alias("ei"))

    return let(F.array_distinct(F.flatten(F.transform(sides, _touching))), from_contacts)


def cells(a: Sql, b: Sql) -> Sql:
    """``dim_a, dim_b, inter, ii, ii1, ie, ei`` of two shapes; null where one is null."""
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, let(F.array(_side(a, b), _side(b, a)), lambda sides: let(_cells(sides), lambda c: F.struct(
        sides[0]["dim"].alias("dim_a"), sides[1]["dim"].alias("dim_b"), *[c[n].alias(n) for n in ("inter", "ii", "ii1", "ie", "ei")]))))


def holds(c: Sql, op: str) -> Sql:
    """The relation ``op`` by the cells of two geometries."""
    da, db = c["dim_a"], c["dim_b"]
    return {
        "s_intersects": c["inter"], "s_disjoint": ~c["inter"], "s_within": c["ii"] & ~c["ie"],
        "s_contains": c["ii"] & ~c["ei"], "s_equals": c["ii"] & ~c["ie"] & ~c["ei"], "s_touches": c["inter"] & ~c["ii"],
        "s_crosses": F.when((da == 1) & (db == 1), c["ii"] & ~c["ii1"]).when(da < db, c["ii"] & c["ie"])
        .when(da > db, c["ii"] & c["ei"]).when(da.isNotNull(), False),
        "s_overlaps": (da == db) & c["ii"] & c["ie"] & c["ei"] & ((da != 1) | c["ii1"]),
    }[op]


def relation(a: Sql, b: Sql, op: str) -> Sql:
    """``op(a, b)`` of two shapes; null where one is null."""
    return let(cells(a, b), lambda c: holds(c, op))


# ================================================================ entry points
# Nested expressions are resolved level by level; the analyzer's default of 100 rounds is too few.
ROUNDS = 1000


def _deep() -> None:
    spark = SparkSession.getActiveSession()
    for name in ("spark.sql.analyzer.maxIterations", "spark.sql.optimizer.maxIterations"):
        if spark is not None and int(spark.conf.get(name, "100")) < ROUNDS:
            spark.conf.set(name, str(ROUNDS))


def relate_column(coll, op: str, g: Geom) -> Column:
    """``op(feature, literal)`` for every row; the literal is one constant."""
    _deep()
    pair = F.struct(shape(F.col(coll.geometry_column)).alias("a"), literal_shape(g).alias("b"))
    return let(pair, lambda p: relation(p["a"], p["b"], op)).column()


def relate_pair_column(op: str, a: str, b: str) -> Column:
    """``op(a, b)`` for two geometry columns, given by name (batch predicate join refine)."""
    _deep()
    pair = F.struct(shape(F.col(a)).alias("a"), shape(F.col(b)).alias("b"))
    return let(pair, lambda p: relation(p["a"], p["b"], op)).column()


def plain_part(geom: Column) -> Column:
    """One point, one line of some length, or one ring of three corners at least: a geometry that is not empty."""
    rings = SF.flatten(geom["parts"])
    distinct = SF.size(SF.array_distinct(SF.get(rings, SF.lit(0))))
    least = SF.when(geom["type"].endswith("Polygon"), 3).when(geom["type"].endswith("Point"), 1).otherwise(2)
    return SF.coalesce((SF.size(rings) == 1) & (distinct >= least), SF.lit(False))


def contains_box_column(geom: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether an area holds a box that none of its edges can meet; null where an edge can, or for other geometries.

    Such a box lies on one side as a whole, and so does all that it bounds.  Edges that cross the height of its
    lower left corner are left or right of it by their own boxes: the even-odd count needs no orientation.
    """
    def code(ring: Column, v: Column, i: Column) -> Column:
        n = SF.get(ring, i + 1)
        x1, y1, x2, y2 = v["x"], v["y"], n["x"], n["y"]
        beside = ((x1 < xmin) & (x2 < xmin)) | ((y1 < ymin) & (y2 < ymin)) | ((y1 > ymax) & (y2 > ymax))
        return (SF.when(beside | n.isNull(), 0)
                .when((x1 > xmax) & (x2 > xmax), ((y1 > ymin) != (y2 > ymin)).cast("int")).otherwise(2))

    rings = SF.flatten(geom["parts"])
    closed = SF.forall(rings, lambda r: (SF.size(r) > 3) & (SF.get(r, SF.lit(0)) == SF.element_at(r, -1)))
    # in an array of one, so that the edges are looked at once
    codes = SF.array(SF.flatten(SF.transform(rings, lambda r: SF.transform(r, lambda v, i: code(r, v, i)))))
    odd = SF.get(SF.transform(codes, lambda c: SF.when(~SF.array_contains(c, 2), SF.size(SF.filter(c, lambda e: e == 1)) % 2 == 1)), SF.lit(0))
    return SF.when(geom["type"].endswith("Polygon") & closed, odd)


def distance_to_point_column(geom: Column, lon: Column, lat: Column) -> Column:
    """Metres from a 4326 geometry to a lon/lat point, in a local equirectangular projection (D1).

    The least over vertices and segments in closed form; 0 inside an area.
    """
    r = math.radians(1.0) * K.EARTH_RADIUS_M
    kx = SF.cos(SF.radians(lat)) * r
    parts = geom["parts"]
    # vertices in metres around the point
    rings = SF.transform(SF.flatten(parts), lambda ring: SF.transform(
        ring, lambda v: SF.struct(((v["x"] - lon) * kx).alias("x"), ((v["y"] - lat) * r).alias("y"))))

    def to_segment(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = SF.greatest(SF.lit(0.0), SF.least(SF.lit(1.0), -(a["x"] * dx + a["y"] * dy) / (dx * dx + dy * dy)))
        # a segment without length has no t: its vertex counts alone
        return SF.hypot(a["x"] + t * dx, a["y"] + t * dy)

    vertices = SF.transform(SF.flatten(rings), lambda v: SF.hypot(v["x"], v["y"]))
    segments = SF.when(~geom["type"].endswith("Point"), SF.flatten(SF.transform(rings, lambda ring: SF.transform(
        K.segment_indexes(ring), lambda i: to_segment(SF.get(ring, i), SF.get(ring, i + 1))))))
    least = SF.array_min(SF.concat(vertices, SF.coalesce(segments, SF.array().cast("array<double>"))))
    covered = geom["type"].endswith("Polygon") & (K.pip_inside(parts, lon, lat) | K.on_boundary(parts, lon, lat))
    return SF.when(covered, 0.0).otherwise(least)


def within_distance(coll, point: Geom, radius_m: float) -> Column:
    """SPA-4 on lines / polygons: true minimum distance <= radius (deviation D1)."""
    lon, lat = point.vertices[0]
    col = SF.col(coll.geometry_column)
    if coll.srid != 4326:
        from ..functions.geometry import transform_geom
        col = transform_geom(col, coll.srid, 4326)
    return distance_to_point_column(col, SF.lit(float(lon)), SF.lit(float(lat))) <= SF.lit(float(radius_m))
