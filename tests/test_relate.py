"""Hand-checked DE-9IM outcomes of the relate kernel (untested in the reference)."""

import pytest

from geoplane.functions.geometry import Geom
from tests.relate_kernel import Shape, min_distance_m, relate


def S(wkt):
    g = Geom.from_wkt(wkt)
    return Shape(g.type, [[list(r) for r in p] for p in g.parts])


def box(x1, y1, x2, y2):
    return S(f"POLYGON(({x1} {y1},{x2} {y1},{x2} {y2},{x1} {y2},{x1} {y1}))")


CASES = [
    # a, b, op, expected
    (box(0, 0, 2, 2), box(1, 1, 3, 3), "s_overlaps", True),
    (box(0, 0, 2, 2), box(1, 1, 3, 3), "s_touches", False),
    (box(0, 0, 2, 2), box(1, 1, 3, 3), "s_within", False),
    (box(0, 0, 1, 1), box(1, 0, 2, 1), "s_touches", True),
    (box(0, 0, 1, 1), box(1, 0, 2, 1), "s_overlaps", False),
    (box(0, 0, 1, 1), box(1, 1, 2, 2), "s_touches", True),
    (box(0, 0, 1, 1), box(1.5, 0, 2, 1), "s_disjoint", True),
    (box(0, 0, 4, 4), box(1, 1, 2, 2), "s_contains", True),
    (box(1, 1, 2, 2), box(0, 0, 4, 4), "s_within", True),
    (box(0, 0, 4, 4), box(0, 0, 2, 2), "s_contains", True),
    (box(0, 0, 2, 2), S("POLYGON((2 0,2 2,0 2,0 0,2 0))"), "s_equals", True),
    (S("LINESTRING(-1 0.5,3 0.5)"), box(0, 0, 2, 2), "s_crosses", True),
    (box(0, 0, 2, 2), S("LINESTRING(-1 0.5,3 0.5)"), "s_crosses", True),
    (S("LINESTRING(0.5 0.5,1.5 1.5)"), box(0, 0, 2, 2), "s_within", True),
    (S("LINESTRING(0 0,2 0)"), box(0, 0, 2, 2), "s_touches", True),
    (S("LINESTRING(0 0,2 0)"), box(0, 0, 2, 2), "s_within", False),
    (S("LINESTRING(0 0,2 2)"), S("LINESTRING(0 2,2 0)"), "s_crosses", True),
    (S("LINESTRING(0 0,2 0)"), S("LINESTRING(1 0,3 0)"), "s_overlaps", True),
    (S("LINESTRING(0 0,2 0)"), S("LINESTRING(1 0,3 0)"), "s_crosses", False),
    (S("LINESTRING(0 0,1 0)"), S("LINESTRING(1 0,2 0)"), "s_touches", True),
    (S("LINESTRING(0 0,1 1)"), S("LINESTRING(1 1,0 0)"), "s_equals", True),
    (S("LINESTRING(0 0,2 0)"), S("LINESTRING(0 0,1 0,2 0)"), "s_equals", True),
    (S("MULTIPOINT((0.5 0.5),(3 3))"), box(0, 0, 2, 2), "s_crosses", True),
    (S("MULTIPOINT((0.5 0.5),(1 1))"), box(0, 0, 2, 2), "s_within", True),
    (S("MULTIPOINT((0 0),(3 3))"), S("MULTIPOINT((0 0),(4 4))"), "s_overlaps", True),
    (S("POINT(2 1)"), box(0, 0, 2, 2), "s_touches", True),
    (box(0, 0, 2, 2), S("POINT(1 1)"), "s_contains", True),
    (S("POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"), box(4.5, 4.5, 5.5, 5.5), "s_disjoint", True),
    (S("POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"), box(4.5, 4.5, 5.5, 5.5), "s_contains", False),
    (S("POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"), box(1, 1, 2, 2), "s_contains", True),
    (S("POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"), box(3, 3, 5, 5), "s_overlaps", True),
    (S("POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"), box(4, 4, 6, 6), "s_touches", True),
]


@pytest.mark.parametrize("a,b,op,want", CASES)
def test_relate_cases(a, b, op, want):
    assert relate(a, b, op) is want


def test_symmetry_within_contains():
    pairs = [(box(0, 0, 4, 4), box(1, 1, 2, 2)), (box(0, 0, 2, 2), box(1, 1, 3, 3)),
             (S("LINESTRING(0.5 0.5,1.5 1.5)"), box(0, 0, 2, 2))]
    for a, b in pairs:
        assert relate(a, b, "s_within") == relate(b, a, "s_contains")
        assert relate(a, b, "s_disjoint") == (not relate(a, b, "s_intersects"))


def test_distance():
    line = S("LINESTRING(2 48, 3 48)")
    d = min_distance_m(line, 2.5, 48.01)
    assert 1100 < d < 1125
    assert min_distance_m(box(2, 48, 3, 49), 2.5, 48.5) == 0.0


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

coord = st.integers(-6, 6).map(float)


@st.composite
def shapes(draw):
    kind = draw(st.sampled_from(["box", "line", "point"]))
    if kind == "box":
        x1, x2 = sorted(draw(st.lists(coord, min_size=2, max_size=2, unique=True)))
        y1, y2 = sorted(draw(st.lists(coord, min_size=2, max_size=2, unique=True)))
        return box(x1, y1, x2, y2)
    if kind == "line":
        a = (draw(coord), draw(coord))
        b = draw(st.tuples(coord, coord).filter(lambda p: p != a))
        return S(f"LINESTRING({a[0]} {a[1]},{b[0]} {b[1]})")
    return S(f"POINT({draw(coord)} {draw(coord)})")


@settings(max_examples=300, deadline=None)
@given(shapes(), shapes())
def test_relate_symmetries(a, b):
    assert relate(a, b, "s_within") == relate(b, a, "s_contains")
    assert relate(a, b, "s_disjoint") == (not relate(a, b, "s_intersects"))
    assert relate(a, b, "s_intersects") == relate(b, a, "s_intersects")
    assert relate(a, b, "s_touches") == relate(b, a, "s_touches")
    assert relate(a, b, "s_overlaps") == relate(b, a, "s_overlaps")
    assert relate(a, b, "s_equals") == relate(b, a, "s_equals")
    if relate(a, b, "s_within"):
        assert relate(a, b, "s_intersects") and not relate(a, b, "s_touches")
    if relate(a, b, "s_equals"):
        assert relate(a, b, "s_within") and relate(a, b, "s_contains")


@st.composite
def boxes(draw):
    x1, x2 = sorted(draw(st.lists(coord, min_size=2, max_size=2, unique=True)))
    y1, y2 = sorted(draw(st.lists(coord, min_size=2, max_size=2, unique=True)))
    return (x1, y1, x2, y2)


@settings(max_examples=400, deadline=None)
@given(boxes(), boxes())
def test_box_predicates_closed_form(a, b):
    sa, sb = box(*a), box(*b)
    inter = a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]
    int_int = a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]
    within = a[0] >= b[0] and a[2] <= b[2] and a[1] >= b[1] and a[3] <= b[3]
    contains = b[0] >= a[0] and b[2] <= a[2] and b[1] >= a[1] and b[3] <= a[3]
    assert relate(sa, sb, "s_intersects") == inter
    assert relate(sa, sb, "s_touches") == (inter and not int_int)
    assert relate(sa, sb, "s_within") == within
    assert relate(sa, sb, "s_contains") == contains
    assert relate(sa, sb, "s_equals") == (a == b)
    assert relate(sa, sb, "s_overlaps") == (int_int and not within and not contains)
    assert relate(sa, sb, "s_crosses") is False


@settings(max_examples=300, deadline=None)
@given(st.lists(coord, min_size=2, max_size=2, unique=True), st.lists(coord, min_size=2, max_size=2, unique=True),
       st.booleans())
def test_collinear_segments_closed_form(ia, ib, diagonal):
    (a1, a2), (b1, b2) = sorted(ia), sorted(ib)

    def seg(u, v):
        return S(f"LINESTRING({u} {u if diagonal else 0},{v} {v if diagonal else 0})")
    sa, sb = seg(a1, a2), seg(b1, b2)
    inter = a1 <= b2 and a2 >= b1
    int_int = a1 < b2 and a2 > b1
    within = b1 <= a1 and a2 <= b2
    contains = a1 <= b1 and b2 <= a2
    assert relate(sa, sb, "s_intersects") == inter
    assert relate(sa, sb, "s_touches") == (inter and not int_int)
    assert relate(sa, sb, "s_within") == within
    assert relate(sa, sb, "s_equals") == (a1 == b1 and a2 == b2)
    assert relate(sa, sb, "s_overlaps") == (int_int and not within and not contains)
    assert relate(sa, sb, "s_crosses") is False


def _orient(p, q, r):
    v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (v > 0) - (v < 0)


@settings(max_examples=300, deadline=None)
@given(st.tuples(coord, coord), st.tuples(coord, coord), st.tuples(coord, coord), st.tuples(coord, coord))
def test_segment_crossing_orientation(p1, p2, q1, q2):
    if p1 == p2 or q1 == q2:
        return
    a = S(f"LINESTRING({p1[0]} {p1[1]},{p2[0]} {p2[1]})")
    b = S(f"LINESTRING({q1[0]} {q1[1]},{q2[0]} {q2[1]})")
    o1, o2, o3, o4 = _orient(p1, p2, q1), _orient(p1, p2, q2), _orient(q1, q2, p1), _orient(q1, q2, p2)
    proper = o1 * o2 < 0 and o3 * o4 < 0              # interiors meet in one point
    assert relate(a, b, "s_crosses") == proper
    if proper:
        assert relate(a, b, "s_intersects") and not relate(a, b, "s_touches")


@settings(max_examples=400, deadline=None)
@given(st.lists(coord, min_size=2, max_size=2, unique=True), coord, boxes())
def test_horizontal_segment_vs_box_closed_form(xs, c, b):
    x1, x2 = sorted(xs)
    line = S(f"LINESTRING({x1} {c},{x2} {c})")
    bx1, by1, bx2, by2 = b
    inter = by1 <= c <= by2 and x1 <= bx2 and x2 >= bx1
    ii = by1 < c < by2 and x1 < bx2 and x2 > bx1
    within = by1 <= c <= by2 and bx1 <= x1 and x2 <= bx2 and ii
    shp = box(*b)
    assert relate(line, shp, "s_intersects") == inter
    assert relate(line, shp, "s_touches") == (inter and not ii)
    assert relate(line, shp, "s_within") == within
    assert relate(line, shp, "s_crosses") == (ii and (x1 < bx1 or x2 > bx2))
    assert relate(shp, line, "s_contains") == within
    assert relate(line, shp, "s_overlaps") is False and relate(line, shp, "s_equals") is False


def test_thin_and_metric_areas_that_share_an_edge():
    """Sides are told apart at any size: boxes from 1e-9 degrees to kilometres, and rotated ones."""
    import math

    from tests.relate_kernel import Shape, relate

    def box(x, y, w, h, turn=0.0):
        pts = [(0, 0), (w, 0), (w, h), (0, h), (0, 0)]
        c, s = math.cos(turn), math.sin(turn)
        return Shape("Polygon", [[[(x + a * c - b * s, y + a * s + b * c) for a, b in pts]]])

    for x, y, w in ((2.0, 48.0, 1e-6), (2.0, 48.0, 1e-9), (260000.0, 6250000.0, 3.0), (-5.0, 41.0, 2.0)):
        left, right, both = box(x, y, w, w), box(x + w, y, w, w), box(x, y, 2 * w, w)
        assert relate(left, both, "s_within") and not relate(left, both, "s_overlaps")
        assert relate(both, left, "s_contains") and not relate(left, both, "s_touches")
        shifted = box(x + w / 2, y, w, w)
        assert relate(left, shifted, "s_overlaps") and not relate(left, shifted, "s_touches")
        if x + w == left.rings[0][1][0]:
            assert relate(left, right, "s_touches") and not relate(left, right, "s_overlaps")


def test_holes_and_parts_that_share_edges():
    from tests.relate_kernel import Shape, relate
    ring = lambda x1, y1, x2, y2: [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    holed = Shape("Polygon", [[ring(0, 0, 10, 10), ring(4, 4, 6, 6)]])
    plug = Shape("Polygon", [[ring(4, 4, 6, 6)]])
    assert relate(plug, holed, "s_touches") and not relate(plug, holed, "s_within")
    assert relate(Shape("Polygon", [[ring(1, 1, 3, 3)]]), holed, "s_within")
    two = Shape("MultiPolygon", [[ring(20, 0, 21, 1)], [ring(0, 0, 1, 1)]])
    assert relate(two, Shape("Polygon", [[ring(0, 0, 1, 1)]]), "s_contains")
    assert relate(Shape("MultiPolygon", [[ring(50, 50, 51, 51)], [ring(1, 1, 2, 2)]]), holed, "s_overlaps")
