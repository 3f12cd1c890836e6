"""DE-9IM by brute force over fractions: what the relations of the library are tested against.

Every segment is split at all its intersections with the other geometry's
segments, and each piece is classified by its midpoint, all in exact
arithmetic.
"""

import math
from fractions import Fraction

from geoplane.functions.spatial import EARTH_RADIUS_M


def _exact(v):
    return Fraction(float(v[0])), Fraction(float(v[1]))


# ================================================================ geometry access
class Shape:
    """Points, polylines and polygon rings of one geometry."""

    __slots__ = ("dim", "points", "lines", "rings", "polys")

    def __init__(self, gtype: str, parts):
        self.points, self.lines, self.rings, self.polys = [], [], [], []
        if gtype in ("Point", "MultiPoint"):
            self.dim = 0
            self.points = [_exact(r[0]) for p in parts for r in p if len(r)]
        elif gtype in ("LineString", "MultiLineString"):
            self.dim = 1
            self.lines = [[_exact(v) for v in r] for p in parts for r in p if len(r) >= 2]
        else:
            self.dim = 2
            for p in parts:
                rings = [[_exact(v) for v in r] for r in p if len(r) >= 4]
                if rings:
                    self.polys.append(rings)
                    self.rings.extend(rings)

    def segments(self):
        for ln in self.lines:
            yield from zip(ln, ln[1:])
        for r in self.rings:
            yield from zip(r, r[1:])

    def line_boundary(self):
        counts = {}
        for ln in self.lines:
            if ln[0] != ln[-1]:
                for p in (ln[0], ln[-1]):
                    counts[p] = counts.get(p, 0) + 1
        return {p for p, n in counts.items() if n % 2 == 1}

    # -------------------------------------------------------- point location: 'I', 'B', 'E'
    def locate(self, p) -> str:
        if self.dim == 0:
            return "I" if p in self.points else "E"
        if self.dim == 1:
            for a, b in self.segments():
                if _on_segment(p, a, b):
                    return "B" if p in self.line_boundary() else "I"
            return "E"
        for a, b in self.segments():
            if _on_segment(p, a, b):
                return "B"
        inside = False
        for poly in self.polys:
            if _ring_parity(p, poly):
                inside = not inside
        return "I" if inside else "E"


def _ring_parity(p, rings) -> bool:
    x, y = p
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _on_segment(p, a, b) -> bool:
    return (_cross(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0])
            and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]))


def _split_params(a, b, other: Shape) -> list[float]:
    """Parameters t in [0, 1] where segment ab meets the other's segments (or its points)."""
    ts = {Fraction(0), Fraction(1)}
    dx, dy = b[0] - a[0], b[1] - a[1]
    denom_len = dx * dx + dy * dy
    if denom_len == 0:
        return [Fraction(0), Fraction(1)]
    for c, d in other.segments():
        ex, ey = d[0] - c[0], d[1] - c[1]
        den = dx * ey - dy * ex
        if den != 0:
            t = ((c[0] - a[0]) * ey - (c[1] - a[1]) * ex) / den
            u = ((c[0] - a[0]) * dy - (c[1] - a[1]) * dx) / den
            if 0 <= t <= 1 and 0 <= u <= 1:
                ts.add(t)
        elif _cross(a, b, c) == 0:          # collinear: split at the other's endpoints
            for q in (c, d):
                t = ((q[0] - a[0]) * dx + (q[1] - a[1]) * dy) / denom_len
                if 0 <= t <= 1:
                    ts.add(t)
    for q in other.points:
        if _on_segment(q, a, b):
            ts.add(((q[0] - a[0]) * dx + (q[1] - a[1]) * dy) / denom_len)
    return sorted(ts)


def _pieces(shape: Shape, other: Shape):
    """(midpoint, segment direction, ring-membership) of every piece of shape's segments split by other."""
    for a, b in shape.segments():
        ts = _split_params(a, b, other)
        for t0, t1 in zip(ts, ts[1:]):
            tm = (t0 + t1) / 2
            yield (a[0] + tm * (b[0] - a[0]), a[1] + tm * (b[1] - a[1])), (b[0] - a[0], b[1] - a[1])


def _contacts(s: Shape, o: Shape):
    """Points where the two geometries' segments / points meet (for 0-dimensional contacts)."""
    pts = []
    for a, b in s.segments():
        for t in _split_params(a, b, o):
            p = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
            if o.locate(p) != "E":
                pts.append(p)
    for p in s.points:
        if o.locate(p) != "E":
            pts.append(p)
    for v in [v for ln in s.lines for v in ln] + [v for r in s.rings for v in r]:
        if o.locate(v) != "E":
            pts.append(v)
    return pts


# ================================================================ DE-9IM cells
def _matrix(a: Shape, b: Shape) -> dict:
    """Booleans II, IB, IE, BI, BB, BE, EI, EB plus II dimension for a vs b."""
    m = {k: False for k in ("II", "IB", "IE", "BI", "BB", "BE", "EI", "EB")}
    m["II_dim"] = -1

    def mark(cell, dim=None):
        m[cell] = True
        if cell == "II" and dim is not None:
            m["II_dim"] = max(m["II_dim"], dim)

    # --- a's parts against b
    _side(a, b, mark)
    _side(b, a, lambda cell, dim=None: mark(cell[::-1], dim))
    # polygons: interior-interior also when one boundary piece of a lies on b's boundary with
    # both interiors on the same side (handled in _side); exterior of a always meets
    # interior of b unless b within a -- covered by b's pieces being located in a
    return m


def _interior_side(shape: Shape, mid, d, side: float) -> bool:
    """Whether the area's interior lies on one side (1 left, -1 right) of its boundary at ``mid``.

    Even-odd count of the segments that a ray from ``mid`` across the boundary
    meets, the segments through ``mid`` left out: no step away from the
    boundary, so no area is too thin to tell.
    """
    (mx, my), (dx, dy) = mid, d
    odd = False
    for p, q in shape.segments():
        up, uq = (p[0] - mx) * dx + (p[1] - my) * dy, (q[0] - mx) * dx + (q[1] - my) * dy
        if (up > 0) == (uq > 0) or _on_segment(mid, p, q):
            continue
        vp, vq = (p[1] - my) * dx - (p[0] - mx) * dy, (q[1] - my) * dx - (q[0] - mx) * dy
        if side * (vp + (vq - vp) * up / (up - uq)) > 0:
            odd = not odd
    return odd


def _side(a: Shape, b: Shape, mark) -> None:
    if a.dim == 0:
        for p in a.points:
            loc = b.locate(p)
            mark("I" + loc, 0) if loc == "I" else mark("I" + loc)
        return
    if a.dim == 1:
        bnd = a.line_boundary()
        for p in bnd:
            loc = b.locate(p)
            mark("B" + loc)
        for mid, _ in _pieces(a, b):
            loc = b.locate(mid)
            mark("I" + loc, 1) if loc == "I" else mark("I" + loc)
        for p in _contacts(a, b):
            if p in bnd:
                continue
            loc = b.locate(p)
            if loc == "I":
                mark("II", 0)
            elif loc == "B":
                mark("IB")
        return
    # polygon: boundary pieces, and the interior next to each piece
    for mid, d in _pieces(a, b):
        loc = b.locate(mid)
        mark("B" + loc)
        if b.dim < 2 or loc == "E":
            mark("IE")                      # an area's interior next to a line or point is outside of it
        elif loc == "I":
            mark("II", 2)
            mark("EI")                      # both sides of the piece are in b's interior
        else:                               # a shared piece of boundary: compare the sides of the interiors
            for side in (1.0, -1.0):
                if _interior_side(a, mid, d, side):
                    if _interior_side(b, mid, d, side):
                        mark("II", 2)
                    else:
                        mark("IE")
    for p in _contacts(a, b):
        loc = b.locate(p)
        if loc != "E":
            mark("B" + loc)


def relate(a: Shape, b: Shape, op: str, matrix: dict | None = None) -> bool:
    m = matrix or _matrix(a, b)
    inter = any(m[k] for k in ("II", "IB", "BI", "BB"))
    if op == "s_intersects":
        return inter
    if op == "s_disjoint":
        return not inter
    if op == "s_within":
        return m["II"] and not m["IE"] and not m["BE"]
    if op == "s_contains":
        return m["II"] and not m["EI"] and not m["EB"]
    if op == "s_equals":
        return m["II"] and not m["IE"] and not m["BE"] and not m["EI"] and not m["EB"]
    if op == "s_touches":
        return inter and not m["II"]
    if op == "s_crosses":
        if a.dim == b.dim == 1:
            return m["II"] and m["II_dim"] == 0
        if a.dim < b.dim:
            return m["II"] and m["IE"]
        if a.dim > b.dim:
            return m["II"] and m["EI"]
        return False
    if op == "s_overlaps":
        if a.dim != b.dim:
            return False
        if a.dim == 1 and m["II_dim"] != 1:
            return False
        return m["II"] and m["IE"] and m["EI"]
    raise ValueError(f"Unknown spatial operator: {op}")


def min_distance_m(s: Shape, lon: float, lat: float) -> float:
    """Distance from (lon, lat) to the geometry in a local equirectangular projection (D1)."""
    if s.dim == 2 and s.locate(_exact((lon, lat))) != "E":
        return 0.0
    k = math.cos(math.radians(lat))
    r = math.radians(1.0) * EARTH_RADIUS_M

    def proj(v):
        return ((v[0] - lon) * k * r, (v[1] - lat) * r)

    best = math.inf
    for p in s.points:
        x, y = proj((float(p[0]), float(p[1])))
        best = min(best, math.hypot(x, y))
    for a, b in s.segments():
        ax, ay = proj((float(a[0]), float(a[1])))
        bx, by = proj((float(b[0]), float(b[1])))
        dx, dy = bx - ax, by - ay
        L = dx * dx + dy * dy
        t = 0.0 if L == 0 else max(0.0, min(1.0, -(ax * dx + ay * dy) / L))
        best = min(best, math.hypot(ax + t * dx, ay + t * dy))
    return best


def _literal_shape(g) -> Shape:
    return Shape(g.type, [[list(r) for r in part] for part in g.parts])
