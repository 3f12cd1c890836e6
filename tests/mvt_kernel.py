"""Per-feature Python encoder of vector tiles: the plain form the Spark expressions are tested against."""

from __future__ import annotations

import json
import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoplane.operators import tiles as TL
from geoplane.operators.mvt import field_key, ld, varint

EXTENT = TL.EXTENT
BUFFER = TL.BUFFER


_SMALL_VARINTS = None


def small_varint(n: int) -> bytes:
    """Varint with a lookup table for the small values tile coordinates produce."""
    global _SMALL_VARINTS
    if _SMALL_VARINTS is None:
        _SMALL_VARINTS = [varint(i) for i in range(1 << 15)]
    return _SMALL_VARINTS[n] if 0 <= n < (1 << 15) else varint(n)


def packed(num: int, values) -> bytes:
    return ld(num, b"".join(varint(v) for v in values))


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)

# ---------------------------------------------------------------- geometry: clip + commands
def _clip_ring(ring: list[tuple[float, float]], lo: float, hi: float) -> list[tuple[float, float]]:
    """Sutherland-Hodgman against the square [lo, hi]^2 (tile units)."""
    def clip(pts, inside, inter):
        out = []
        for i, cur in enumerate(pts):
            prev = pts[i - 1]
            if inside(cur):
                if not inside(prev):
                    out.append(inter(prev, cur))
                out.append(cur)
            elif inside(prev):
                out.append(inter(prev, cur))
        return out

    def ix(a, b, x):
        t = (x - a[0]) / (b[0] - a[0])
        return (x, a[1] + t * (b[1] - a[1]))

    def iy(a, b, y):
        t = (y - a[1]) / (b[1] - a[1])
        return (a[0] + t * (b[0] - a[0]), y)

    pts = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    for inside, inter in ((lambda p: p[0] >= lo, lambda a, b: ix(a, b, lo)),
                          (lambda p: p[0] <= hi, lambda a, b: ix(a, b, hi)),
                          (lambda p: p[1] >= lo, lambda a, b: iy(a, b, lo)),
                          (lambda p: p[1] <= hi, lambda a, b: iy(a, b, hi))):
        if not pts:
            break
        pts = clip(pts, inside, inter)
    return pts


def _clip_line(line, lo, hi):
    """Liang-Barsky per segment; consecutive inside pieces are chained."""
    out, cur = [], []
    for a, b in zip(line, line[1:]):
        t0, t1 = 0.0, 1.0
        dx, dy = b[0] - a[0], b[1] - a[1]
        ok = True
        for p, q in ((-dx, a[0] - lo), (dx, hi - a[0]), (-dy, a[1] - lo), (dy, hi - a[1])):
            if p == 0:
                if q < 0:
                    ok = False
                    break
            else:
                t = q / p
                if p < 0:
                    t0 = max(t0, t)
                else:
                    t1 = min(t1, t)
        if not ok or t0 > t1:
            if cur:
                out.append(cur)
                cur = []
            continue
        s = (a[0] + t0 * dx, a[1] + t0 * dy)
        e = (a[0] + t1 * dx, a[1] + t1 * dy)
        if not cur:
            cur = [s]
        elif cur[-1] != s:
            out.append(cur)
            cur = [s]
        cur.append(e)
        if t1 < 1.0:
            out.append(cur)
            cur = []
    if cur:
        out.append(cur)
    return out


def _q(pts):
    out = []
    for x, y in pts:
        p = (int(math.floor(x + 0.5)), int(math.floor(y + 0.5)))
        if not out or out[-1] != p:
            out.append(p)
    return out


def _area2(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def encode_geometry(gtype: str, parts, tx: float, ty: float, w: float) -> tuple[int, list[int]]:
    """(MVT geometry type, command integers) of one feature in one tile; (0, []) when clipped away.

    ``parts`` are EPSG:3857 coordinates; (tx, ty) is the tile's north-west corner.
    """
    def to_tile(v):
        return ((v[0] - tx) / w * EXTENT, (ty - v[1]) / w * EXTENT)

    lo, hi = -BUFFER, EXTENT + BUFFER
    cmds, cx, cy = [], 0, 0

    def move_line(pts, close):
        nonlocal cx, cy
        cmds.append((1 & 0x7) | (1 << 3))
        cmds.extend([zigzag(pts[0][0] - cx), zigzag(pts[0][1] - cy)])
        cx, cy = pts[0]
        if len(pts) > 1:
            cmds.append((2 & 0x7) | ((len(pts) - 1) << 3))
            for p in pts[1:]:
                cmds.extend([zigzag(p[0] - cx), zigzag(p[1] - cy)])
                cx, cy = p
        if close:
            cmds.append((7 & 0x7) | (1 << 3))

    if gtype in ("Point", "MultiPoint"):
        pts = []
        for part in parts:
            x, y = to_tile(part[0][0])
            if lo <= x <= hi and lo <= y <= hi:
                pts.append((int(math.floor(x + 0.5)), int(math.floor(y + 0.5))))
        if not pts:
            return 0, []
        cmds.append(1 | (len(pts) << 3))
        for p in pts:
            cmds.extend([zigzag(p[0] - cx), zigzag(p[1] - cy)])
            cx, cy = p
        return 1, cmds
    if gtype in ("LineString", "MultiLineString"):
        for part in parts:
            for piece in _clip_line([to_tile(v) for v in part[0]], lo, hi):
                q = _q(piece)
                if len(q) >= 2:
                    move_line(q, False)
        return (2, cmds) if cmds else (0, [])
    for part in parts:
        for k, ring in enumerate(part):
            q = _q(_clip_ring([to_tile(v) for v in ring], lo, hi))
            if len(q) > 1 and q[0] == q[-1]:
                q = q[:-1]
            if len(q) < 3 or _area2(q) == 0:
                continue
            # exterior rings positive area (clockwise on screen), holes negative
            if (k == 0) != (_area2(q) > 0):
                q = q[::-1]
            move_line(q, True)
    return (3, cmds) if cmds else (0, [])


# ---------------------------------------------------------------- Spark plan
def tile_blobs(coll, zooms, props: list[str] | None = None, salt: int = 8, layer: str | None = None,
               only: DataFrame | None = None) -> DataFrame:
    """(z, x, y, mvt binary) by per-feature Python."""
    if props is None:
        props = [a for _, a in coll.exposed_columns()]
    sources = dict((a, s) for s, a in coll.exposed_columns())
    layer = layer or coll.name
    from geoplane.functions.geometry import transform_geom
    # reprojected once a feature, before it is copied into its tiles
    merc = transform_geom(F.col(coll.geometry_column), coll.srid, 3857)
    t = TL.assign_tiles(replace(coll, df=coll.df.withColumn("__g", merc)), zooms,
                        [coll.id_column, "__g", *[sources.get(p, p) for p in props]])
    t = t.select("z", "x", "y", F.col(coll.id_column).alias("__id"), "__g",
                 *[F.col(sources.get(p, p)).cast("string").alias(p) for p in props])
    t = t.filter(F.col("__g").isNotNull())
    points = coll.geometry_type == "Point"
    if points:
        # points: quantised in the JVM (TIL-4 expressions); Python only assembles bytes
        qx, qy = TL.quantize_point(F.col("__g")["parts"][0][0][0]["x"], F.col("__g")["parts"][0][0][0]["y"],
                                   F.col("z"), F.col("x"), F.col("y"))
        t = t.withColumn("__qx", qx).withColumn("__qy", qy).drop("__g")
    else:
        t = t.withColumn("__g", F.to_json("__g"))     # ragged nested arrays do not convert to pandas
    if only is not None:
        t = t.join(only.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_semi")
    t = t.withColumn("__chunk", F.pmod(F.xxhash64("__id"), F.lit(int(salt))).cast("int"))
    nvals = sum((F.col(p).isNotNull().cast("int") for p in props), F.lit(0))
    # per-chunk value counts -> value-index offset of every chunk inside its tile (<= salt rows per tile)
    counts = t.groupBy("z", "x", "y", "__chunk").agg(F.sum(nvals).cast("long").alias("__nv"))
    w = Window.partitionBy("z", "x", "y").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__base", F.coalesce(F.sum("__nv").over(w), F.lit(0)).cast("long"))
    t = t.join(offsets.select("z", "x", "y", "__chunk", "__base"), ["z", "x", "y", "__chunk"])
    wcol = TL.tile_width(F.col("z"))
    t = (t.withColumn("__tx", F.col("x") * wcol - TL.H).withColumn("__ty", TL.H - F.col("y") * wcol)
         .withColumn("__w", wcol))

    chunk_schema = "z int, x bigint, y bigint, __chunk int, features binary, vals binary"

    def encode_points(pdf: pd.DataFrame, base: int):
        """Vectorised point path: arrays in, one bytes string per feature out."""
        qx = pdf["__qx"].to_numpy()
        qy = pdf["__qy"].to_numpy()
        inside = (qx >= -BUFFER) & (qx <= EXTENT + BUFFER) & (qy >= -BUFFER) & (qy <= EXTENT + BUFFER)
        zx = (qx.astype(np.int64) << 1) ^ (qx.astype(np.int64) >> 63)
        zy = (qy.astype(np.int64) << 1) ^ (qy.astype(np.int64) >> 63)
        cols = [pdf[p].to_numpy(dtype=object) for p in props]
        feats, vals, nxt = [], [], base
        type_point = field_key(3, 0) + varint(1)
        for i in range(len(pdf)):
            tags = []
            for k, col in enumerate(cols):
                v = col[i]
                if v is None or (isinstance(v, float) and v != v):
                    continue
                vals.append(ld(4, ld(1, str(v).encode())))
                tags.append(small_varint(k) + small_varint(nxt) if nxt < (1 << 15) else varint(k) + varint(nxt))
                nxt += 1
            if not inside[i]:
                continue
            geom = b"\x09" + small_varint(int(zx[i])) + small_varint(int(zy[i]))
            body = (ld(2, b"".join(tags)) if tags else b"") + type_point + ld(4, geom)
            feats.append(ld(2, body))
        return feats, vals

    def encode_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id", kind="stable")
        base = int(pdf["__base"].iloc[0])
        if points:
            feats, vals = encode_points(pdf, base)
            first = pdf.iloc[0]
            return pd.DataFrame([{"z": int(first["z"]), "x": int(first["x"]), "y": int(first["y"]),
                                  "__chunk": int(first["__chunk"]), "features": b"".join(feats),
                                  "vals": b"".join(vals)}])
        feats, vals = [], []
        nxt = base
        for rec in pdf.to_dict("records"):
            gtype, cmds = encode_geometry(*_row_geom(rec["__g"]), rec["__tx"], rec["__ty"], rec["__w"])
            if gtype == 0:
                # feature clipped away: its values still occupy the reserved slots
                for p in props:
                    v = rec[p]
                    if v is not None and not (isinstance(v, float) and np.isnan(v)):
                        vals.append(ld(4, ld(1, str(v).encode())))
                        nxt += 1
                continue
            tags = []
            for k, p in enumerate(props):
                v = rec[p]
                if v is None or (isinstance(v, float) and np.isnan(v)):
                    continue
                tags += [k, nxt]
                vals.append(ld(4, ld(1, str(v).encode())))
                nxt += 1
            body = (packed(2, tags) if tags else b"") + field_key(3, 0) + varint(gtype) + packed(4, cmds)
            feats.append(ld(2, body))
        first = pdf.iloc[0]
        return pd.DataFrame([{"z": int(first["z"]), "x": int(first["x"]), "y": int(first["y"]),
                              "__chunk": int(first["__chunk"]), "features": b"".join(feats), "vals": b"".join(vals)}])

    chunks = t.groupBy("z", "x", "y", "__chunk").applyInPandas(encode_chunk, chunk_schema)

    header = ld(1, layer.encode()) + b"".join(ld(3, p.encode()) for p in props)
    trailer = field_key(5, 0) + varint(EXTENT) + field_key(15, 0) + varint(2)

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        feats = b"".join(pdf["features"])
        if not feats:
            return pd.DataFrame({"z": [], "x": [], "y": [], "mvt": []}).astype(
                {"z": "int32", "x": "int64", "y": "int64"})
        layer_bytes = header + feats + b"".join(pdf["vals"]) + trailer
        first = pdf.iloc[0]
        return pd.DataFrame([{"z": int(first["z"]), "x": int(first["x"]), "y": int(first["y"]),
                              "mvt": ld(3, layer_bytes)}])

    return chunks.groupBy("z", "x", "y").applyInPandas(assemble, "z int, x bigint, y bigint, mvt binary")


def _row_geom(g: str):
    g = json.loads(g)
    t = g["type"]
    parts = [[[(float(v["x"]), float(v["y"])) for v in ring] for ring in part] for part in g["parts"]]
    return t, parts
