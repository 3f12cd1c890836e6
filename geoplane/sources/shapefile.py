"""Zipped ESRI shapefile import (SRC-4, SRC-11, ING-13).

A Spark job over a ``binaryFile`` listing of ``*.zip`` files: each zip is
decoded by one task (``mapInPandas``), first for its layer metadata (field
list, SRID from the ``.prj``), then for its features.  Only the first layer
(by name) of a zip is imported, with a warning when there are more.
Geometries are reprojected from the source SRID to the target with the CRS
column expressions; an unknown source SRID is taken as the target (warning).
Feature ids are the shapefile record numbers (1-based).
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import text as TX

# Fixed values: .prj name fragments of the supported coordinate systems.
PRJ_NAMES = (("lambert_93", 2154), ("lambert-93", 2154), ("rgf93 / lambert", 2154),
             ("pseudo-mercator", 3857), ("web_mercator", 3857), ("wgs_1984_web_mercator", 3857))

_SHAPE_KIND = {1: "Point", 11: "Point", 21: "Point", 8: "MultiPoint", 18: "MultiPoint", 28: "MultiPoint",
               3: "LineString", 13: "LineString", 23: "LineString", 5: "Polygon", 15: "Polygon", 25: "Polygon"}


# ---------------------------------------------------------------- binary decoding
def prj_srid(wkt: str | None) -> int | None:
    """EPSG code of a .prj: the outermost AUTHORITY / ID, else a known name, else None."""
    if not wkt:
        return None
    auth = re.findall(r'(?:AUTHORITY|ID)\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]', wkt, flags=re.I)
    if auth:
        return int(auth[-1])
    low = wkt.lower()
    for frag, code in PRJ_NAMES:
        if frag in low:
            return code
    if low.startswith("geogcs") and "wgs" in low and "84" in low:
        return 4326
    return None


def _ring_area2(r) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))


def _in_ring(p, ring) -> bool:
    x, y = p
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def read_shp(data: bytes):
    """Yield (record number, kind, parts) of every record; parts is part -> ring -> (x, y)."""
    pos = 100
    n = len(data)
    while pos + 8 <= n:
        recno, length = struct.unpack(">ii", data[pos:pos + 8])
        body = data[pos + 8:pos + 8 + 2 * length]
        pos += 8 + 2 * length
        if len(body) < 4:
            continue
        stype = struct.unpack("<i", body[:4])[0]
        kind = _SHAPE_KIND.get(stype)
        if kind is None:                      # null shape
            yield recno, None, None
            continue
        if kind == "Point":
            x, y = struct.unpack("<2d", body[4:20])
            yield recno, "Point", [[[(x, y)]]]
            continue
        if kind == "MultiPoint":
            npts = struct.unpack("<i", body[36:40])[0]
            pts = struct.unpack(f"<{2 * npts}d", body[40:40 + 16 * npts])
            yield recno, "MultiPoint", [[[(pts[2 * i], pts[2 * i + 1])]] for i in range(npts)]
            continue
        nparts, npts = struct.unpack("<2i", body[36:44])
        starts = list(struct.unpack(f"<{nparts}i", body[44:44 + 4 * nparts])) + [npts]
        off = 44 + 4 * nparts
        flat = struct.unpack(f"<{2 * npts}d", body[off:off + 16 * npts])
        rings = [[(flat[2 * i], flat[2 * i + 1]) for i in range(starts[k], starts[k + 1])] for k in range(nparts)]
        if kind == "LineString":
            yield recno, ("LineString" if nparts == 1 else "MultiLineString"), [[r] for r in rings]
            continue
        # polygons: clockwise rings are shells, counter-clockwise rings are holes of the shell holding them
        shells, holes = [], []
        for r in rings:
            (shells if _ring_area2(r) <= 0 else holes).append(r)
        polys = [[s] for s in shells]
        for h in holes:
            owner = next((p for p in polys if _in_ring(h[0], p[0])), None)
            if owner is None:
                polys.append([h[::-1]])
            else:
                owner.append(h)
        yield recno, ("Polygon" if len(polys) == 1 else "MultiPolygon"), polys


def read_dbf_header(data: bytes):
    nrec, hlen, rlen = struct.unpack("<IHH", data[4:12])
    fields, pos = [], 32
    while pos < hlen - 1 and data[pos] != 0x0D:
        raw = data[pos:pos + 32]
        name = raw[:11].split(b"\x00")[0].decode("latin-1").strip()
        fields.append((name, chr(raw[11]), raw[16], raw[17]))
        pos += 32
    return nrec, hlen, rlen, fields


def read_dbf(data: bytes, encoding: str = "utf-8"):
    """Yield one {field: text or None} dict per record."""
    nrec, hlen, rlen, fields = read_dbf_header(data)
    for i in range(nrec):
        rec = data[hlen + i * rlen: hlen + (i + 1) * rlen]
        pos, out = 1, {}
        for name, _typ, flen, _dec in fields:
            raw = rec[pos:pos + flen]
            pos += flen
            try:
                txt = raw.decode(encoding).strip()
            except UnicodeDecodeError:
                txt = raw.decode("latin-1").strip()
            out[name] = txt if txt not in ("", "*" * flen) else None
        yield out


def dbf_type(typ: str, dec: int) -> str:
    if typ in ("N", "F"):
        return "INTEGER" if dec == 0 else "DOUBLE PRECISION"
    if typ == "L":
        return "BOOLEAN"
    return "TEXT"


def _layers(z: zipfile.ZipFile) -> list[str]:
    return sorted({m.rsplit(".", 1)[0] for m in z.namelist() if m.lower().endswith(".shp")})


def _member(z, layer, ext):
    for m in z.namelist():
        if m.rsplit(".", 1)[0] == layer and m.lower().endswith(ext):
            return z.read(m)
    return None


# ---------------------------------------------------------------- Spark job
_META_SCHEMA = "path string, layer string, n_layers int, srid int, fields string"
_FEAT_SCHEMA = ("path string, fid bigint, type string, "
                "parts array<array<array<struct<x:double,y:double>>>>, props map<string,string>")


def _meta(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            z = zipfile.ZipFile(io.BytesIO(bytes(content)))
            layers = _layers(z)
            if not layers:
                out.append((path, None, 0, None, "[]"))
                continue
            layer = layers[0]
            prj = _member(z, layer, ".prj")
            dbf = _member(z, layer, ".dbf")
            fields = read_dbf_header(dbf)[3] if dbf else []
            out.append((path, layer, len(layers), prj_srid(prj.decode("latin-1") if prj else None),
                        json.dumps([[n, dbf_type(t, d)] for n, t, _, d in fields])))
        yield pd.DataFrame(out, columns=["path", "layer", "n_layers", "srid", "fields"])


def _features(batches):
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            z = zipfile.ZipFile(io.BytesIO(bytes(content)))
            layers = _layers(z)
            if not layers:
                continue
            shp = _member(z, layers[0], ".shp")
            dbf = _member(z, layers[0], ".dbf")
            records = list(read_dbf(dbf)) if dbf else []
            for i, (recno, kind, parts) in enumerate(read_shp(shp)):
                props = records[i] if i < len(records) else {}
                geo = None if parts is None else [[[{"x": x, "y": y} for x, y in ring] for ring in part]
                                                  for part in parts]
                rows.append((path, int(recno), kind, geo, props))
        yield pd.DataFrame(rows, columns=["path", "fid", "type", "parts", "props"])


def shapefile_metadata(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(_meta, _META_SCHEMA)


def read_shapefile(spark: SparkSession, path: str, target_srid: int = 4326) -> tuple[DataFrame, dict]:
    """Import zipped shapefile(s).  Returns (features, info with srid / fields / warnings)."""
    meta = shapefile_metadata(spark, path).collect()            # one row per zip file
    if not meta or all(m["layer"] is None for m in meta):
        raise ValueError("No shapefile layer found in the archive")
    warnings = []
    if any((m["n_layers"] or 0) > 1 for m in meta):
        warnings.append("archive holds several layers; only the first one is imported")
    srids = {m["srid"] for m in meta}
    src = next(iter(srids))
    if src is None:
        warnings.append("unknown source SRID; coordinates taken as the target SRID")
        src = target_srid
    if len(srids) > 1:
        raise ValueError("zips with different coordinate systems must be imported separately")
    fields = []
    for m in meta:
        for n, t in json.loads(m["fields"]):
            if n not in [f[0] for f in fields]:
                fields.append((n, t))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    raw = files.select("path", "content").mapInPandas(_features, _FEAT_SCHEMA)
    geom = F.when(F.col("type").isNotNull(), F.struct(F.col("type"), F.lit(int(src)).alias("srid"), F.col("parts")))
    geom = G.promote_multi(G.transform_geom(geom, int(src), int(target_srid)))
    props = [TX.coerce(F.col("props")[n], t).alias(TX.sanitize_name(n)) for n, t in fields]
    out = G.with_bbox(raw.select(F.col("fid").alias("id"), *props, geom.alias("geom")))
    first = out.filter(F.col("geom").isNotNull()).orderBy("id").select("geom.type").limit(1).collect()
    return out, {"format": "shapefile", "srid": src, "fields": fields, "warnings": warnings,
                 "geometry_type": first[0][0] if first else None}


def preview_shapefile(spark: SparkSession, path: str) -> dict:
    """SRC-11: metadata + up to 100 features in 4326, first 5 rows, bbox of the sample.

    A failing sample (bad geometry, unsupported projection) still returns the
    layer metadata, with an empty sample and the error as a warning.
    """
    feats, info = read_shapefile(spark, path, 4326)
    try:
        sample = feats.orderBy("id").limit(100)
        rows = sample.drop("geom").limit(5).collect()
        bbox = sample.agg(F.min("_xmin"), F.min("_ymin"), F.max("_xmax"), F.max("_ymax")).first()
    except Exception as e:  # noqa: BLE001 - the preview degrades to metadata only
        return {**info, "features": None, "sample_rows": [], "bbox": None,
                "warnings": info["warnings"] + [f"sample failed: {str(e)[:200]}"]}
    return {**info, "features": sample, "sample_rows": rows,
            "bbox": list(bbox) if bbox and bbox[0] is not None else None}
