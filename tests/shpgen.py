"""Writes small zipped shapefiles for tests (polygons, dBase III attributes, .prj)."""

import io
import struct
import zipfile

L93_PRJ = ('PROJCS["RGF93 / Lambert-93",GEOGCS["RGF93",DATUM["Reseau_Geodesique_Francais_1993",'
           'SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],'
           'PROJECTION["Lambert_Conformal_Conic_2SP"],UNIT["metre",1],AUTHORITY["EPSG","2154"]]')


def _poly_record(recno, rings):
    pts = [p for r in rings for p in r]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    starts, acc = [], 0
    for r in rings:
        starts.append(acc)
        acc += len(r)
    body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(pts))
    body += struct.pack(f"<{len(starts)}i", *starts)
    body += b"".join(struct.pack("<2d", *p) for p in pts)
    return struct.pack(">ii", recno, len(body) // 2) + body


def write_zip(path, polygons, records, fields, prj=L93_PRJ):
    """polygons: list of ring lists (shell clockwise, holes counter-clockwise)."""
    recs = b"".join(_poly_record(i + 1, rings) for i, rings in enumerate(polygons))
    header = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(recs)) // 2) + struct.pack("<ii4d4d", 1000, 5,
                                                                                               0, 0, 0, 0, 0, 0, 0, 0)
    shp = header + recs
    rlen = 1 + sum(f[2] for f in fields)
    hlen = 32 + 32 * len(fields) + 1
    dbf = struct.pack("<B3BIHH20x", 3, 24, 1, 1, len(records), hlen, rlen)
    for name, typ, flen, dec in fields:
        dbf += name.encode().ljust(11, b"\x00") + typ.encode() + b"\x00" * 4 + bytes([flen, dec]) + b"\x00" * 14
    dbf += b"\x0d"
    for rec in records:
        dbf += b" " + b"".join(str(v).encode()[:f[2]].ljust(f[2]) if f[1] == "C" else str(v).encode()[:f[2]].rjust(f[2])
                               for v, f in zip(rec, fields))
    dbf += b"\x1a"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("layer.shp", shp)
        z.writestr("layer.dbf", dbf)
        z.writestr("layer.prj", prj)
    with open(path, "wb") as f:
        f.write(buf.getvalue())
