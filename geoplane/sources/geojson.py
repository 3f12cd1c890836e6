"""GeoJSON import (SRC-1, SRC-2, SRC-8, SRC-9, ING-6, ING-10, ING-11, ING-12, ING-14, ING-17).

Two input shapes:

* a FeatureCollection document (the reference's upload): read with the JSON
  source in multi-line mode -- one document is one task, as it is one
  request in the reference -- and ``posexplode``-d into features;
* line-delimited features (one Feature per line, GeoJSON text sequences):
  splittable, the shape to use for large inputs.

``geometry`` and ``properties`` are read as raw JSON text and parsed with
``from_json``: the geometry by :func:`geoplane.functions.geometry.from_geojson`,
the properties with a schema inferred from the first feature (ING-6).
Gzip input is decompressed by the source when the name ends in ``.gz``; a gzip
file under another name is recognised by its magic bytes and decompressed in
the task that reads it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import text as TX
from .ids import FILE_PIECE, with_file_piece, with_sequential_id

_FC_SCHEMA = ("type string, features array<struct<type:string, id:string, geometry:string, properties:string>>")
_FEATURE_SCHEMA = "type string, id string, geometry string, properties string"


def json_type_to_pg(value) -> str:
    """ING-6: integer number -> INTEGER, other number -> DOUBLE PRECISION, boolean -> BOOLEAN, else TEXT."""
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, int):
        return "INTEGER" if -2147483648 <= value <= 2147483647 else "BIGINT"
    if isinstance(value, float):
        return "INTEGER" if value.is_integer() and abs(value) <= 2147483647 else "DOUBLE PRECISION"
    return "TEXT"


def head_bytes(spark: SparkSession, path: str, n: int = 2) -> bytes | None:
    """First bytes of one file through the session's Hadoop FileSystem (None for dirs/globs)."""
    if any(ch in path for ch in "*?[{"):
        return None
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
        return None
    stream = fs.open(p)
    try:
        return bytes((stream.read() & 0xFF) for _ in range(n))
    finally:
        stream.close()


def is_hidden_gzip(spark: SparkSession, path: str) -> bool:
    """SRC-2: gzip magic 1f 8b on a file whose name does not end in .gz."""
    return not path.lower().endswith(".gz") and head_bytes(spark, path) == b"\x1f\x8b"


def _gunzip_docs(batches):
    import gzip
    for pdf in batches:
        yield pd.DataFrame({"value": [gzip.decompress(bytes(c)).decode("utf-8") for c in pdf["content"]]})


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection documents as parsed structs (one document per task)."""
    if is_hidden_gzip(spark, path):
        raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_gunzip_docs, "value string")
        return raw.select(F.from_json("value", _FC_SCHEMA + ", _corrupt_record string",
                                      {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("d")).select(
            "d.*", F.lit(path).alias(FILE_PIECE[0]), F.lit(0).cast("bigint").alias(FILE_PIECE[1]))
    return with_file_piece(
        spark.read.schema(_FC_SCHEMA + ", _corrupt_record string").option("multiLine", "true").json(path))


def _line_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_FEATURE_SCHEMA).json(path)


def read_feature_rows(spark: SparkSession, path: str, line_delimited: bool = False, upto: str | None = None) -> DataFrame:
    """(pos, geometry json, properties json) in file order, validated as a FeatureCollection.

    ``upto``: of the documents up to this file (the filter prunes the files before they are read).
    """
    if line_delimited:
        raw = with_file_piece(_line_features(spark, path))
        return with_sequential_id(raw, "pos", start=0, order_by=FILE_PIECE).select("pos", "geometry", "properties")
    # several documents: positions go on from file to file
    doc = _documents(spark, path)
    if upto is not None:
        doc = doc.filter(F.col(FILE_PIECE[0]) <= upto)
    rows = doc.select(F.col("type").alias("__t"), *FILE_PIECE, F.explode("features").alias("f"))
    return with_sequential_id(rows, "pos", start=0, order_by=FILE_PIECE).select(
        "__t", "pos", "f.geometry", "f.properties")


def _features_in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """Features as the documents hold them, without numbering (for the first few)."""
    return _documents(spark, path).select(F.explode("features").alias("f")).select("f.geometry", "f.properties")


def validate_collection(spark: SparkSession, path: str) -> None:
    """SRC-8: must parse, be a FeatureCollection and hold a non-empty features array."""
    doc = _documents(spark, path)
    r = doc.select("type", F.size("features").alias("n"), "_corrupt_record").first()
    if r is None or r["_corrupt_record"] is not None:
        raise ValueError("Invalid JSON")
    if r["type"] != "FeatureCollection":
        raise ValueError("GeoJSON must be a FeatureCollection")
    if r["n"] is None or r["n"] <= 0:
        raise ValueError("FeatureCollection has no features")


def infer_property_types(rows: DataFrame) -> dict[str, str]:
    """ING-6: property names and types from the first feature only (one row to the driver).

    ``rows`` yields the first feature first (file order): ``limit(1)`` then
    reads only as much input as that takes.
    """
    first = rows.select("properties").limit(1).collect()
    if not first or first[0]["properties"] is None:
        return {}
    props = json.loads(first[0]["properties"])
    return {k: json_type_to_pg(v) for k, v in props.items()} if isinstance(props, dict) else {}


def read_geojson(spark: SparkSession, path: str, srid: int = 4326, line_delimited: bool = False,
                 validate: bool = True, upto: str | None = None) -> tuple[DataFrame, dict]:
    """Import GeoJSON features.  Returns (features, info).

    ``features``: id = file position + 1, properties with sanitised names and
    inferred types (missing keys -> null, bad values -> null), ``geom``
    promoted to Multi and tagged ``srid`` (no reprojection), bbox columns.
    ``info``: inferred types and the geometry type of the first feature.
    ``upto``: only the documents up to this file.
    """
    if validate and not line_delimited:
        validate_collection(spark, path)
    rows = read_feature_rows(spark, path, line_delimited, upto)
    # file order: the raw line-delimited read, or the exploded document
    ordered = _line_features(spark, path) if line_delimited else _features_in_file_order(spark, path)
    types = infer_property_types(ordered if upto is None else rows.orderBy("pos"))
    fields = []
    for name, t in types.items():
        st = TX.SPARK_TYPE.get(t, "string")
        fields.append((name, TX.sanitize_name(name), st))
    if fields:
        # parse as strings first (keeps nested objects / arrays as JSON text), then cast
        schema = "struct<" + ",".join(f"`{n}`:string" for n, _, _ in fields) + ">"
        parsed = F.from_json(F.col("properties"), schema)
        props = [parsed[n].try_cast(st).alias(s) if st != "string" else parsed[n].alias(s) for n, s, st in fields]
    else:
        props = []
    geom = G.promote_multi(G.from_geojson(F.col("geometry"), srid))
    out = rows.select((F.col("pos") + 1).cast("bigint").alias("id"), *props, geom.alias("geom"))
    out = G.with_bbox(out)
    # D6: a first feature without geometry is accepted; the type comes from the first one that has one
    first_type = (ordered.select(G.promote_multi(G.from_geojson(F.col("geometry"), srid))["type"].alias("t"))
                  .filter(F.col("t").isNotNull()).limit(1).collect())
    info = {"types": {s: t for (n, s, _), t in zip(fields, types.values())},
            "geometry_type": first_type[0]["t"] if first_type else None}
    return out, info


def preview_geojson(spark: SparkSession, path: str) -> dict:
    """SRC-9: fields of the first feature, first 5 rows, first 100 features, bbox of the
    first 1000, feature count, srid null."""
    # one pass over all documents counts their features; the rest needs those that hold the first 1000
    docs = _documents(spark, path).groupBy(FILE_PIECE[0]).agg(F.sum(F.array_size("features")).alias("n")).filter("n > 0").persist()
    try:
        total = docs.agg(F.sum("n")).first()[0] or 0
        upto, held = "", 0
        for r in docs.orderBy(FILE_PIECE[0]).limit(1000).collect():        # one row a document, each of one feature at least
            if held >= 1000:
                break
            upto, held = r[FILE_PIECE[0]], held + r["n"]
    finally:
        docs.unpersist()
    feats, info = read_geojson(spark, path, upto=upto)
    first_k = feats.orderBy("id").limit(1000)
    bbox = first_k.agg(F.min("_xmin"), F.min("_ymin"), F.max("_xmax"), F.max("_ymax")).first()
    return {"fields": info["types"], "geometry_type": info["geometry_type"],
            "sample_rows": feats.orderBy("id").drop("geom").limit(5).collect(),
            "features": feats.orderBy("id").limit(100),
            "bbox": list(bbox) if bbox and bbox[0] is not None else None,
            "feature_count": total, "srid": None}
