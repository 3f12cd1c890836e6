"""Canonical data model.

A geometry is one struct for every kind::

    geom: struct<type:string, srid:int,
                 parts: array<array<array<struct<x:double,y:double>>>>>

``parts`` is part -> ring -> vertex.  Point = 1 part / 1 ring / 1 vertex,
LineString = 1 part / 1 ring, Polygon = 1 part with ring 0 the shell and the
rest holes, Multi* = n parts.  Next to it every feature table carries the
top-level doubles ``_xmin, _ymin, _xmax, _ymax`` so that Parquet min/max
statistics prune bbox searches and grid joins can work on plain columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

XY_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PARTS_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(XY_TYPE)))
GEOM_TYPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("srid", T.IntegerType()),
    T.StructField("parts", PARTS_TYPE),
])
GEOM_DDL = "struct<type:string,srid:int,parts:array<array<array<struct<x:double,y:double>>>>>"

BBOX_COLUMNS = ("_xmin", "_ymin", "_xmax", "_ymax")

POINT_TYPES = ("Point", "MultiPoint")
LINE_TYPES = ("LineString", "MultiLineString")
POLYGON_TYPES = ("Polygon", "MultiPolygon")
GEOMETRY_TYPES = POINT_TYPES + LINE_TYPES + POLYGON_TYPES

# JSON-schema type per column type, as published by the
# queryables document, and the PostgreSQL type names reported by the
# column profile.
JSON_TYPE_BY_SPARK = {
    "int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer",
    "double": "number", "float": "number", "decimal": "number",
    "boolean": "boolean",
    "string": "string",
    "date": "string", "timestamp": "string", "timestamp_ntz": "string",
}
PG_TYPE_BY_SPARK = {
    "int": "integer", "bigint": "bigint", "smallint": "smallint", "tinyint": "smallint",
    "double": "double precision", "float": "real", "decimal": "numeric",
    "boolean": "boolean", "string": "text", "date": "date",
    "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone",
}
NUMERIC_SPARK_TYPES = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")


def type_key(dt: T.DataType) -> str:
    """Short type name used as the key of the maps above (decimal(p,s) -> decimal)."""
    name = dt.simpleString()
    return name.split("(")[0]


def json_type(dt: T.DataType) -> str:
    return JSON_TYPE_BY_SPARK.get(type_key(dt), "string")


def pg_type(dt: T.DataType) -> str:
    return PG_TYPE_BY_SPARK.get(type_key(dt), type_key(dt))


def is_numeric(dt: T.DataType) -> bool:
    return type_key(dt) in NUMERIC_SPARK_TYPES
