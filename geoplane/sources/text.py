"""Header and value helpers of the import path (ING-1..5, ING-8, SCL-5) as Column expressions.

They work on DataFrames of header lines / header names / sample values, so
a drop folder of many files is profiled by one job rather than file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reserved column names; candidate separators in tie-break order.
RESERVED_COLUMNS = ("id", "geom")
SEPARATORS = (";", ",", "\t")
# Longitude / latitude header names by priority group.
LON_NAMES_BY_PRIORITY = (("longitude", "lon", "lng", "long"), ("x_wgs84",), ("x", "centroid_x"))
LAT_NAMES_BY_PRIORITY = (("latitude", "lat"), ("y_wgs84",), ("y", "centroid_y"))


# ---------------------------------------------------------------- ING-1
def sanitize_name(name) -> Column | str:
    """``[^a-zA-Z0-9_]`` -> ``_``, lower-case; ``id`` / ``geom`` get a ``_`` prefix."""
    if isinstance(name, Column):
        col = F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_"))
        return F.when(col.isin(*RESERVED_COLUMNS), F.concat(F.lit("_"), col)).otherwise(col)
    import re
    col = re.sub(r"[^a-zA-Z0-9_]", "_", name).lower()
    return "_" + col if col in RESERVED_COLUMNS else col


def table_name(name) -> Column | str:
    """Feature table name: ``data_`` + sanitised collection name."""
    if isinstance(name, Column):
        return F.concat(F.lit("data_"), F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_")))
    import re
    return "data_" + re.sub(r"[^a-zA-Z0-9_]", "_", name).lower()


# ---------------------------------------------------------------- ING-2
def strip_bom(text) -> Column | str:
    if isinstance(text, Column):
        return F.regexp_replace(text, "^\ufeff", "")
    return text[1:] if text[:1] == "\ufeff" else text


# ---------------------------------------------------------------- ING-3
def _count(h: Column, ch: str) -> Column:
    return F.length(h) - F.length(F.replace(h, F.lit(ch), F.lit("")))


def detect_separator(header) -> Column | str:
    """Most frequent of ``; , TAB`` in the header line; ties -> earlier in that order; none -> ``;``."""
    if isinstance(header, Column):
        counts = [_count(header, s) for s in SEPARATORS]
        best = F.greatest(*counts)
        out = F.when(best == 0, F.lit(";"))
        for s, c in zip(SEPARATORS, counts):
            out = out.when(c == best, F.lit(s))
        return out
    counts = [header.count(s) for s in SEPARATORS]
    best = max(counts)
    return ";" if best == 0 else SEPARATORS[counts.index(best)]


# ---------------------------------------------------------------- ING-4
def _ranks(groups: tuple[tuple[str, ...], ...]) -> dict[str, int]:
    return {name: rank for rank, group in enumerate(groups) for name in group}


def detect_geo_columns(headers: list[str]) -> tuple[str, str] | None:
    """One file's (lon header, lat header): the best-ranked name of each axis, the left-most of equals."""
    best = []
    for groups in (LON_NAMES_BY_PRIORITY, LAT_NAMES_BY_PRIORITY):
        rank = _ranks(groups)
        known = [(rank[key], at) for at, key in enumerate(h.strip().lower() for h in headers) if key in rank]
        best.append(headers[min(known)[1]] if known else None)
    return None if None in best else tuple(best)


def name_priority_table(spark) -> DataFrame:
    """(axis, name, priority) rows of the name groups (broadcast side of ING-4)."""
    rows = []
    for axis, groups in (("lon", LON_NAMES_BY_PRIORITY), ("lat", LAT_NAMES_BY_PRIORITY)):
        for prio, group in enumerate(groups):
            for name in group:
                rows.append((axis, name, prio))
    return spark.createDataFrame(rows, "axis string, name string, priority int")


def detect_geo_columns_df(headers: DataFrame, file_col: str = "file", pos_col: str = "pos",
                          header_col: str = "header") -> DataFrame:
    """ING-4 over many files: exploded (file, pos, header) rows -> (file, lon_column, lat_column).

    Within a priority group the left-most header wins; both axes are required.
    """
    spark = headers.sparkSession
    names = name_priority_table(spark)
    h = headers.withColumn("__key", F.lower(F.trim(F.col(header_col))))
    m = h.join(F.broadcast(names), h["__key"] == names["name"])
    best = m.groupBy(file_col, "axis").agg(F.min_by(F.col(header_col), F.struct("priority", pos_col)).alias("col"))
    lon = best.filter(F.col("axis") == "lon").select(file_col, F.col("col").alias("lon_column"))
    lat = best.filter(F.col("axis") == "lat").select(file_col, F.col("col").alias("lat_column"))
    return lon.join(lat, file_col, "inner")


# ---------------------------------------------------------------- ING-5
# A decimal number with an optional exponent.  A cast alone would also take the suffixes and
# names that the JVM reads as numbers (1D, 2F, NaN, Infinity).
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def is_number(v: Column) -> Column:
    """A non-empty text that reads as a number (JS ``Number`` without its hex / blank / Infinity quirks, D4)."""
    return v.rlike(NUMBER)


def number(v: Column) -> Column:
    """The finite double a text holds, else null."""
    x = F.when(is_number(v), v.try_cast("double"))
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def infer_type_aggs(value: Column, name: str) -> list[Column]:
    """Aggregates deciding INTEGER / DOUBLE PRECISION / TEXT for one sampled column."""
    nonempty = value.isNotNull() & (value != "")
    return [F.bool_and(F.when(nonempty, is_number(value))).alias(f"{name}__num"),
            F.bool_or(F.when(nonempty, value.rlike("[.eE]"))).alias(f"{name}__dot"),   # D4: 1e3 is DOUBLE
            F.count_if(nonempty).alias(f"{name}__n"),
            F.max(F.when(nonempty, F.abs(number(value)))).alias(f"{name}__max")]


def decide_type(num, dot, n, vmax) -> str:
    if n and num:
        if dot:
            return "DOUBLE PRECISION"
        return "BIGINT" if vmax is not None and vmax > 2147483647 else "INTEGER"   # D3 widening
    return "TEXT"


def infer_type_column(num: Column, dot: Column, n: Column) -> Column:
    """Column form of :func:`decide_type` (no overflow widening)."""
    return F.when((n > 0) & F.coalesce(num, F.lit(True)),
                  F.when(F.coalesce(dot, F.lit(False)), F.lit("DOUBLE PRECISION")).otherwise(F.lit("INTEGER"))
                  ).otherwise(F.lit("TEXT"))


SPARK_TYPE = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE PRECISION": "double", "TEXT": "string",
              "BOOLEAN": "boolean"}


# ---------------------------------------------------------------- ING-8
def coerce(value: Column, pg_type: str) -> Column:
    """``''`` -> null, then a safe cast to the inferred type (bad values -> null, D2)."""
    v = F.when(value != "", value)
    t = SPARK_TYPE.get(pg_type, "string")
    if t in ("string", "boolean"):
        return v if t == "string" else v.try_cast(t)
    return F.when(is_number(v), v.try_cast(t))


# ---------------------------------------------------------------- SCL-5
def csv_escape(value: Column) -> Column:
    """Quote a CSV field when it holds ``"``, ``,``, CR or LF; quotes are doubled; null -> empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def split_collection_id(cid: Column) -> tuple[Column, Column]:
    """``workspace:name`` split at the first colon; no colon -> both null (not found)."""
    has = F.instr(cid, ":") > 0
    ws = F.when(has, F.substring_index(cid, ":", 1))
    name = F.when(has, F.regexp_extract(cid, r"(?s)^[^:]*:(.*)$", 1))
    return ws, name
