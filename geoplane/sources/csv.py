"""CSV point import (SRC-3, SRC-10, ING-1..5, ING-7..9, ING-12, ING-14, AGG-13).

Flow: read the header line once (driver, one line), strip the BOM, detect or
take the separator and the lon/lat columns, read the file with Spark's CSV
source (quotes, doubled quotes, separators inside quotes; no multi-line
records, like the reference which splits lines first), infer column types
from the first ``sample`` rows (one bounded aggregate), coerce, build points,
skip rows whose coordinates do not parse (counted), number the kept rows in
file order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import text as TX
from .ids import FILE_PIECE, with_file_piece, with_sequential_id

# Fixed value: rows sampled for CSV type inference.
CSV_SAMPLE_ROWS = 100


@dataclass
class CsvPlan:
    separator: str
    headers: list[str]            # raw (BOM stripped, trimmed)
    columns: list[str]            # sanitised
    lon_column: str
    lat_column: str
    types: dict[str, str]         # sanitised column -> INTEGER / BIGINT / DOUBLE PRECISION / TEXT


def read_header(spark: SparkSession, path: str) -> str:
    """First non-blank line of the file (one line to the driver)."""
    lines = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not lines:
        raise ValueError("CSV file needs a header and at least one data row")
    return TX.strip_bom(lines[0]["value"])


def _read_rows(spark, path, sep, names) -> DataFrame:
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    df = (spark.read.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"')
          .option("multiLine", "false").option("ignoreLeadingWhiteSpace", "false")
          .option("ignoreTrailingWhiteSpace", "false").option("mode", "PERMISSIVE")
          .schema(schema).csv(path))
    return with_file_piece(df)


def plan_csv(spark: SparkSession, path: str, separator: str | None = None, lon: str | None = None,
             lat: str | None = None, sample: int = CSV_SAMPLE_ROWS) -> tuple[CsvPlan, DataFrame]:
    header = read_header(spark, path)
    sep = separator or TX.detect_separator(header)
    from .csvline import parse_line
    raw_headers = [h.strip() for h in parse_line(header, sep)]
    if lon or lat:
        if not (lon and lat) or lon not in raw_headers or lat not in raw_headers:
            raise ValueError(f"Longitude/latitude columns not found: {lon!r}, {lat!r}")
        geo = (lon, lat)
    else:
        geo = TX.detect_geo_columns(raw_headers)
        if geo is None:
            raise ValueError("Could not detect longitude/latitude columns")
    names = [TX.sanitize_name(h) for h in raw_headers]
    # blank lines are left out by the source; a line of separators only is a row like any other
    rows = _read_rows(spark, path, sep, names)
    lon_i, lat_i = raw_headers.index(geo[0]), raw_headers.index(geo[1])
    # type inference over the first `sample` data rows in file order: limit(n).collect() reads
    # the first split(s) only and returns rows in file order (<= sample rows to the driver)
    body = rows.drop(*FILE_PIECE)
    first = spark.createDataFrame(body.limit(sample).collect(), body.schema)
    aggs = []
    for i in range(len(names)):
        if i in (lon_i, lat_i):
            continue
        aggs += TX.infer_type_aggs(F.col(f"c{i}"), f"c{i}")
    types = {}
    if aggs:
        r = first.agg(*aggs).first()
        for i, n in enumerate(names):
            if i in (lon_i, lat_i):
                continue
            types[n] = TX.decide_type(r[f"c{i}__num"], r[f"c{i}__dot"], r[f"c{i}__n"], r[f"c{i}__max"])
    plan = CsvPlan(sep, raw_headers, names, geo[0], geo[1], types)
    return plan, rows


def read_csv_points(spark: SparkSession, path: str, separator: str | None = None, lon: str | None = None,
                    lat: str | None = None, srid: int = 4326, sample: int = CSV_SAMPLE_ROWS
                    ) -> tuple[DataFrame, DataFrame, CsvPlan]:
    """Import a CSV of points.  Returns (features, report, plan).

    ``features``: id (1..n in file order over kept rows), typed properties,
    ``geom`` (MultiPoint, tagged ``srid``, no reprojection) and bbox columns.
    ``report``: one row with imported / skipped row counts (AGG-13) and the
    number of values nulled because they did not fit their inferred type (D2).
    """
    plan, rows = plan_csv(spark, path, separator, lon, lat, sample)
    lon_i, lat_i = plan.headers.index(plan.lon_column), plan.headers.index(plan.lat_column)
    x, y = TX.number(F.trim(F.col(f"c{lon_i}"))), TX.number(F.trim(F.col(f"c{lat_i}")))
    ok = x.isNotNull() & y.isNotNull()
    props = [TX.coerce(F.col(f"c{i}"), plan.types[n]).alias(n)
             for i, n in enumerate(plan.columns) if i not in (lon_i, lat_i)]
    # D2: a non-empty value that does not fit its inferred type becomes null and is counted
    rejected = [(F.col(f"c{i}") != "") & TX.coerce(F.col(f"c{i}"), plan.types[n]).isNull()
                for i, n in enumerate(plan.columns) if i not in (lon_i, lat_i)]
    n_rejected = sum((r.cast("int") for r in rejected), F.lit(0))
    staged = rows.select(*FILE_PIECE, ok.alias("__ok"), x.alias("__x"), y.alias("__y"), n_rejected.alias("__rej"), *props)
    # AGG-13 / ING-19 counts: one aggregate row
    m = staged.agg(F.count_if("__ok").alias("imported"), F.count_if(~F.col("__ok")).alias("skipped"),
                   F.coalesce(F.sum(F.when(F.col("__ok"), F.col("__rej"))), F.lit(0)).cast("bigint")
                   .alias("rejected_values"))
    report = m.select("imported", "skipped", "rejected_values")
    kept = with_sequential_id(staged.filter("__ok").drop("__rej"), "id", order_by=FILE_PIECE)
    geom = G.point(F.col("__x"), F.col("__y"), srid, multi=True)
    feats = kept.select("id", *[p for p in plan.columns if p in plan.types], geom.alias("geom"),
                        F.col("__x").alias("_xmin"), F.col("__y").alias("_ymin"),
                        F.col("__x").alias("_xmax"), F.col("__y").alias("_ymax"))
    return feats, report, plan


def preview_csv(spark: SparkSession, path: str, separator: str | None = None, lon: str | None = None,
                lat: str | None = None, sample: int = CSV_SAMPLE_ROWS) -> dict:
    """SRC-10: fields (trimmed then sanitised headers) with types from <= 100 rows, 5 typed
    sample rows, points and bbox of the first 100 rows, separator, geo columns, type Point."""
    feats, report, plan = read_csv_points(spark, path, separator, lon, lat, sample=sample)
    first = feats.orderBy("id").limit(sample)
    bbox = first.agg(F.min("_xmin"), F.min("_ymin"), F.max("_xmax"), F.max("_ymax")).first()
    return {"separator": plan.separator, "lon_column": plan.lon_column, "lat_column": plan.lat_column,
            "fields": plan.types, "geometry_type": "Point",
            "sample_rows": first.drop("geom").limit(5).collect(), "points": first,
            "bbox": list(bbox) if bbox and bbox[0] is not None else None}
