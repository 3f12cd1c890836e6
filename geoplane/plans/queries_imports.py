"""Registered queries of the import path, the catalog views and large polygons.

The import queries write the driver's tables as CSV or GeoJSON files below the
session's shared folder, import them with the library's readers, and compare
with the tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as CT
from ..operators import classify as CL
from ..operators import joins as J
from ..operators import mvt as MV
from ..operators import profile as PF
from ..operators import tiles as TL
from ..session import ensure_checkpoint_dir
from ..sources import csv as CSVS
from ..sources import detect
from ..sources import geojson as GJ
from ..sources import text as TX
from ..sources.csvline import split_fields
from ..sources.export import write_feature_table
from ..streaming import streams as ST
from . import collection as C
from . import tables as T
from .queries import _H, CUST, LINE, ORD, query, s_geojson_point, s_tiles


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/imports/{name}-{uuid.uuid4().hex[:8]}"


# ============================================================ CSV files (SRC-3, ING-9, ING-14, AGG-13, SRC-8, SRC-10)
_SMALL = 37        # customers of the first, smaller file
_CSV_ROWS = f"""(SELECT c_custkey AS k, c_custkey % 29 = 0 AS blank, CAST(c_custkey AS VARCHAR) AS code, c_name AS name,
  CAST({T.lon_sql('c_custkey')} AS VARCHAR) AS lon,
  CASE WHEN c_custkey % 17 = 0 THEN 'abc' ELSE CAST({T.lat_sql('c_custkey')} AS VARCHAR) END AS lat, c_nationkey AS nation
  FROM customer)"""


def _csv_folder(spark, sf_dir) -> str:
    """Two folders of CSV files: a few customers in the first by name, all others in larger files."""
    c = T.read(spark, sf_dir, "customer")
    blank = F.col("c_custkey") % 29 == 0
    lat = F.when(F.col("c_custkey") % 17 == 0, F.lit("abc")).otherwise(F.expr(T.lat_sql("c_custkey")).cast("string"))
    cols = {"code": F.col("c_custkey").cast("string"), "Name": F.col("c_name"),
            "Longitude": F.expr(T.lon_sql("c_custkey")).cast("string"), "lat": lat,
            "nation id": F.col("c_nationkey").cast("string")}
    rows = c.select("c_custkey", *[F.when(~blank, v).alias(k) for k, v in cols.items()])
    base = _folder(spark, "csv")
    for name, part in (("a", F.col("c_custkey") <= _SMALL), ("b", F.col("c_custkey") > _SMALL)):
        out = rows.filter(part).repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").drop("c_custkey")
        out.write.option("header", "true").option("sep", ";").option("emptyValue", "").csv(f"{base}/{name}")
    return f"{base}/*"


def _src3(spark, sf_dir):
    feats, _, _ = CSVS.read_csv_points(spark, _csv_folder(spark, sf_dir))
    return feats.select("id", "code", "name", "nation_id", F.round("_xmin", 6).alias("x"),
                        F.col("geom.srid").alias("srid"), F.col("geom.type").alias("geometry_type"))


query("src3_ing9_ing12_ing14_csv_import", f"""SELECT row_number() OVER (ORDER BY k) AS id, CAST(code AS INTEGER) AS code, name,
  CAST(nation AS INTEGER) AS nation_id, round(CAST(lon AS DOUBLE), 6) AS x, CAST(4326 AS INTEGER) AS srid, 'MultiPoint' AS geometry_type
FROM {_CSV_ROWS} WHERE NOT blank AND lat <> 'abc'""")(_src3)


def _agg13(spark, sf_dir):
    _, report, _ = CSVS.read_csv_points(spark, _csv_folder(spark, sf_dir))
    return report


query("agg13_csv_import_report", f"""SELECT count(*) FILTER (WHERE NOT blank AND lat <> 'abc') AS imported,
  count(*) FILTER (WHERE blank OR lat = 'abc') AS skipped, CAST(0 AS BIGINT) AS rejected_values FROM {_CSV_ROWS}""")(_agg13)


def _src10(spark, sf_dir):
    p = CSVS.preview_csv(spark, _csv_folder(spark, sf_dir))
    rows = [(k, v, p["separator"], p["lon_column"], p["lat_column"], len(p["sample_rows"]), *p["bbox"])
            for k, v in p["fields"].items()]
    return spark.createDataFrame(rows, "field string, type string, separator string, lon_column string, lat_column string, "
                                       "sample_rows int, xmin double, ymin double, xmax double, ymax double")


_PREVIEW = f"(SELECT * FROM {_CSV_ROWS} WHERE NOT blank AND lat <> 'abc' ORDER BY k LIMIT 100)"
query("src10_csv_preview", " UNION ALL ".join(f"""SELECT '{f}' AS field, '{t}' AS type, ';' AS separator,
  'Longitude' AS lon_column, 'lat' AS lat_column, CAST(5 AS INTEGER) AS sample_rows, min(CAST(lon AS DOUBLE)) AS xmin,
  min(CAST(lat AS DOUBLE)) AS ymin, max(CAST(lon AS DOUBLE)) AS xmax, max(CAST(lat AS DOUBLE)) AS ymax FROM {_PREVIEW}"""
                                              for f, t in (("code", "INTEGER"), ("name", "TEXT"), ("nation_id", "INTEGER"))))(_src10)


_BUCKET = 20       # customer keys of a file to check


def _src8(spark, sf_dir):
    """A CSV file for every 20 customer keys; by turns whole, a header alone, a header and blank lines, and nothing."""
    c = T.read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.floor(F.col("c_custkey") / _BUCKET).alias("file"))
    rows = F.transform(F.sort_array(F.collect_list("c_name")), lambda v: F.concat(v, F.lit(",2.5,48.5")))   # _BUCKET at most
    head = F.lit("name,lon,lat")
    text = c.groupBy("file").agg(
        F.when(F.col("file") % 4 == 0, F.array_join(F.concat(F.array(head), rows), "\n"))
        .when(F.col("file") % 4 == 1, head).when(F.col("file") % 4 == 2, F.concat(head, F.lit("\n  \n\n")))
        .otherwise(F.lit("")).alias("value"))
    base = _folder(spark, "checks")
    text.repartition(8, "file").write.partitionBy("file").text(base)
    checked = detect.check_csv_files(spark, base, recursive=True)
    return checked.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("bigint").alias("file"), "n_lines", "ok", "reason")


query("src8_csv_file_checks", f"""SELECT file, CAST(n AS BIGINT) AS n_lines, n > 1 AS ok,
  CASE WHEN n < 2 THEN '{detect.TOO_SHORT}' END AS reason FROM (
  SELECT CAST(c_custkey // {_BUCKET} AS BIGINT) AS file, CASE WHEN c_custkey // {_BUCKET} % 4 = 0 THEN count(*) + 1
    WHEN c_custkey // {_BUCKET} % 4 = 3 THEN 0 ELSE 1 END AS n FROM customer GROUP BY c_custkey // {_BUCKET})""")(_src8)


# ============================================================ GeoJSON documents (SRC-1, SRC-2, SRC-9, ING-6)
_DOC = 500         # features of a document


def _geojson_folder(spark, sf_dir, compression: str | None = None) -> str:
    """One FeatureCollection document for every 500 customer keys."""
    c = T.customers(spark, sf_dir).df
    num = lambda v: v.cast("string")
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), num(F.col("_xmin")), F.lit(","),
        num(F.col("_ymin")), F.lit(']},"properties":'),
        F.to_json(F.struct(F.col("c_name").alias("Full Name"), F.col("c_nationkey").alias("nation"),
                           F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("good"))), F.lit("}"))
    doc = F.format_string("%08d", F.floor(F.col("id") / _DOC))
    docs = c.select(doc.alias("doc"), "id", feature.alias("f")).groupBy("doc").agg(          # _DOC features at most
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "f"))), lambda r: r["f"]), ",").alias("body"))
    out = docs.select("doc", F.concat(F.lit('{"type":"FeatureCollection","features":['), "body", F.lit("]}")).alias("value"))
    base = _folder(spark, "geojson")
    writer = out.write.partitionBy("doc")
    (writer.option("compression", compression) if compression else writer).text(base)
    return base


def _src1(compression):
    def run(spark, sf_dir):
        feats, info = GJ.read_geojson(spark, _geojson_folder(spark, sf_dir, compression))
        return feats.select("id", "full_name", "nation", "balance", "good", F.col("geom.type").alias("geometry_type"),
                            F.lit(info["geometry_type"]).alias("collection_type"))
    return run


_SRC1 = """SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_name AS full_name, CAST(c_nationkey AS INTEGER) AS nation,
  CAST(c_acctbal AS DOUBLE) AS balance, c_acctbal > 0 AS good, 'MultiPoint' AS geometry_type, 'MultiPoint' AS collection_type
FROM customer"""
query("src1_geojson_documents", _SRC1)(_src1(None))
query("src2_gzip_geojson_documents", _SRC1)(_src1("gzip"))


def _src9(spark, sf_dir):
    p = GJ.preview_geojson(spark, _geojson_folder(spark, sf_dir))
    rows = [(k, v, p["geometry_type"], p["feature_count"], len(p["sample_rows"]), p["bbox"][0], p["bbox"][3])
            for k, v in p["fields"].items()]
    return spark.createDataFrame(rows, "field string, type string, geometry_type string, feature_count bigint, "
                                       "sample_rows int, xmin double, ymax double")


_FIRST = "(SELECT * FROM customer ORDER BY c_custkey LIMIT 1)"
_BALANCE_TYPE = f"(SELECT CASE WHEN c_acctbal = floor(c_acctbal) THEN 'INTEGER' ELSE 'DOUBLE PRECISION' END FROM {_FIRST})"
query("src9_ing6_geojson_preview", " UNION ALL ".join(
    f"""SELECT '{f}' AS field, {t} AS type, 'MultiPoint' AS geometry_type, (SELECT count(*) FROM customer) AS feature_count,
  CAST(5 AS INTEGER) AS sample_rows, min(x) AS xmin, max(y) AS ymax FROM (SELECT * FROM {CUST} ORDER BY id LIMIT 1000)"""
    for f, t in (("full_name", "'TEXT'"), ("nation", "'INTEGER'"), ("balance", _BALANCE_TYPE), ("good", "'BOOLEAN'"))))(_src9)


# ============================================================ header, line and value helpers
def _src7(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    base = _folder(spark, "formats")
    csv = F.col("c_mktsegment").isin("BUILDING", "FURNITURE")
    c.filter(csv).write.partitionBy("c_mktsegment").csv(base)
    c.filter(~csv).write.mode("append").partitionBy("c_mktsegment").json(base)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    found = detect.formats_of(listing)
    return found.select(F.regexp_extract("path", "c_mktsegment=([^/]*)/", 1).alias("segment"), "format").distinct()


query("src7_format_detection", """SELECT DISTINCT c_mktsegment AS segment,
  CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'csv' ELSE 'geojson' END AS format FROM customer""")(_src7)


def _ing2(spark, sf_dir):
    p = T.read(spark, sf_dir, "part")
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("﻿"), "p_name")).otherwise(
        F.concat("p_name", F.lit("﻿")))
    return p.select(F.col("p_partkey").alias("id"), TX.strip_bom(line).alias("header"))


query("ing2_bom", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || chr(65279) END AS header
FROM part""")(_ing2)

# header names by supplier key: five shapes
_HEADERS = (("Name", " LAT ", "Lng", "x"), ("X_L93", "Y_L93"), ("x", "y", "X_WGS84", "Y_WGS84"),
            ("centroid_x", "centroid_y"), ("latitude", "id"))


def _ing4(spark, sf_dir):
    s = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"))
    shapes = F.array(*[F.array(*[F.lit(h) for h in hs]) for hs in _HEADERS])
    rows = s.select("file", F.posexplode(F.element_at(shapes, (F.col("file") % 5 + 1).cast("int"))).alias("pos", "header"))
    return TX.detect_geo_columns_df(rows)


query("ing4_geo_columns", """SELECT s_suppkey AS file,
  CASE s_suppkey % 5 WHEN 0 THEN 'Lng' WHEN 2 THEN 'X_WGS84' ELSE 'centroid_x' END AS lon_column,
  CASE s_suppkey % 5 WHEN 0 THEN ' LAT ' WHEN 2 THEN 'Y_WGS84' ELSE 'centroid_y' END AS lat_column
FROM supplier WHERE s_suppkey % 5 IN (0, 2, 3)""")(_ing4)


def _ing7(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer")
    q = lambda v: F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    said = F.concat(F.lit('say "'), "c_mktsegment", F.lit('"; then'))
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), q(said), F.lit(""), q(F.col("c_name")))
    f = split_fields(line, ";", 4)
    return c.select(f[0].alias("a"), f[1].alias("b"), f[2].alias("c"), f[3].alias("d"))


query("ing7_quoted_fields", """SELECT CAST(c_custkey AS VARCHAR) AS a, 'say "' || c_mktsegment || '"; then' AS b, '' AS c, c_name AS d
FROM customer""")(_ing7)


def _ing8(spark, sf_dir):
    o = T.read(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(
        (F.col("o_orderkey") * 4).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), TX.coerce(raw, "INTEGER").alias("i"),
                    TX.coerce(F.concat(raw, F.lit(".5")), "DOUBLE PRECISION").alias("d"), TX.coerce(raw, "TEXT").alias("t"))


_RAW8 = "(CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE CAST(o_orderkey * 4 AS VARCHAR) END)"
query("ing8_coercion", f"""SELECT o_orderkey AS id, TRY_CAST(nullif({_RAW8}, '') AS INTEGER) AS i,
  TRY_CAST({_RAW8} || '.5' AS DOUBLE) AS d, nullif({_RAW8}, '') AS t FROM orders""")(_ing8)


# ============================================================ tables and features
def _snk6(spark, sf_dir):
    """A table written, re-imported with fewer rows as a new version, and read back."""
    c, root = T.customers(spark, sf_dir), _folder(spark, "tables")
    write_feature_table(c.df, root, "customers", version="1")
    path = write_feature_table(c.df.filter("c_acctbal > 0"), root, "customers", version="2")
    back = C.register_collection(spark.read.parquet(path), "customers")
    return back.df.select("id", "c_name", "c_acctbal", F.col("_xmin").alias("x"), F.col("geom.type").alias("geometry_type"))


query("snk6_ing15_ing20_src6_table_write", f"SELECT id, c_name, c_acctbal, x, 'Point' AS geometry_type FROM {CUST} WHERE c_acctbal > 0")(_snk6)


def _snk4(spark, sf_dir):
    c = T.customers(spark, sf_dir)
    c.exposed_fields = [("c_name", "name")]
    return C.feature_by_id(c, 42)


query("snk4_feature_by_id", f"SELECT id, c_name AS name, {s_geojson_point('x', 'y')} AS geometry FROM {CUST} WHERE id = 42")(_snk4)


def _pag1_end(spark, sf_dir):
    """The last page of the orders: its offset is the row count, rounded down to a page."""
    c = T.orders(spark, sf_dir)
    c.exposed_fields = [("o_orderstatus", "status")]
    n = c.df.count()
    return C.items(c, limit=10, offset=max(n - 7, 0)).page


query("pag1_last_page", f"""SELECT id, o_orderstatus AS status, {s_geojson_point('x', 'y')} AS geometry FROM {ORD}
ORDER BY id OFFSET (SELECT greatest(count(*) - 7, 0) FROM orders) LIMIT 10""")(_pag1_end)


# ============================================================ metadata views
def _prj4(spark, sf_dir):
    c = T.customers(spark, sf_dir)
    c.exposed_fields = [("c_name", "name"), ("c_acctbal", None), ("c_nationkey", "nation"), ("gone", "lost")]
    types = spark.createDataFrame(C.exposed_columns_with_types(c), "name string, column_type string")
    counts = PF.column_profile(c.df.select(*C.project_properties(c))).select(
        F.col("column_name").alias("name"), "non_null_count")
    return C.queryables(c).join(types, "name", "left").join(counts, "name", "left")


query("prj3_prj4_queryables", """SELECT name, title, type, column_type, CASE k WHEN 1 THEN (SELECT count(*) FROM customer) WHEN 2 THEN 0 END AS non_null_count
FROM (VALUES ('geometry', 'geometry', 'geometry', NULL, 0), ('name', 'name', 'string', 'string', 1),
  ('c_acctbal', 'c_acctbal', 'number', (SELECT CASE typeof(c_acctbal) WHEN 'DOUBLE' THEN 'double' ELSE lower(typeof(c_acctbal)) END FROM customer LIMIT 1), 1),
  ('nation', 'nation', 'integer', (SELECT CASE typeof(c_nationkey) WHEN 'BIGINT' THEN 'bigint' ELSE 'int' END FROM customer LIMIT 1), 1),
  ('lost', 'lost', 'string', 'string', 2)) t(name, title, type, column_type, k)""")(_prj4)


def _prj8(spark, sf_dir):
    c = T.catalog_collections(spark, sf_dir)
    c = c.withColumn("description", F.concat(F.lit("orders of "), F.col("name"))).withColumn(
        "temporal_start", F.col("created_at")).withColumn("temporal_end", F.col("updated_at"))
    v = CT.collection_view(c, T.workspaces(spark, sf_dir), "/api")
    return v.select("id", "title", "description", "item_type", F.col("extent_bbox")[0].alias("xmin"),
                    F.col("temporal_interval")[0].alias("starts"), F.size("links").alias("n_links"),
                    F.col("links")[1]["href"].alias("items_href"))


query("prj8_collection_view", f"""SELECT w.name || ':' || c.name AS id, c.name AS title, 'orders of ' || c.name AS description,
  'feature' AS item_type, c.xmin, c.created_at AS starts, CAST(4 AS INTEGER) AS n_links,
  '/api/collections/' || w.name || ':' || c.name || '/items' AS items_href
FROM {T.CATALOG_COLLECTIONS_SQL} c JOIN {T.WORKSPACES_SQL} w ON w.id = c.workspace_id""")(_prj8)


def _prj9(spark, sf_dir):
    t = CT.tileset_metadata(T.catalog_collections(spark, sf_dir), T.workspaces(spark, sf_dir), "/api")
    return t.select("id", "url", F.col("bounding_box")[0].alias("xmin"), F.col("bounding_box")[3].alias("ymax"))


query("prj9_tileset_metadata", f"""SELECT w.name || ':' || c.name AS id,
  '/api/collections/' || w.name || ':' || c.name || '/tiles/{{z}}/{{x}}/{{y}}.pbf' AS url, c.xmin, c.ymax
FROM {T.CATALOG_COLLECTIONS_SQL} c JOIN {T.WORKSPACES_SQL} w ON w.id = c.workspace_id""")(_prj9)


def _agg3(spark, sf_dir):
    rows = []
    for c in (T.customers(spark, sf_dir), T.nations(spark, sf_dir)):
        p = PF.geometry_profile(c)
        rows.append(c.df.agg(F.count(F.lit(1)).alias("features")).select(
            F.lit(c.name).alias("collection"), *[F.lit(p[k]).alias(k) for k in ("column_name", "geometry_type", "srid")], "features"))
    return rows[0].unionByName(rows[1])


query("agg3_geometry_profile", """SELECT 'customers' AS collection, 'geom' AS column_name, 'Point' AS geometry_type,
  CAST(4326 AS INTEGER) AS srid, (SELECT count(*) FROM customer) AS features
UNION ALL SELECT 'nations', 'geom', 'Polygon', CAST(4326 AS INTEGER), (SELECT count(*) FROM nation)""")(_agg3)


def _agg2_empty(spark, sf_dir):
    none = T.read(spark, sf_dir, "customer").filter("c_custkey < 0").select("c_custkey", "c_name", "c_mktsegment")
    return PF.column_profile(none).select("total_count", "ordinal", "column_name", "non_null_count", "null_count",
                                          "distinct_count", "min_value")


query("agg2_profile_of_no_rows", " UNION ALL ".join(
    f"""SELECT count(*) AS total_count, CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, count({c}) AS non_null_count,
  count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value
  FROM customer WHERE c_custkey < 0""" for i, c in enumerate(("c_custkey", "c_name", "c_mktsegment"))))(_agg2_empty)


def _til1(spark, sf_dir):
    """The tile matrix of each zoom with the number of its tiles that hold customers."""
    used = TL.assign_tiles(T.customers(spark, sf_dir), range(0, 7)).select("z", "x", "y").distinct().groupBy("z").agg(
        F.count(F.lit(1)).alias("n_used"))
    m = TL.tile_matrix(spark, 6).join(used, "z", "left")
    return m.select("z", F.round("scale_denominator", 6).alias("scale_denominator"), F.round("cell_size", 6).alias("cell_size"),
                    "matrix_width", "tile_width", (F.coalesce("n_used", F.lit(0)) > 0).alias("used"))


query("til1_tile_matrix", """SELECT CAST(z AS INTEGER) AS z, round(559082264.0287178 / pow(2, z), 6) AS scale_denominator,
  round(2 * 20037508.3427892 / (pow(2, z) * 256), 6) AS cell_size, CAST(pow(2, z) AS BIGINT) AS matrix_width,
  CAST(256 AS INTEGER) AS tile_width, (SELECT count(*) FROM customer) > 0 AS used FROM range(0, 7) t(z)""")(_til1)


# ============================================================ styles
def _cls6(spark, sf_dir):
    """More segments and priorities than stops: colours between the stops, by category rank."""
    cats = PF.distinct_values(T.read(spark, sf_dir, "part"), "p_size", 9)
    colors = CL.interpolate_palette(("#000000", "#646464", "#c8c8c8"), cats.count())
    ranked = [(r["value"], i, c) for i, (r, c) in enumerate(zip(cats.collect(), colors))]      # nine at most
    return spark.createDataFrame(ranked, "value int, rank int, color string")


query("cls6_interpolated_palette", """SELECT CAST(value AS INTEGER) AS value, CAST(rank AS INTEGER) AS rank,
  '#' || h || h || h AS color FROM (SELECT *, lpad(lower(hex(CAST(floor(rank * 200.0 / (n - 1) + 0.5) AS INTEGER))), 2, '0') AS h
  FROM (SELECT p_size AS value, row_number() OVER (ORDER BY p_size) - 1 AS rank, count(*) OVER () AS n
        FROM (SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 9)))""")(_cls6)


def _cls7(spark, sf_dir):
    df = T.read(spark, sf_dir, "customer")
    classes = CL.with_colors(CL.graduated(df, "c_acctbal", 4, method="equal_interval"), "blues")
    cats = CL.categorized(df, "c_mktsegment")
    colored = CL.interpolate_palette("qualitative", 50)
    by_rank = F.array(*[F.lit(c) for c in colored])
    from pyspark.sql import Window
    ranked = cats.withColumn("color", F.get(by_rank, F.row_number().over(Window.orderBy("value")) - 1))   # 50 at most
    return CL.legend_frame(spark, classes).unionByName(CL.category_legend(ranked)).select("kind", "position", "label")


query("cls7_legends", """SELECT 'class' AS kind, CAST(i AS INTEGER) AS position,
  printf('%.2f', lo + i * (hi - lo) / 4) || ' – ' || printf('%.2f', CASE WHEN i = 3 THEN hi ELSE lo + (i + 1) * (hi - lo) / 4 END) AS label
FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), range(0, 4) t(i)
UNION ALL SELECT 'category', CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER), c_mktsegment
FROM (SELECT DISTINCT c_mktsegment FROM customer)""")(_cls7)


# ============================================================ JN-7 / STR-4: polygons of 66 vertices, text ids, points on edges
_TEETH = 16


def combs(spark, sf_dir) -> C.Collection:
    """A comb for each nation: a 32 x 2 bar with 16 teeth of 1 x 2 on it (67 vertices, exact in binary)."""
    n = T.read(spark, sf_dir, "nation")
    x0, y0 = (F.col("n_nationkey") % 5) * 40.0 - 100.0, F.floor(F.col("n_nationkey") / 5) * 8.0
    top = [(0, 0), (32, 0), (32, 2)]
    for k in reversed(range(_TEETH)):
        top += [(2 * k + 2, 4), (2 * k + 1, 4), (2 * k + 1, 2), (2 * k, 2)] if k == _TEETH - 1 else \
               [(2 * k + 2, 2), (2 * k + 2, 4), (2 * k + 1, 4), (2 * k + 1, 2), (2 * k, 2)]
    ring = F.array(*[F.struct((x0 + F.lit(float(a))).alias("x"), (y0 + F.lit(float(b))).alias("y")) for a, b in [*top, (0, 0)]])
    geom = F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts"))
    df = n.select(F.concat(F.lit("comb-"), F.col("n_nationkey").cast("string")).alias("id"), geom.alias("geom"),
                  x0.alias("_xmin"), y0.alias("_ymin"), (x0 + 32.0).alias("_xmax"), (y0 + 4.0).alias("_ymax"))
    return C.Collection(df, name="combs", geometry_type="Polygon")


def _probe(key: str) -> tuple[str, str]:
    """Points on a grid of quarters: many lie on edges and vertices."""
    return (f"(({key}) % 5 * 40.0 - 100.0 + CAST((({key}) * 7919) % 137 AS DOUBLE) / 4.0 - 1.0)",
            f"(FLOOR((({key}) % 25) / 5) * 8.0 + CAST((({key}) * 104729) % 23 AS DOUBLE) / 4.0 - 0.5)")


def _comb_sql(table: str, key: str) -> str:
    x, y = _probe(key)
    x0, y0 = "(n.n_nationkey % 5 * 40.0 - 100.0)", "(FLOOR(n.n_nationkey / 5) * 8.0)"
    return f"""SELECT p.pid, 'comb-' || n.n_nationkey AS id FROM (SELECT {key} AS pid, {x} AS x, {y} AS y FROM {table}) p
JOIN nation n ON p.x BETWEEN {x0} AND {x0} + 32 AND p.y BETWEEN {y0} AND {y0} + 4
WHERE p.y <= {y0} + 2 OR CAST(floor(p.x - {x0}) AS BIGINT) % 2 = 1 OR (p.x - {x0} = floor(p.x - {x0}) AND p.x > {x0} + 0.5)"""


def _jn7_combs(spark, sf_dir):
    x, y = _probe("o_orderkey")
    pts = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), F.expr(x).alias("x"), F.expr(y).alias("y"))
    return J.batch_point_lookup(combs(spark, sf_dir), pts)


query("jn7_large_polygons_text_ids", _comb_sql("orders", "o_orderkey"))(_jn7_combs)


def _str4_combs(spark, sf_dir):
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    raw = (spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1)
           .option("pathGlobFilter", "events*.parquet").parquet(sf_dir.rstrip("/")))
    x, y = _probe("event_id")
    s = raw.select(F.col("event_id").alias("pid"), F.expr(x).alias("x"), F.expr(y).alias("y"))
    out = ST.run_available_now(ST.stream_point_lookup(combs(spark, sf_dir), s),
                               f"{ST.checkpoint_location(spark, 'str4c')}-sink", name="str4c")
    return spark.read.parquet(out)


query("str4_stream_large_polygons", _comb_sql("events", "event_id"))(_str4_combs)


# ============================================================ TIL-5 / AGG-12: what the tile bytes say
def _varints(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def part_values(values: bytes) -> list[str]:
    """The texts of the value messages of a tile part."""
    out, i, n = [], 0, len(values)
    while i < n:
        at = i + 1
        while values[at] > 127:                 # length of the message
            at += 1
        at += 2                                 # and the key of its text
        start = at
        while values[at] > 127:
            at += 1
        size = _varints(values[start:at + 1])[0] if at > start else values[start]
        i = at + 1 + size
        out.append(values[at + 1:i].decode())
    return out


def part_features(features: bytes):
    """All varints of a tile part's features, and for each feature the positions where its tags start and
    end and where its commands start and end."""
    import numpy as np
    raw = np.frombuffer(features, dtype=np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    which = np.concatenate([[0], np.cumsum(last)])               # byte -> varint that holds it
    shift = 7 * (np.arange(len(raw)) - starts[which[:-1]])
    v = np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)
    body, at, total = [], 0, len(raw)
    numbers, first, place = v.tolist(), starts.tolist(), which.tolist()
    while at < total:                                            # feature by feature: key, length, body
        k = place[at] + 2
        body.append(k)
        at = first[k] + numbers[k - 1]
    body = np.array(body, dtype=np.int64)
    tagged = v[body] == 0x12
    tag0 = np.where(tagged, body + 2, body)
    tag1 = np.where(tagged, which[np.where(tagged, starts[tag0] + v[body + 1], 0)], body)
    geom0 = tag1 + 4                                             # after the kind and the key and length of the geometry
    geom1 = which[starts[geom0] + v[geom0 - 1]]
    return v, tag0, tag1, geom0, geom1


def decoded_part(features: bytes, values: bytes, first_value: int, props: list[str]) -> tuple[int, int, int, float, int]:
    """Features, sums of their point coordinates, sum of ``qty`` and number of ``flag`` R of a part of a tile."""
    import numpy as np
    if not features:
        return 0, 0, 0, 0.0, 0
    v, tag0, tag1, geom0, _ = part_features(features)
    texts = part_values(values)
    xy = [(v[geom0 + k] >> 1) ^ -(v[geom0 + k] & 1) for k in (1, 2)]
    qty, returned = 0.0, 0
    for pair in range(int((tag1 - tag0).max(initial=0)) // 2):
        at = tag0[tag0 + 2 * pair < tag1] + 2 * pair
        for key, value in zip(v[at].tolist(), (v[at + 1] - first_value).tolist()):
            if props[key] == "qty":
                qty += float(texts[value])
            elif props[key] == "flag":
                returned += texts[value] == "R"
    return len(tag0), int(np.sum(xy[0])), int(np.sum(xy[1])), qty, returned


def _til5_decoded(spark, sf_dir):
    import pandas as pd
    li = T.lineitems(spark, sf_dir)
    li.exposed_fields = [("l_returnflag", "flag"), ("l_quantity", "qty")]
    names = ["n_features", "sum_x", "sum_y", "sum_qty", "n_returned"]

    def run(batches):
        for b in batches:
            rows = [decoded_part(bytes(f), bytes(v), k, ["flag", "qty"])
                    for f, v, k in zip(b["features"], b["values"], b["first_value"])]
            yield pd.concat([b[["z", "x", "y"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    read = MV.tile_parts(li, range(3, 9)).mapInPandas(
        run, "z int, x bigint, y bigint, n_features bigint, sum_x bigint, sum_y bigint, sum_qty double, n_returned bigint")
    return read.groupBy("z", "x", "y").agg(*[F.sum(n).alias(n) for n in names]).filter("n_features > 0")


_QX = f"CAST(floor((mx - (x * w - {_H})) / w * 4096 + 0.5) AS BIGINT)"
_QY = f"CAST(floor(({_H} - y * w - my) / w * 4096 + 0.5) AS BIGINT)"
query("til5_agg12_decoded_tiles", f"""SELECT z, x, y, count(*) AS n_features, CAST(sum({_QX}) AS BIGINT) AS sum_x, CAST(sum({_QY}) AS BIGINT) AS sum_y,
  CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
FROM {s_tiles(LINE, range(3, 9), 'l_returnflag, l_quantity')} GROUP BY z, x, y""")(_til5_decoded)
