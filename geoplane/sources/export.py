"""Sinks: GeoJSON / CSV export (SNK-1, SNK-2, SRT-5) and feature-table writes
(SNK-6, ING-15, ING-20).

Exports are row-wise string expressions written with ``write.text``: each
task writes its own part file, ordered by id within the export by a range
partitioning on the id (a global sort without a single task).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..plans import collection as C
from . import text as TX


def _filtered(coll, where: Column | None, bbox) -> DataFrame:
    return coll.df.filter(C.items_filter(coll, where, bbox=bbox))


def export_filter_columns(coll) -> list[str]:
    """Export filters may use every column but the geometry (items hide the id instead)."""
    return [c for c in coll.df.columns if c != coll.geometry_column]


def geojson_features(coll, where: Column | None = None, bbox=None) -> DataFrame:
    """SNK-1 rows: id + one GeoJSON Feature text per feature, geometry in 4326, exposed properties."""
    df = _filtered(coll, where, bbox)
    geom = G.to_geojson(C.output_geometry(coll, 4326))
    # id as JSON scalar: to_json of a one-field struct is {"v":<json>}, keep <json>
    idj = F.regexp_extract(F.to_json(F.struct(F.col(coll.id_column).alias("v")), {"ignoreNullFields": "false"}),
                           r'^\{"v":(.*)\}$', 1)
    feature = F.concat(F.lit('{"type":"Feature","id":'), idj, F.lit(',"geometry":'),
                       F.coalesce(geom, F.lit("null")), F.lit(',"properties":'), C.properties_json(coll), F.lit("}"))
    return df.select(F.col(coll.id_column).alias("id"), feature.alias("feature"))


def export_geojson(coll, path: str, where: Column | None = None, bbox=None, limit: int | None = None,
                   single_file: bool = False) -> None:
    """SNK-1: write features ordered by id.  Line-delimited by default; ``single_file``
    wraps the (limited) result in one FeatureCollection document."""
    rows = geojson_features(coll, where, bbox)
    if limit is not None:
        rows = rows.orderBy("id").limit(int(limit))
    else:
        rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    if single_file:
        if limit is not None:
            # bounded by the limit: one small document from one task
            doc = rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['),
                                    F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "feature"))),
                                                             lambda r: r["feature"]), ","), F.lit("]}")).alias("value"))
            doc.coalesce(1).write.mode("overwrite").text(path)
            return
        # unlimited: ordered part files that concatenate (in name order) into one document --
        # a header part, features with a leading comma except the first, a footer part.  The first
        # is told by its place (row 0 of partition 0), whatever the ids: a range partitioning's
        # bounds are keys of the data, so its first partition holds the least of them.
        spark = coll.df.sparkSession
        body = rows.select(F.when(F.monotonically_increasing_id() == 0, F.col("feature"))
                           .otherwise(F.concat(F.lit(","), F.col("feature"))).alias("value"))
        head = spark.createDataFrame([('{"type":"FeatureCollection","features":[',)], "value string")
        foot = spark.createDataFrame([("]}",)], "value string")
        head.unionByName(body).unionByName(foot).write.mode("overwrite").text(path)
        return
    rows.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def csv_lines(coll, where: Column | None = None, bbox=None) -> tuple[str, DataFrame]:
    """SNK-2: header ``id,<props>,geom_wkt`` and one escaped CSV line per feature."""
    df = _filtered(coll, where, bbox)
    props = coll.exposed_columns()
    header = ",".join(["id", *[alias for _, alias in props], "geom_wkt"])
    fields = [TX.csv_escape(F.col(coll.id_column))]
    types = dict(coll.df.dtypes)
    for src, _ in props:
        c = F.col(f"`{src}`")
        nested = types.get(src, "").startswith(("struct", "array", "map"))
        fields.append(TX.csv_escape(F.to_json(c) if nested else c))      # objects as JSON
    fields.append(TX.csv_escape(G.to_wkt(C.output_geometry(coll, 4326))))
    return header, df.select(F.col(coll.id_column).alias("id"), F.concat_ws(",", *fields).alias("line"))


def export_csv(coll, path: str, where: Column | None = None, bbox=None, limit: int | None = None) -> str:
    """SNK-2: CRLF-terminated CSV ordered by id; returns the header line.

    The header is written as its own first part file name-sorted before the
    data parts (``part-00000`` is the header).
    """
    header, lines = csv_lines(coll, where, bbox)
    if limit is not None:
        lines = lines.orderBy("id").limit(int(limit))
    else:
        lines = lines.repartitionByRange("id").sortWithinPartitions("id")
    spark = coll.df.sparkSession
    head = spark.createDataFrame([(-1, header)], "k int, value string")
    body = lines.select(F.lit(0).alias("k"), F.col("line").alias("value"))
    out = head.unionByName(body)
    out.select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)
    return header


# ---------------------------------------------------------------- SNK-6, ING-15, ING-20
def quadkey(x: Column, y: Column, level: int = 16) -> Column:
    """Morton-order key of a lon/lat point on a 2^level grid (spatial clustering sort key)."""
    n = float(1 << level)
    ix = F.least(F.greatest(F.floor((x + 180.0) / 360.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")
    iy = F.least(F.greatest(F.floor((y + 90.0) / 180.0 * n), F.lit(0)), F.lit(n - 1)).cast("long")
    key = F.lit(0).cast("long")
    for b in range(level):
        key = key.bitwiseOR(F.shiftleft(F.shiftright(ix, b).bitwiseAND(F.lit(1)), 2 * b))
        key = key.bitwiseOR(F.shiftleft(F.shiftright(iy, b).bitwiseAND(F.lit(1)), 2 * b + 1))
    return key


def write_feature_table(df: DataFrame, root: str, name: str, partitions: int | None = None,
                        version: str | None = None, srid: int = 4326, id_column: str = "id",
                        workspace: str | None = None) -> str:
    """Write a feature table as a new version directory and return its path.

    ING-20 (re-aim of the GIST index): rows are range-partitioned and sorted
    by a Morton key of the bbox centre, so each Parquet row group covers a
    compact area and its min/max statistics on ``_xmin.._ymax`` let bbox
    filters skip most of the file.  ING-15: a re-import writes a fresh
    version (never appends); readers switch by path, so a running query keeps
    its files.  A caller-given ``version`` makes the write idempotent (a
    replayed stream batch overwrites its own version, nothing else).
    """
    # D5: the table identity includes the workspace, so equal names in two workspaces never collide
    table = f"{workspace}/{name}" if workspace else name
    path = f"{root.rstrip('/')}/{table}/version-{version or uuid.uuid4().hex[:12]}"
    cx = (F.col("_xmin") + F.col("_xmax")) / 2
    cy = (F.col("_ymin") + F.col("_ymax")) / 2
    if int(srid) != 4326:                       # the key grid is in lon/lat whatever the storage SRID
        from ..functions.crs import transform_xy
        cx, cy = transform_xy(cx, cy, srid, 4326)
    keyed = df.withColumn("__qk", quadkey(cx, cy))
    keyed = keyed.repartitionByRange(partitions, "__qk") if partitions else keyed.repartitionByRange("__qk")
    writer = keyed.sortWithinPartitions("__qk").drop("__qk").write.mode("overwrite")
    if id_column in df.columns:
        # rows are clustered by location, so id lookups (SNK-4) skip row groups by bloom filter
        writer = (writer.option(f"parquet.bloom.filter.enabled#{id_column}", "true")
                  .option("parquet.bloom.filter.adaptive.enabled", "true"))     # sized to the data
    writer.parquet(path)
    return path
