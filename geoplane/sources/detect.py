"""Format routing and file checks (SRC-7, SRC-8) for the import entry points."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as TX


def detect_format(path: str, head: bytes | None = None) -> str:
    """SRC-7: ``.csv`` -> csv, ``.zip`` or ZIP magic ``PK`` -> shapefile, else GeoJSON."""
    p = path.lower()
    if p.endswith(".csv"):
        return "csv"
    if p.endswith(".zip") or (head is not None and head[:2] == b"PK"):
        return "shapefile"
    return "geojson"


def format_of(spark: SparkSession, path: str) -> str:
    """SRC-7 for one file: its first two bytes are read only when the name does not decide."""
    by_name = detect_format(path)
    if by_name != "geojson":
        return by_name
    from .geojson import head_bytes
    return detect_format(path, head_bytes(spark, path))


def formats_of(listing: DataFrame) -> DataFrame:
    """SRC-7 over a file listing (``binaryFile`` rows): path -> format, using the
    first bytes only when the extension does not decide."""
    p = F.lower(F.col("path"))
    magic = F.substring(F.col("content"), 1, 2) if "content" in listing.columns else F.lit(None)
    return listing.select("path", F.when(p.endswith(".csv"), "csv")
                          .when(p.endswith(".zip") | (F.hex(magic) == "504B"), "shapefile")
                          .otherwise("geojson").alias("format"))


def collection_name(path: str) -> str:
    base = os.path.basename(path.rstrip("/"))
    base = re.sub(r"\.(csv|geojson|json|zip|gz)$", "", base, flags=re.I)
    base = re.sub(r"\.(geojson|json)$", "", base, flags=re.I)
    return TX.sanitize_name(base)


TOO_SHORT = "CSV file needs a header and at least one data row"


def check_csv(spark: SparkSession, path: str) -> tuple[bool, str | None]:
    """SRC-8: a CSV needs a header line and at least one data row."""
    lines = spark.read.text(path).filter(F.trim("value") != "").limit(2).count()
    if lines < 2:
        return False, TOO_SHORT
    return True, None


def _uri(path):
    """``file:///a`` and ``file:/a`` name the same file: the shorter form."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")


def check_csv_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """SRC-8 over many files in one job: (path, n_lines, ok, reason), one row a file, empty files too.

    Lines that hold more than spaces count; the counts are partial before the shuffle, so a large file is many tasks.
    """
    text = spark.read.option("recursiveFileLookup", str(bool(recursive)).lower()).text(path)
    # the listing that Spark keeps on the driver for any read; a scan leaves files of no bytes out
    files = spark.createDataFrame([(p,) for p in text.inputFiles()], "path string").select(_uri(F.col("path")).alias("path"))
    lines = (text.filter(F.trim("value") != "")
             .groupBy(_uri(F.col("_metadata.file_path")).alias("path")).agg(F.count(F.lit(1)).alias("n_lines")))
    n = F.coalesce("n_lines", F.lit(0))
    return files.join(lines, "path", "left").select("path", n.alias("n_lines"), (n > 1).alias("ok"),
                                                    F.when(n < 2, F.lit(TOO_SHORT)).alias("reason"))


def require_csv(spark: SparkSession, path: str) -> None:
    ok, reason = check_csv(spark, path)
    if not ok:
        raise ValueError(reason)


def import_file(spark: SparkSession, path: str, srid: int = 4326, **kw):
    """Route one file to its importer; returns (features, info)."""
    fmt = format_of(spark, path)
    if fmt == "csv":
        require_csv(spark, path)
        from .csv import read_csv_points
        feats, report, plan = read_csv_points(spark, path, srid=srid, **kw)
        return feats, {"format": "csv", "plan": plan, "report": report}
    if fmt == "shapefile":
        from .shapefile import read_shapefile
        return read_shapefile(spark, path, target_srid=srid)
    from .geojson import read_geojson
    feats, info = read_geojson(spark, path, srid=srid)
    info["format"] = "geojson"
    return feats, info
