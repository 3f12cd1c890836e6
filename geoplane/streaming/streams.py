"""Structured Streaming forms (STR-1..4).

The reference's "upload -> queue -> worker" import becomes a file stream:
new files in a drop folder are imported micro-batch by micro-batch with
exactly-once bookkeeping in the checkpoint.  Attribute, temporal and spatial
predicates are stateless Columns, so they apply to streams unchanged; the
running collection statistics are a streaming aggregation; point lookups
against a static polygon table are a stream-static join on grid cells.

Checkpoints live under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import strips
from ..session import ensure_checkpoint_dir


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


# ---------------------------------------------------------------- STR-1
def drop_folder_ingest(spark: SparkSession, folder: str, out_root: str, history_path: str,
                       importer: Callable[[SparkSession, str], tuple[DataFrame, dict]] | None = None,
                       checkpoint: str | None = None, max_files_per_trigger: int = 16,
                       delete_source: bool = True, available_now: bool = True):
    """Import every new CSV / GeoJSON file dropped in ``folder``.

    The stream lists files with the ``binaryFile`` source (only ``path`` is
    selected, so contents are not read by the stream itself).  Each
    micro-batch imports its files -- at most ``max_files_per_trigger`` --
    with the batch importers (each one a distributed job), writes every
    feature table as a fresh clustered Parquet version and appends one
    import-history row per file.  ``cleanSource=delete`` removes a source
    file once its batch has committed, as the reference unlinks it after a
    successful import; a file that failed is first copied to
    ``<history_path>_failed/batch_id=N`` so it can be retried.
    """
    from ..sources import detect
    from ..sources.export import write_feature_table

    reader = (spark.readStream.format("binaryFile")
              .schema("path string, modificationTime timestamp, length bigint, content binary")
              .option("pathGlobFilter", "*.{csv,CSV,geojson,json,gz,zip}")
              .option("recursiveFileLookup", "true")          # drop/<workspace>/<file>
              .option("maxFilesPerTrigger", max_files_per_trigger))
    root = folder.rstrip("/")
    if delete_source:
        reader = reader.option("cleanSource", "delete")
    files = reader.load(folder).select("path", "modificationTime", "length")

    def handle(batch: DataFrame, batch_id: int) -> None:
        # foreachBatch is at-least-once: every write below is keyed by the batch id,
        # so a replayed batch overwrites its own outputs instead of duplicating them
        rows = batch.select("path").collect()          # <= max_files_per_trigger paths
        records = []
        for r in rows:
            path = r["path"]
            try:
                feats, info = (importer or detect.import_file)(spark, path)
                name = detect.collection_name(path)
                ws = _workspace_of(path, root)
                tag = hashlib.sha1(path.encode()).hexdigest()[:10]          # two files may share a name
                table = write_feature_table(feats, out_root, name, version=f"batch{batch_id}-{tag}", workspace=ws)
                n = spark.read.parquet(table).count()
                records.append((path, ws, name, table, "completed", n, None))
            except Exception as e:  # noqa: BLE001 - one bad file must not stop the stream
                # the source is removed once the batch commits (cleanSource): keep a failed
                # file for a retry, as the reference keeps it when an import fails
                _quarantine(spark, path, f"{history_path.rstrip('/')}_failed/batch_id={batch_id}")
                records.append((path, _workspace_of(path, root), detect.collection_name(path), None, "failed", 0,
                                str(e)))
        if records:
            hist = spark.createDataFrame(records, "source_file string, workspace string, collection string, "
                                                  "table_path string, status string, feature_count bigint, "
                                                  "error string")
            (hist.withColumn("completed_at", F.current_timestamp())
             .write.mode("overwrite").parquet(f"{history_path.rstrip('/')}/batch_id={batch_id}"))

    q = (files.writeStream.foreachBatch(handle)
         .option("checkpointLocation", checkpoint or checkpoint_location(spark, "drop-folder")))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def _workspace_of(path: str, root: str) -> str | None:
    """``drop/<workspace>/<file>`` -> workspace (D5: table identity includes it); None at the top."""
    marker = root.split("://")[-1].rstrip("/") + "/"
    rest = path.split("://")[-1]
    rest = rest[rest.find(marker) + len(marker):] if marker in rest else rest.rsplit("/", 1)[-1]
    return rest.split("/", 1)[0] if "/" in rest else None


def _quarantine(spark: SparkSession, path: str, folder: str) -> None:
    """Copy one file into ``folder`` with the session's Hadoop FileSystem."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    src = jvm.org.apache.hadoop.fs.Path(path)
    dst = jvm.org.apache.hadoop.fs.Path(folder)
    fs_src, fs_dst = src.getFileSystem(conf), dst.getFileSystem(conf)
    fs_dst.mkdirs(dst)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs_src, src, fs_dst, dst, False, conf)


# ---------------------------------------------------------------- STR-2
def stream_filter(stream: DataFrame, condition: Column, columns: list[str] | None = None) -> DataFrame:
    """The same predicate Columns as the batch items query, on a stream."""
    out = stream.filter(condition)
    return out.select(*columns) if columns else out


# ---------------------------------------------------------------- STR-3
def running_collection_stats(stream: DataFrame, collection_col: str = "collection") -> DataFrame:
    """Feature count and extent per collection, kept up to date (update mode, see :func:`run_upserts`)."""
    return stream.groupBy(collection_col).agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.min("_xmin").alias("xmin"), F.min("_ymin").alias("ymin"),
        F.max("_xmax").alias("xmax"), F.max("_ymax").alias("ymax"))


# ---------------------------------------------------------------- STR-4
def stream_point_lookup(polygons, points: DataFrame, point_id: str = "pid", x: str = "x", y: str = "y",
                        cell: float | None = None) -> DataFrame:
    """Probe-point stream x static (multi)polygon collection -> (pid, id) containing pairs.

    The static side decides the grid (cell size, levels) once; each streamed
    point is mapped to its cell at every level the polygons use and joined
    to the exploded static cells (a stream-static equi-join), then refined
    by the same point test as the batch lookup, whatever the polygon's size.
    The cells (without geometry) are broadcast only behind a row count, the
    geometries only behind a byte bound.
    """
    feats = polygons.df.select(F.col(polygons.id_column).alias("id"), "_xmin", "_ymin", "_xmax", "_ymax",
                               strips.layout(F.col(polygons.geometry_column)).alias("__at"))
    geoms = polygons.df.select(F.col(polygons.id_column).alias("id"), F.col(polygons.geometry_column).alias("__geom"))
    box = [F.col(c) for c in ("_xmin", "_ymin", "_xmax", "_ymax")]
    cell = cell or J.suggest_cell(feats)
    level = J.level_of(box, cell)
    levels, _, env = J.side_stats(feats, box, level, cell, with_envelope=True)
    if env:
        points = points.filter((F.col(x) >= env[0]) & (F.col(x) <= env[2]) & (F.col(y) >= env[1]) & (F.col(y) <= env[3]))
    static = J.explode_cells(feats, box, cell, level, [], "__f").select(
        "id", "__at", F.col("__clv").alias("__lv"), F.col("__cx").alias("__kx"), F.col("__cy").alias("__ky"))
    if J.bounded_count(static, J.BROADCAST_MAX_ROWS) is not None:
        static = F.broadcast(static)
    px, py = F.col(x), F.col(y)
    cells = F.array(*[F.struct(F.lit(lv).alias("lv"),
                               F.floor(px / (cell * J.LEVEL_FACTOR ** lv)).alias("cx"),
                               F.floor(py / (cell * J.LEVEL_FACTOR ** lv)).alias("cy")) for lv in levels])
    probes = points.select(point_id, px.alias("__px"), py.alias("__py"), F.explode(cells).alias("__c")).select(
        point_id, "__px", "__py", F.col("__c.lv").alias("__lv"), F.col("__c.cx").alias("__kx"),
        F.col("__c.cy").alias("__ky"))
    joined = probes.join(static, ["__lv", "__kx", "__ky"], "inner")
    pairs = joined.select(point_id, "id", "__px", "__py", "__at")
    return strips.point_hits(pairs, geoms, "id", "__geom", "s_intersects").select(point_id, "id")


# ---------------------------------------------------------------- keyed upsert sink
FULL_EVERY = 20


def _versions(spark: SparkSession, sink_dir: str) -> list[tuple[int, str, str]]:
    """(batch id, kind, path) of the complete versions of a sink, oldest first; unfinished ones are left out."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(sink_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for status in fs.listStatus(root):
        kind, _, batch = status.getPath().getName().partition("-")
        if kind in ("full", "delta") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out.append((int(batch), kind, status.getPath().toString()))
    return sorted(out)


def _merged(spark: SparkSession, versions: list[tuple[int, str, str]], keys: list[str]) -> DataFrame | None:
    """The newest row of each key (null is a key too) over the last full version and the changes after it."""
    fulls = [n for n, kind, _ in versions if kind == "full"]
    live = [v for v in versions if not fulls or v[0] >= fulls[-1]]
    if not live:
        return None
    parts = [spark.read.parquet(path).withColumn("__batch", F.lit(n).cast("bigint")) for n, _, path in live]
    rows = reduce(DataFrame.unionByName, parts)
    value = F.struct(*[c for c in rows.columns if c not in (*keys, "__batch")])
    return rows.groupBy(*keys).agg(F.max_by(value, F.col("__batch")).alias("__v")).select(*keys, "__v.*")


def read_upserts(spark: SparkSession, sink_dir: str, keys: list[str]) -> DataFrame:
    """The state a reader sees: whole batches only, the newest complete row of each key."""
    state = _merged(spark, _versions(spark, sink_dir), keys)
    if state is None:
        raise ValueError(f"no complete batch in {sink_dir}")
    return state


def upsert_batch(batch: DataFrame, batch_id: int, sink_dir: str, keys: list[str], full_every: int = FULL_EVERY) -> None:
    """One micro-batch of changed rows (one a key) as a new version; nothing readers use is overwritten.

    The path names the batch, so a replayed batch that was complete writes
    nothing and one that was not is written again.  Every ``full_every``-th
    batch writes the merged state; versions older than the full one before it
    are then removed, so a reader that has just listed the folder keeps its files.
    """
    spark = batch.sparkSession
    done = _versions(spark, sink_dir)
    if any(n == batch_id for n, _, _ in done):
        return
    earlier = [v for v in done if v[0] < batch_id]
    if not earlier or batch_id % full_every:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/delta-{batch_id}")
        return
    old = _merged(spark, earlier, keys)
    newest = old.withColumn("__new", F.lit(0)).unionByName(batch.select(*old.columns).withColumn("__new", F.lit(1)))
    value = F.struct(*[c for c in old.columns if c not in keys])
    (newest.groupBy(*keys).agg(F.max_by(value, F.col("__new")).alias("__v")).select(*keys, "__v.*")
     .write.mode("overwrite").parquet(f"{sink_dir}/full-{batch_id}"))
    fulls = [n for n, kind, _ in earlier if kind == "full"]
    jvm = spark.sparkContext._jvm
    for n, _, path in earlier:
        if fulls and n < fulls[-1]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def run_upserts(df: DataFrame, keys: list[str], sink_dir: str, name: str = "upserts", full_every: int = FULL_EVERY,
                checkpoint: str | None = None) -> str:
    """Run a streaming aggregation in update mode over everything available: each batch writes its changed keys only."""
    q = (df.writeStream.outputMode("update")
         .foreachBatch(lambda batch, n: upsert_batch(batch, n, sink_dir, keys, full_every))
         .option("checkpointLocation", checkpoint or checkpoint_location(df.sparkSession, name)))
    q.trigger(availableNow=True).start().awaitTermination()
    return sink_dir


def run_available_now(df: DataFrame, sink_dir: str, fmt: str = "parquet", name: str = "stream") -> str:
    """Run a streaming frame over everything available, appending files; returns the sink path.

    Aggregations go through :func:`run_upserts`.
    """
    q = (df.writeStream.outputMode("append").format(fmt).option("path", sink_dir)
         .option("checkpointLocation", checkpoint_location(df.sparkSession, name)))
    q.trigger(availableNow=True).start().awaitTermination()
    return sink_dir
