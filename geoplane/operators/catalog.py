"""Catalog and import-history operators (JN-1..5, ING-18, AGG-9..11, SRT-1..6,
JOB-1..5, PRJ-8, PRJ-9, PAG-3 batch links).

The reference keeps workspaces, collections and import jobs in three
metadata tables and answers single-row requests.  Here they are DataFrames
and every operator is set-based: listing, joins, upserts and cascades work
on whole catalogs at once.

Schemas (FIXTURES 5):

* workspaces: id, name, description, created_at
* collections: id, workspace_id, name, table_name, geometry_type, srid,
  feature_count, xmin, ymin, xmax, ymax, created_at, updated_at
* history: id, collection_id, source_file, status, total_features,
  imported_features, logs array<struct<ts,level,message>>, created_at,
  started_at, completed_at
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs as _crs

# Job statuses, job listing default and maximum limit.
JOB_STATUSES = ("pending", "running", "completed", "failed")
JOB_DEFAULT_LIMIT, JOB_MAX_LIMIT = 20, 100


# ---------------------------------------------------------------- JN-1, SRT-1, SRT-6
def collections_with_workspace(collections: DataFrame, workspaces: DataFrame) -> DataFrame:
    """JN-1: inner join on the workspace id, ordered by workspace name then collection name.

    Workspaces are few compared to collections but not provably so, so the
    join is left to Catalyst/AQE (it broadcasts at runtime when small).
    """
    ws = workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"))
    return (collections.join(ws, "workspace_id", "inner")
            .withColumn("collection_id", F.concat_ws(":", "workspace_name", "name"))
            .orderBy(F.col("workspace_name").asc_nulls_last(), F.col("name").asc_nulls_last()))


def workspaces_by_name(workspaces: DataFrame) -> DataFrame:
    """SRT-6: workspaces ordered by name."""
    return workspaces.orderBy(F.col("name").asc_nulls_last())


# ---------------------------------------------------------------- JN-2, SRT-2, SRT-3, JOB-1
def jobs_with_collection(history: DataFrame, collections: DataFrame) -> DataFrame:
    """JN-2: jobs LEFT JOIN collections -- jobs of deleted collections keep a null name."""
    cols = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    return history.join(cols, "collection_id", "left")


def list_jobs(history: DataFrame, collections: DataFrame, status: str | None = None,
              collection_id=None, limit=JOB_DEFAULT_LIMIT, offset=0) -> DataFrame:
    """SRT-2 / JOB-1: filter by status / collection, newest first, limit (max 100) and offset.

    The limit has no lower clamp (as in the reference); a non-positive limit returns nothing.
    """
    df = history
    if status:
        df = df.filter(F.col("status") == F.lit(status))
    if collection_id is not None:
        df = df.filter(F.col("collection_id") == F.lit(collection_id))
    order = [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    lim = max(min(int(limit), JOB_MAX_LIMIT), 0)
    page = df.orderBy(*order).offset(max(int(offset), 0)).limit(lim)
    # only the page meets the collections; the join does not keep its order
    return jobs_with_collection(page, collections).orderBy(*order)


def collection_history(history: DataFrame, collection_id) -> DataFrame:
    """SRT-3: one collection's imports, newest first."""
    return (history.filter(F.col("collection_id") == F.lit(collection_id))
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()))


def collection_histories(history: DataFrame) -> DataFrame:
    """SRT-3 batch form: every collection's imports, grouped by collection, newest first.

    A global sort (range-partitioned on the sort keys), so a collection with
    a huge history is spread over several tasks instead of one window group.
    """
    return history.orderBy(F.col("collection_id").asc_nulls_last(), F.col("created_at").desc_nulls_last(),
                           F.col("id").desc())


# ---------------------------------------------------------------- JN-4
def cascade_delete(workspaces: DataFrame, collections: DataFrame, history: DataFrame,
                   deleted_workspaces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JN-4: removing workspaces removes their collections and those collections' history.

    ``deleted_workspaces`` holds the ids to delete; everything is anti joins.
    """
    gone_ws = deleted_workspaces.select(F.col("id").alias("__wid")).distinct()
    ws = workspaces.join(gone_ws, workspaces["id"] == gone_ws["__wid"], "left_anti")
    gone_c = collections.join(gone_ws, collections["workspace_id"] == gone_ws["__wid"], "left_semi").select(
        F.col("id").alias("__cid"))
    cols = collections.join(gone_ws, collections["workspace_id"] == gone_ws["__wid"], "left_anti")
    hist = history.join(gone_c, history["collection_id"] == gone_c["__cid"], "left_anti")
    return ws, cols, hist


# ---------------------------------------------------------------- JN-5
def orphan_collections(collections: DataFrame, workspaces: DataFrame) -> DataFrame:
    """JN-5: collections whose workspace does not exist (would be rejected on insert)."""
    return collections.join(workspaces.select(F.col("id").alias("workspace_id")), "workspace_id", "left_anti")


def duplicate_names(collections: DataFrame) -> DataFrame:
    """JN-5: (workspace_id, name) pairs used more than once (unique constraint)."""
    return (collections.groupBy("workspace_id", "name").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


# ---------------------------------------------------------------- ING-18
def upsert_collections(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """ING-18: after an import, update bbox / count / type of (workspace_id, name) if it
    exists, else insert; user settings of existing rows are kept.

    ``updates`` carries workspace_id, name, table_name, geometry_type,
    feature_count, xmin..ymax, updated_at (one row per key; later duplicates
    resolved by the newest ``updated_at``).
    """
    # newest first; equal timestamps fall back to the refreshed values themselves, so
    # the choice is deterministic and rows that still tie are identical where it matters
    w = Window.partitionBy("workspace_id", "name").orderBy(
        F.col("updated_at").desc_nulls_last(), F.col("feature_count").desc_nulls_last(),
        *[F.col(c).asc_nulls_last() for c in ("xmin", "ymin", "xmax", "ymax")])
    upd = updates.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    refreshed = ("geometry_type", "feature_count", "xmin", "ymin", "xmax", "ymax", "updated_at")
    u = upd.select("workspace_id", "name", *[F.col(c).alias(f"__u_{c}") for c in refreshed],
                   F.col("table_name").alias("__u_table_name"))
    joined = existing.join(u, ["workspace_id", "name"], "full_outer")
    out = []
    for f in existing.schema.fields:
        c = f.name
        if c in ("workspace_id", "name"):
            out.append(F.col(c))
        elif c in refreshed:
            out.append(F.coalesce(F.col(f"__u_{c}"), F.col(c)).cast(f.dataType).alias(c))
        elif c == "table_name":
            out.append(F.coalesce(F.col(c), F.col("__u_table_name")).alias(c))
        elif c == "created_at":
            out.append(F.coalesce(F.col(c), F.col("__u_updated_at")).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


# ---------------------------------------------------------------- AGG-9..11, SRT-4, JOB-2
def job_status_counts(history: DataFrame) -> DataFrame:
    """AGG-9: count per status in one pass (count FILTER (WHERE ...))."""
    return history.agg(*[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATUSES])


def last_completed(history: DataFrame) -> DataFrame:
    """SRT-4: the job with the latest non-null completed_at (max_by: one row, no sort)."""
    done = history.filter(F.col("completed_at").isNotNull())
    return done.agg(F.max_by(F.struct("id", "collection_id", "completed_at"),
                             F.struct("completed_at", "id")).alias("j")).select("j.*")


def job_summary(history: DataFrame) -> DataFrame:
    """JOB-2: status counts + last completed job in one aggregate."""
    done = F.col("completed_at").isNotNull()
    return history.agg(*[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATUSES],
                       F.max_by(F.when(done, F.col("id")), F.when(done, F.struct("completed_at", "id"))).alias("last_job_id"),
                       F.max(F.col("completed_at")).alias("last_completed_at"))


def collections_per_workspace(collections: DataFrame) -> DataFrame:
    """AGG-10."""
    return collections.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_collections"))


def dashboard_totals(workspaces: DataFrame, collections: DataFrame, history: DataFrame) -> DataFrame:
    """AGG-11: total features (null -> 0) and object counts in one aggregate over a tagged union."""
    parts = (collections.select(F.lit("c").alias("__t"), F.coalesce(F.col("feature_count"), F.lit(0)).cast("bigint").alias("__v"))
             .unionByName(workspaces.select(F.lit("w").alias("__t"), F.lit(0).cast("bigint").alias("__v")))
             .unionByName(history.select(F.lit("h").alias("__t"), F.lit(0).cast("bigint").alias("__v"))))
    return parts.agg(F.coalesce(F.sum(F.when(F.col("__t") == "c", F.col("__v"))), F.lit(0)).cast("bigint").alias("total_features"),
                     F.count_if(F.col("__t") == "c").alias("n_collections"),
                     F.count_if(F.col("__t") == "w").alias("n_workspaces"),
                     F.count_if(F.col("__t") == "h").alias("n_jobs"))


# ---------------------------------------------------------------- JOB-3..5
def job_duration_ms(created: Column, completed: Column) -> Column:
    """JOB-3: completion - creation in milliseconds."""
    return F.timestamp_diff("MILLISECOND", created, completed)


def explode_logs(history: DataFrame) -> DataFrame:
    """JOB-4: one row per log entry (job id, position, ts, level, message)."""
    return history.select("id", F.posexplode("logs").alias("pos", "entry")).select(
        "id", "pos", "entry.ts", "entry.level", "entry.message")


def log_level_counts(history: DataFrame) -> DataFrame:
    """JOB-4: warnings / errors per job."""
    return explode_logs(history).groupBy("id").agg(
        F.count_if(F.col("level") == "warn").alias("warnings"),
        F.count_if(F.col("level") == "error").alias("errors"))


def progress_pct(done: Column, total: Column) -> Column:
    """JOB-5: round(done / total * 100)."""
    return F.when(total > 0, F.round(done.cast("double") / total * 100).cast("int")).otherwise(F.lit(0))


# ---------------------------------------------------------------- PRJ-8, PRJ-9
def collection_metadata(collections: DataFrame, workspaces: DataFrame) -> DataFrame:
    """PRJ-8: id, title, description, extent (only when a bbox exists), crs list, storageCrs."""
    c = collections_with_workspace(collections, workspaces)
    has_box = F.col("xmin").isNotNull()
    return c.select(
        F.col("collection_id").alias("id"), F.col("name").alias("title"),
        F.when(has_box, F.array("xmin", "ymin", "xmax", "ymax")).alias("extent_bbox"),
        _crs.supported_crs(F.col("srid")).alias("crs"),
        _crs.srid_to_uri(F.col("srid")).alias("storage_crs"))


def collection_view(collections: DataFrame, workspaces: DataFrame, base_url: str = "") -> DataFrame:
    """PRJ-8 in full: the metadata plus description, item type, temporal extent and links.

    ``description``, ``temporal_start`` and ``temporal_end`` are taken from the
    catalog where it has them; an extent is null when it is not stored.
    """
    have = set(collections.columns)

    def stored(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    extra = collections_with_workspace(collections, workspaces).select(
        F.col("collection_id").alias("id"), F.col("id").alias("__key"), F.col("name").alias("title"),
        stored("description", "string").alias("description"), F.lit("feature").alias("item_type"),
        F.when(F.col("xmin").isNotNull(), F.array("xmin", "ymin", "xmax", "ymax")).alias("extent_bbox"),
        F.when(stored("temporal_start", "timestamp").isNotNull() | stored("temporal_end", "timestamp").isNotNull(),
               F.array(stored("temporal_start", "timestamp"), stored("temporal_end", "timestamp"))).alias("temporal_interval"),
        _crs.supported_crs(F.col("srid")).alias("crs"), _crs.srid_to_uri(F.col("srid")).alias("storage_crs"))
    here = F.concat(F.lit(base_url + "/collections/"), F.col("id"))
    links = F.array(*[F.struct(F.lit(rel).alias("rel"), F.concat(here, F.lit(path)).alias("href"))
                      for rel, path in (("self", ""), ("items", "/items"), ("queryables", "/queryables"), ("tiles", "/tiles"))])
    return extra.withColumn("links", links).drop("__key")


def tileset_metadata(collections: DataFrame, workspaces: DataFrame, base_url: str = "") -> DataFrame:
    """PRJ-9: tile URL template + bounding box from the stored bbox."""
    c = collections_with_workspace(collections, workspaces)
    return c.select(
        F.col("collection_id").alias("id"),
        F.concat(F.lit(base_url + "/collections/"), F.col("collection_id"), F.lit("/tiles/{z}/{x}/{y}.pbf")).alias("url"),
        F.when(F.col("xmin").isNotNull(), F.array("xmin", "ymin", "xmax", "ymax")).alias("bounding_box"))


# ---------------------------------------------------------------- PAG-3 batch form
def page_links_columns(n: Column, limit: Column, offset: Column) -> dict[str, Column]:
    """PAG-3 as column arithmetic over a request table (n = numberMatched)."""
    return {
        "self_offset": offset,
        "next_offset": F.when(offset + limit < n, offset + limit),
        "prev_offset": F.when(offset > 0, F.greatest(offset - limit, F.lit(0))),
        "first_offset": F.lit(0),
        "last_offset": F.when(n > 0, F.floor((n - 1) / limit).cast("bigint") * limit),
    }


# ---------------------------------------------------------------- ING-19
# Fixed value: progress is reported every 500 features.
PROGRESS_BATCH = 500


def progress_rows(spark, total: int, batch: int = PROGRESS_BATCH) -> DataFrame:
    """ING-19: the progress updates an import emits: every ``batch`` features and at the last one."""
    if total <= 0:
        return spark.createDataFrame([], "done bigint, progress int")
    steps = spark.range(1, total // batch + 1).select((F.col("id") * batch).alias("done"))
    if total % batch:
        steps = steps.unionByName(spark.range(1).select(F.lit(total).cast("bigint").alias("done")))
    return steps.select("done", progress_pct(F.col("done"), F.lit(total)).alias("progress"))


def import_history_row(spark, collection_id, source_file: str, report: DataFrame, started, completed,
                       status: str = "completed", error: str | None = None) -> DataFrame:
    """ING-19: one history row for an import: counts from the import report, duration, logs."""
    r = report.first()
    imported, skipped = int(r["imported"]), int(r["skipped"])
    logs = [(str(started), "info", f"import started: {source_file}")]
    if skipped:
        logs.append((str(completed), "warn", f"{skipped} rows skipped (invalid coordinates)"))
    logs.append((str(completed), "error" if status == "failed" else "info",
                 error or f"{imported} features imported"))
    row = [(collection_id, source_file, status, imported + skipped, imported, logs, started, completed)]
    df = spark.createDataFrame(row, "collection_id bigint, source_file string, status string, total_features bigint, "
                                    "imported_features bigint, logs array<struct<ts:string,level:string,message:string>>, "
                                    "started_at timestamp, completed_at timestamp")
    return df.withColumn("duration_ms", job_duration_ms(F.col("started_at"), F.col("completed_at"))).withColumn(
        "progress", progress_pct(F.col("imported_features") + F.lit(skipped), F.col("total_features")))
