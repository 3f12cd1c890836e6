"""Feature collections over the driver's test tables.

The tables carry no coordinates, so positions are derived from keys by
integer arithmetic.  The formulas are kept as SQL text and used verbatim by
both the Spark plans (``F.expr``) and the DuckDB oracle, so both engines see
bit-identical coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from .collection import Collection


def lon_sql(key: str) -> str:
    return f"(CAST((({key}) * 7919) % 14500 AS DOUBLE) / 1000.0 - 5.0)"


def lat_sql(key: str) -> str:
    return f"(CAST((({key}) * 104729) % 9500 AS DOUBLE) / 1000.0 + 41.5)"


# key expression per point table
POINT_KEYS = {
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "orders": "o_orderkey",
    "events": "event_id",
    "lineitem": "l_orderkey * 7 + l_linenumber",
}

# The concave nation ring on a 5x5 grid of 2.9 x 1.9 degree
# cells, as fractions of the cell (closed ring).
NATION_RING = ((0.05, 0.07), (0.93, 0.11), (0.53, 0.47), (0.89, 0.91), (0.13, 0.87), (0.05, 0.07))
NATION_CELL_W = 2.9
NATION_CELL_H = 1.9


def nation_x0_sql(k: str = "n_nationkey") -> str:
    return f"(-5.0 + 2.9 * CAST(({k}) % 5 AS DOUBLE))"


def nation_y0_sql(k: str = "n_nationkey") -> str:
    return f"(41.5 + 1.9 * CAST(FLOOR(({k}) / 5) AS DOUBLE))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Rows of the larger side that a task of a join on a growing key sorts and groups at once.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys) -> DataFrame:
    """``df`` by ``keys`` in so many partitions that one of ``rows`` rows in all stays near ``TASK_ROWS``;
    unchanged where the session's shuffle partitions do that."""
    n = -(-rows // TASK_ROWS)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)


def _points(df: DataFrame, key_sql: str, id_col, props: list[str]) -> DataFrame:
    lon = F.expr(lon_sql(key_sql))
    lat = F.expr(lat_sql(key_sql))
    return df.select(id_col.alias("id"), *props,
                     G.point(lon, lat).alias("geom"),
                     lon.alias("_xmin"), lat.alias("_ymin"), lon.alias("_xmax"), lat.alias("_ymax"))


def customers(spark, sf_dir) -> Collection:
    df = read(spark, sf_dir, "customer")
    return Collection(_points(df, POINT_KEYS["customer"], F.col("c_custkey"),
                              ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
                      name="customers", workspace="sales")


def suppliers(spark, sf_dir) -> Collection:
    df = read(spark, sf_dir, "supplier")
    return Collection(_points(df, POINT_KEYS["supplier"], F.col("s_suppkey"),
                              ["s_name", "s_nationkey", "s_acctbal"]),
                      name="suppliers", workspace="sales")


def orders(spark, sf_dir) -> Collection:
    df = read(spark, sf_dir, "orders")
    return Collection(_points(df, POINT_KEYS["orders"], F.col("o_orderkey"),
                              ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
                      name="orders", workspace="sales", datetime_column="o_orderdate")


def events(spark, sf_dir) -> Collection:
    df = read(spark, sf_dir, "events")
    return Collection(_points(df, POINT_KEYS["events"], F.col("event_id"),
                              ["ts", "user_id", "event_type", "value"]),
                      name="events", workspace="ops", datetime_column="ts")


def lineitems(spark, sf_dir) -> Collection:
    df = read(spark, sf_dir, "lineitem")
    return Collection(_points(df, POINT_KEYS["lineitem"], F.expr("l_orderkey * 8 + l_linenumber"),
                              ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                               "l_discount", "l_returnflag", "l_shipdate"]),
                      name="lineitems", workspace="sales", datetime_column="l_shipdate")


def nation_ring(x0: F.Column, y0: F.Column):
    return F.array(*[F.struct((x0 + F.lit(NATION_CELL_W * fx)).alias("x"),
                              (y0 + F.lit(NATION_CELL_H * fy)).alias("y")) for fx, fy in NATION_RING])


def nations(spark, sf_dir) -> Collection:
    """25 concave polygons, one per nation, on a 5x5 grid."""
    df = read(spark, sf_dir, "nation")
    x0 = F.expr(nation_x0_sql())
    y0 = F.expr(nation_y0_sql())
    geom = F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"),
                    F.array(F.array(nation_ring(x0, y0))).alias("parts"))
    xs = [NATION_CELL_W * fx for fx, _ in NATION_RING]
    ys = [NATION_CELL_H * fy for _, fy in NATION_RING]
    out = df.select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey", geom.alias("geom"),
                    (x0 + F.lit(min(xs))).alias("_xmin"), (y0 + F.lit(min(ys))).alias("_ymin"),
                    (x0 + F.lit(max(xs))).alias("_xmax"), (y0 + F.lit(max(ys))).alias("_ymax"))
    return Collection(out, name="nations", geometry_type="Polygon", workspace="geo")


def nation_edges_sql() -> str:
    """DuckDB text of the nation polygon edge table (oracle side of PIP)."""
    pts = ", ".join(f"({i}, CAST({fx} AS DOUBLE), CAST({fy} AS DOUBLE))" for i, (fx, fy) in enumerate(NATION_RING))
    x0, y0 = nation_x0_sql(), nation_y0_sql()
    w, h = "CAST(2.9 AS DOUBLE)", "CAST(1.9 AS DOUBLE)"
    return (f"(SELECT n.n_nationkey AS pid, {x0} + {w} * a.fx AS x1, {y0} + {h} * a.fy AS y1, "
            f"{x0} + {w} * b.fx AS x2, {y0} + {h} * b.fy AS y2 "
            f"FROM nation n, (VALUES {pts}) a(i, fx, fy), (VALUES {pts}) b(i, fx, fy) WHERE b.i = a.i + 1)")


# ---------------------------------------------------------------- catalog fixture
# Workspaces, collections and import jobs derived from the driver's tables so
# catalog operators scale with them: one workspace per nation, one published
# collection per customer (its orders are the features), one import job per
# order (its line items are the job's log entries).
def workspaces(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"),
                    F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("description"),
                    F.col("n_regionkey").alias("region"))


def catalog_collections(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    o = read(spark, sf_dir, "orders")
    lon, lat = F.expr(lon_sql("o_orderkey")), F.expr(lat_sql("o_orderkey"))
    stats = o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("feature_count"), F.min(lon).alias("xmin"), F.min(lat).alias("ymin"),
        F.max(lon).alias("xmax"), F.max(lat).alias("ymax"),
        F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))
    name = F.concat(F.lower("c_mktsegment"), F.lit("_"), (F.col("c_custkey") % 97).cast("string"))
    base = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("workspace_id"), name.alias("name"),
                    F.concat(F.lit("data_"), name).alias("table_name"), F.lit("MultiPoint").alias("geometry_type"),
                    F.element_at(F.array(F.lit(4326), F.lit(3857), F.lit(2154)),
                                 (F.col("c_custkey") % 3 + 1).cast("int")).alias("srid"))
    return base.join(stats, "id", "left")


CATALOG_COLLECTIONS_SQL = f"""(SELECT c.c_custkey AS id, c.c_nationkey AS workspace_id,
  lower(c.c_mktsegment) || '_' || CAST(c.c_custkey % 97 AS VARCHAR) AS name,
  'data_' || lower(c.c_mktsegment) || '_' || CAST(c.c_custkey % 97 AS VARCHAR) AS table_name,
  'MultiPoint' AS geometry_type, CAST([4326, 3857, 2154][c.c_custkey % 3 + 1] AS INTEGER) AS srid,
  s.feature_count, s.xmin, s.ymin, s.xmax, s.ymax, s.created_at, s.updated_at
FROM customer c LEFT JOIN (SELECT o_custkey AS id, count(*) AS feature_count, min({lon_sql('o_orderkey')}) AS xmin,
  min({lat_sql('o_orderkey')}) AS ymin, max({lon_sql('o_orderkey')}) AS xmax, max({lat_sql('o_orderkey')}) AS ymax,
  min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at FROM orders GROUP BY o_custkey) s ON s.id = c.c_custkey)"""

WORKSPACES_SQL = ("(SELECT n_nationkey AS id, lower(n_name) AS name, 'region ' || CAST(n_regionkey AS VARCHAR) AS description, "
                  "n_regionkey AS region FROM nation)")


def history(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    li = read(spark, sf_dir, "lineitem")
    # every join and group below is by the order's key: dealt by it once, whatever the size, a task's share is bounded
    rows = li.count()
    li = dealt(li.select("l_orderkey", "l_returnflag", "l_shipdate"), rows, "l_orderkey")
    o = dealt(o, rows, "o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed")
              .when(F.col("o_orderpriority") == "1-URGENT", "pending").otherwise("running"))
    jobs = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_custkey") + 1000000000)
        .otherwise(F.col("o_custkey")).alias("collection_id"),
        F.concat(F.lit("upload_"), F.col("o_orderkey").cast("string"), F.lit(".geojson")).alias("source_file"),
        status.alias("status"), F.col("o_orderstatus"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice"))
    jobs = jobs.withColumn("started_at", F.when(F.col("status") != "pending", F.expr(
        "timestampadd(SECOND, CAST(id % 600 AS INT), created_at)")))
    jobs = jobs.withColumn("completed_at", F.when(F.col("status").isin("completed", "failed"), F.expr(
        "timestampadd(SECOND, CAST(floor(o_totalprice) % 3600 AS INT), started_at)")))
    # per-job log summary from partial aggregates (bounded: three entries per job, whatever the job size)
    joined = li.join(o.select("o_orderkey", "o_orderstatus"), li["l_orderkey"] == o["o_orderkey"])
    stats = joined.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_if(F.col("l_returnflag") == "R").alias("__warn"),
        F.count_if((F.col("l_returnflag") == "A") & (F.col("o_orderstatus") == "P")).alias("__err"),
        F.min("l_shipdate").alias("__first"), F.max("l_shipdate").alias("__last"))
    logs = stats.select("id", "total_features", F.array(
        F.struct(F.col("__first").cast("string").alias("ts"), F.lit("info").alias("level"),
                 F.concat(F.lit("read "), F.col("total_features").cast("string"), F.lit(" features")).alias("message")),
        F.struct(F.col("__last").cast("string").alias("ts"),
                 F.when(F.col("__warn") > 0, "warn").otherwise("info").alias("level"),
                 F.concat(F.col("__warn").cast("string"), F.lit(" rows with warnings")).alias("message")),
        F.struct(F.col("__last").cast("string").alias("ts"),
                 F.when(F.col("__err") > 0, "error").otherwise("info").alias("level"),
                 F.concat(F.col("__err").cast("string"), F.lit(" rows rejected")).alias("message"))).alias("__logs"))
    out = jobs.join(logs, "id", "left").withColumn("total_features", F.coalesce("total_features", F.lit(0)).cast("bigint"))
    imported = (F.when(F.col("status") == "completed", F.col("total_features"))
                .when(F.col("status") == "failed", F.floor(F.col("total_features") / 2))
                .when(F.col("status") == "running", F.floor(F.col("total_features") / 3)).otherwise(F.lit(0)))
    return out.select("id", "collection_id", "source_file", "status", "total_features",
                      imported.cast("bigint").alias("imported_features"),
                      F.coalesce("__logs", F.array().cast(
                          "array<struct<ts:string,level:string,message:string>>")).alias("logs"),
                      "created_at", "started_at", "completed_at")


HISTORY_SQL = """(SELECT o.o_orderkey AS id,
  CASE WHEN o.o_orderpriority = '5-LOW' THEN o.o_custkey + 1000000000 ELSE o.o_custkey END AS collection_id,
  'upload_' || CAST(o.o_orderkey AS VARCHAR) || '.geojson' AS source_file,
  CASE WHEN o.o_orderstatus = 'F' THEN 'completed' WHEN o.o_orderstatus = 'P' THEN 'failed'
       WHEN o.o_orderpriority = '1-URGENT' THEN 'pending' ELSE 'running' END AS status,
  o.o_orderstatus, o.o_orderdate AS created_at, o.o_totalprice,
  CAST(coalesce(l.n, 0) AS BIGINT) AS total_features, coalesce(l.logs, []) AS logs
FROM orders o LEFT JOIN (SELECT li.l_orderkey, count(*) AS n,
  [{'ts': CAST(min(li.l_shipdate) AS VARCHAR), 'level': 'info', 'message': 'read ' || CAST(count(*) AS VARCHAR) || ' features'},
   {'ts': CAST(max(li.l_shipdate) AS VARCHAR),
    'level': CASE WHEN count(*) FILTER (WHERE li.l_returnflag = 'R') > 0 THEN 'warn' ELSE 'info' END,
    'message': CAST(count(*) FILTER (WHERE li.l_returnflag = 'R') AS VARCHAR) || ' rows with warnings'},
   {'ts': CAST(max(li.l_shipdate) AS VARCHAR),
    'level': CASE WHEN count(*) FILTER (WHERE li.l_returnflag = 'A' AND oo.o_orderstatus = 'P') > 0 THEN 'error' ELSE 'info' END,
    'message': CAST(count(*) FILTER (WHERE li.l_returnflag = 'A' AND oo.o_orderstatus = 'P') AS VARCHAR) || ' rows rejected'}] AS logs
  FROM lineitem li JOIN orders oo ON li.l_orderkey = oo.o_orderkey GROUP BY li.l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""

HISTORY_FULL_SQL = f"""(SELECT h.*,
  CASE WHEN status <> 'pending' THEN created_at + to_seconds(CAST(id % 600 AS BIGINT)) END AS started_at,
  CASE WHEN status IN ('completed', 'failed') THEN created_at + to_seconds(CAST(id % 600 AS BIGINT))
       + to_seconds(CAST(floor(o_totalprice) % 3600 AS BIGINT)) END AS completed_at,
  CAST(CASE WHEN status = 'completed' THEN total_features WHEN status = 'failed' THEN floor(total_features / 2)
       WHEN status = 'running' THEN floor(total_features / 3) ELSE 0 END AS BIGINT) AS imported_features
FROM {HISTORY_SQL} h)"""


def customer_areas(spark, sf_dir) -> Collection:
    """One axis-aligned square polygon per customer (half side 0.02..0.12 degrees)."""
    c = customers(spark, sf_dir).df
    h = F.lit(0.02) + (F.col("id") % 11).cast("double") * F.lit(0.01)
    x1, y1 = F.col("_xmin") - h, F.col("_ymin") - h
    x2, y2 = F.col("_xmax") + h, F.col("_ymax") + h

    def v(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(v(x1, y1), v(x2, y1), v(x2, y2), v(x1, y2), v(x1, y1))
    geom = F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts"))
    df = c.select("id", "c_mktsegment", geom.alias("geom"), x1.alias("_xmin"), y1.alias("_ymin"),
                  x2.alias("_xmax"), y2.alias("_ymax"))
    return Collection(df, name="customer_areas", geometry_type="Polygon", workspace="sales")
