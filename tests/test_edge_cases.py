"""Empty inputs and nulls through every family."""

from pyspark.sql import functions as F

from geoplane.functions.geometry import Geom
from geoplane.operators import classify as CL
from geoplane.operators import joins as J
from geoplane.operators import mvt as M
from geoplane.operators import profile as PF
from geoplane.operators import spatial as S
from geoplane.operators import tiles as TL
from geoplane.plans import collection as C

from .fixtures import sites


def _empty(spark):
    s = sites(spark)
    return s.with_df(s.df.filter(F.lit(False)))


def test_empty_collection_everywhere(spark):
    e = _empty(spark)
    res = C.items(e, bbox=[1, 48, 3, 49])
    assert res.number_matched() == 0
    row = C.page_with_count(res).first()
    assert row["id"] is None and row["number_matched"] == 0 and row["number_returned"] == 0
    boxes = spark.createDataFrame([(1, 0.0, 40.0, 5.0, 50.0)], "req_id int, _xmin double, _ymin double, _xmax double, _ymax double")
    assert J.batch_bbox(e, boxes).count() == 0
    probes = spark.createDataFrame([(1, 2.0, 48.0, 1000.0)], "pid int, lon double, lat double, radius_m double")
    assert J.batch_radius(e, probes).count() == 0
    assert PF.extent(e).first()["xmin"] is None
    assert PF.exact_quantiles(e.df.withColumn("v", F.lit(1.0)), "v", [0.5]) == [None]
    assert CL.graduated(e.df.withColumn("v", F.lit(1)), "v", 3) == []
    assert TL.pyramid_counts(e, [3]).count() == 0
    assert M.tile_blobs(e, [3], ["name"]).count() == 0
    assert e.df.filter(S.relate_literal(e, "s_within", Geom.from_wkt("POLYGON((0 0,1 0,1 1,0 1,0 0))"))).count() == 0


def test_empty_requests(spark):
    s = sites(spark)
    boxes = spark.createDataFrame([], "req_id int, _xmin double, _ymin double, _xmax double, _ymax double")
    assert J.batch_bbox(s, boxes).count() == 0
    pts = spark.createDataFrame([], "pid int, x double, y double")
    poly = s.with_df(spark.createDataFrame([], s.df.schema))
    assert J.batch_point_lookup(poly, pts).count() == 0


def test_null_geometry_rows(spark):
    s = sites(spark)
    extra = s.df.limit(1).select(F.lit(9).alias("id"), F.lit("Nowhere").alias("name"),
                                 F.lit(None).cast(s.df.schema["geom"].dataType).alias("geom"),
                                 *[F.lit(None).cast("double").alias(c) for c in ("_xmin", "_ymin", "_xmax", "_ymax")])
    df = s.df.unionByName(extra)
    c = s.with_df(df)
    assert C.items(c).number_matched() == 4
    assert C.items(c, bbox=[-180, -90, 180, 90]).number_matched() == 3          # null geometry fails bbox
    lit = Geom.from_wkt("POLYGON((0 40,10 40,10 50,0 50,0 40))")
    assert c.df.filter(S.relate_literal(c, "s_disjoint", lit)).count() == 0     # null is not disjoint
    assert TL.pyramid_counts(c, [0]).first()["n_features"] == 3


def test_point_pyramid_equals_per_feature_assignment(spark):
    """Pre-aggregated point pyramid == explode per feature, including points exactly on tile/margin edges."""
    from geoplane.functions import crs as CRS
    from geoplane.functions.geometry import point, with_bbox
    from geoplane.plans.collection import Collection
    H = CRS.MERC_HALF_WORLD
    edge_pts = []
    for z in (3, 5, 7):                                  # exact tile edges and margin edges, in 3857
        w = 2 * H / 2 ** z
        for k in (3, 4):
            for f in (0.0, 1 / 16, 15 / 16, 0.5):
                x = -H + (k + f) * w
                lon, lat = CRS.mercator_to_lonlat(x, H - (k + f) * w)
                edge_pts.append((lon, lat))
    rnd = [(-170 + (i * 7919 % 34000) / 100.0, -80 + (i * 104729 % 16000) / 100.0) for i in range(3000)]
    rows = [(i, lo, la) for i, (lo, la) in enumerate(edge_pts + rnd + [(2.35, 48.86)] * 500)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double")
    df = with_bbox(df.withColumn("geom", point(F.col("lon"), F.col("lat"))).drop("lon", "lat"))
    c = Collection(df, name="p", geometry_type="Point")
    fast = {tuple(r) for r in TL.pyramid_counts(c, range(0, 9)).collect()}
    slow = {tuple(r) for r in TL.assign_tiles(c, range(0, 9)).groupBy("z", "x", "y").count().collect()}
    assert fast == slow


def test_box_tile_assignment_brute_force(spark):
    """Extended features: buffered-envelope tile ranges == checking every tile of the zoom."""
    import random
    from geoplane.functions import crs as CRS
    from geoplane.plans.collection import Collection
    rnd = random.Random(7)
    boxes = []
    for i in range(60):
        x, y = rnd.uniform(-10, 10), rnd.uniform(40, 52)
        boxes.append((i, x, y, x + rnd.choice([0.0, 0.05, 0.7, 3.0]), y + rnd.choice([0.0, 0.05, 0.7, 3.0])))
    df = spark.createDataFrame(boxes, "id int, _xmin double, _ymin double, _xmax double, _ymax double")
    c = Collection(df, name="b", geometry_type="Polygon")
    got = {(r["id"], r["z"], r["x"], r["y"]) for r in TL.assign_tiles(c, [4, 6]).select("id", "z", "x", "y").collect()}
    H = CRS.MERC_HALF_WORLD
    want = set()
    for i, x1, y1, x2, y2 in boxes:
        mx1, my1 = CRS.lonlat_to_mercator(x1, y1)
        mx2, my2 = CRS.lonlat_to_mercator(x2, y2)
        for z in (4, 6):
            w = 2 * H / 2 ** z
            for tx in range(2 ** z):
                for ty in range(2 ** z):
                    ex1, ex2 = tx * w - H - w / 16, (tx + 1) * w - H + w / 16
                    ey2, ey1 = H - ty * w + w / 16, H - (ty + 1) * w - w / 16
                    if mx1 <= ex2 and mx2 >= ex1 and my1 <= ey2 and my2 >= ey1:
                        want.add((i, z, tx, ty))
    assert got == want


def test_empty_page_with_non_nullable_columns(spark):
    from geoplane.functions.geometry import point, with_bbox
    from geoplane.plans.collection import Collection
    df = spark.range(3).select(F.col("id"), F.lit("x").alias("name"))          # non-nullable columns
    df = with_bbox(df.withColumn("geom", point(F.col("id").cast("double"), F.lit(45.0))))
    c = Collection(df, name="nn")
    row = C.page_with_count(C.items(c, bbox=[100, 10, 101, 11])).first()
    assert row["id"] is None and row["number_matched"] == 0
