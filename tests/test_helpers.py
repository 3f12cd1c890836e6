"""Small operators: tile matrix, tileset metadata, CRS URIs, id split, registration, PRJ-3, SPA-4 on polygons."""

import pytest
from pyspark.sql import functions as F

from geoplane.functions import crs as CRS
from geoplane.functions import geometry as G
from geoplane.operators import catalog as CT
from geoplane.operators import spatial as S
from geoplane.operators import tiles as TL
from geoplane.plans import collection as C
from geoplane.sources import text as TX

from .fixtures import sites


def test_tile_matrix(spark):
    rows = {r["z"]: r for r in TL.tile_matrix(spark).collect()}
    assert len(rows) == 25
    assert rows[0]["scale_denominator"] == pytest.approx(559082264.0287178)
    assert rows[3]["matrix_width"] == 8 and rows[0]["origin_x"] == pytest.approx(-20037508.3427892)
    env = spark.range(1).select(*[v.alias(k) for k, v in TL.tile_envelope(F.lit(1), F.lit(0), F.lit(0)).items()]).first()
    assert env["txmin"] == pytest.approx(-20037508.342789244) and env["tymax"] == pytest.approx(20037508.342789244)
    assert env["txmax"] == pytest.approx(0.0, abs=1e-6)


def test_crs_uris():
    assert CRS.srid_to_uri(2154) == "http://www.opengis.net/def/crs/EPSG/0/2154"
    assert CRS.uri_to_srid(CRS.CRS84_URI) == 4326
    assert CRS.uri_to_srid("http://www.opengis.net/def/crs/EPSG/0/4326abc") == 4326
    assert CRS.uri_to_srid("urn:ogc:def:crs:EPSG::4326") is None
    assert CRS.supported_crs(4326) == [CRS.CRS84_URI] + [CRS.srid_to_uri(s) for s in (4326, 3857, 2154)]
    assert CRS.supported_crs(32631)[-1].endswith("/32631")
    assert CRS.resolve_output_srid(None) == (4326, CRS.CRS84_URI)
    with pytest.raises(ValueError):
        CRS.resolve_output_srid("nope")


def test_collection_id_split(spark):
    df = spark.createDataFrame([("ws:name:x",), ("plain",)], "cid string")
    ws, name = TX.split_collection_id(F.col("cid"))
    out = [tuple(r) for r in df.select(ws, name).collect()]
    assert out == [("ws", "name:x"), (None, None)]
    assert C.parse_collection_id("a:b:c") == ("a", "b:c")
    with pytest.raises(ValueError, match="not found"):
        C.parse_collection_id("plain")


def test_register_and_exposed_types(spark):
    df = spark.createDataFrame([(1, "a", 2.5)], "gid int, label string, v double").withColumn(
        "shape", G.point(F.lit(1.0), F.lit(2.0)))
    c = C.register_collection(df, "ext", geometry_column="shape", id_column="gid")
    assert set(G.bbox_columns(F.col("shape"))) <= set(c.df.columns)
    assert C.exposed_columns_with_types(c) == [("label", "string"), ("v", "double")]
    c.exposed_fields = [("label", "name"), ("missing", None)]
    assert C.exposed_columns_with_types(c) == [("name", "string"), ("missing", "string")]
    with pytest.raises(ValueError):
        C.register_collection(df, "bad", geometry_column="nope")


def test_tileset_metadata(spark):
    ws = spark.createDataFrame([(1, "geo")], "id int, name string")
    cols = spark.createDataFrame([(10, 1, "towns", 4326, 1.0, 2.0, 3.0, 4.0), (11, 1, "empty", 2154, None, None, None, None)],
                                 "id int, workspace_id int, name string, srid int, xmin double, ymin double, xmax double, ymax double")
    meta = {r["id"]: r for r in CT.tileset_metadata(cols, ws, "http://h").collect()}
    assert meta["geo:towns"]["url"] == "http://h/collections/geo:towns/tiles/{z}/{x}/{y}.pbf"
    assert list(meta["geo:towns"]["bounding_box"]) == [1.0, 2.0, 3.0, 4.0]
    assert meta["geo:empty"]["bounding_box"] is None
    md = {r["id"]: r for r in CT.collection_metadata(cols, ws).collect()}
    assert len(md["geo:empty"]["crs"]) == 4 and md["geo:empty"]["extent_bbox"] is None


def test_radius_on_polygons(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
                     for x, y in [(2.0, 48.0), (2.1, 48.0), (2.1, 48.1), (2.0, 48.1), (2.0, 48.0)]])
    df = spark.createDataFrame([(1,)], "id int").withColumn(
        "geom", F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts")))
    c = C.Collection(G.with_bbox(df), name="sq", geometry_type="Polygon")
    # point 1.2 km east of the square's east edge
    assert c.df.filter(S.radius(c, 2.1165, 48.05, 1500)).count() == 1
    assert c.df.filter(S.radius(c, 2.1165, 48.05, 1000)).count() == 0
    assert c.df.filter(S.radius(c, 2.05, 48.05, 1)).count() == 1          # inside


def test_items_point_on_polygon_boundary(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
                     for x, y in [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]])
    df = spark.createDataFrame([(1,)], "id int").withColumn(
        "geom", F.struct(F.lit("Polygon").alias("type"), F.lit(4326).alias("srid"), F.array(F.array(ring)).alias("parts")))
    c = C.Collection(G.with_bbox(df), name="unit", geometry_type="Polygon")
    assert C.items(c, lon=1.0, lat=0.5).number_matched() == 1     # boundary counts
    assert C.items(c, lon=0.5, lat=0.5).number_matched() == 1
    assert C.items(c, lon=1.5, lat=0.5).number_matched() == 0


def test_sites_sample_extent(spark):
    from geoplane.operators import profile as PF
    r = PF.sample_extent(sites(spark), 2).first()
    assert (r["xmin"], r["xmax"]) == (2.35, 4.83)


def test_filter_column_sets(spark):
    from geoplane.operators import predicates as P
    from geoplane.sources.export import export_filter_columns
    s = sites(spark)
    allowed = C.items_filter_columns(s)
    assert "id" not in allowed and "name" in allowed
    with pytest.raises(ValueError, match="Unknown property"):
        P.eq(s.df, "id", 1, allowed=allowed)
    assert "id" in export_filter_columns(s) and "geom" not in export_filter_columns(s)
    assert s.df.filter(P.eq(s.df, "id", 1, allowed=export_filter_columns(s))).count() == 1


def test_literal_transformed_to_storage_srid(spark):
    """s_contains / s_intersects / bbox on a collection stored in EPSG:2154 with 4326 literals."""
    from geoplane.functions.geometry import Geom, point, with_bbox
    from geoplane.operators import predicates as P
    s = sites(spark)
    x, y = CRS.transform_xy(F.col("_xmin"), F.col("_ymin"), 4326, 2154)
    df = with_bbox(s.df.select("id", "name", point(x, y, 2154).alias("geom")))
    l93 = C.Collection(df, name="sites_l93", srid=2154)
    paris_area = Geom.from_wkt("POLYGON((2 48.5, 2.7 48.5, 2.7 49.2, 2 49.2, 2 48.5))")
    assert [r["name"] for r in l93.df.filter(S.relate_literal(l93, "s_intersects", paris_area)).collect()] == ["Paris"]
    assert C.items(l93, bbox=[1, 48, 3, 49]).page.first()["name"] == "Paris"
    assert C.items(l93, lat=45.76, lon=4.83, radius=1000).page.first()["name"] == "Lyon"
    assert l93.df.filter(P.eq(l93.df, "name", "it's")).count() == 0       # quotes need no escaping


def test_collection_history_literal_and_batch(spark):
    from geoplane.plans import tables as T
    h = T.history(spark, "/root/testdata/sf0.001")
    one = [r["id"] for r in CT.collection_history(h, 7).collect()]
    allh = [r["id"] for r in CT.collection_histories(h).filter("collection_id = 7").collect()]
    assert one == allh and len(one) > 0
