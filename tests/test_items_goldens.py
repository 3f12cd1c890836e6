"""Goldens carried over from the reference's integration tests (FIXTURES.md 1)."""

import pytest
from pyspark.sql import functions as F

from geoplane.functions import crs as CRS
from geoplane.functions.geometry import Geom
from geoplane.operators import predicates as P
from geoplane.operators import spatial as S
from geoplane.plans import collection as C

from .fixtures import cities, events, point_collection, sites


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_bbox_only_paris(spark):
    res = C.items(sites(spark), bbox=[1, 48, 3, 49])
    assert names(res.page) == ["Paris"]
    assert res.number_matched() == 1


def test_bbox_corners_reordered(spark):
    # minx > maxx does not wrap: the corners are re-ordered
    res = C.items(sites(spark), bbox=[3, 49, 1, 48])
    assert names(res.page) == ["Paris"]


def test_bbox_wrong_arity_ignored(spark):
    assert C.items(sites(spark), bbox=[1, 48, 3]).number_matched() == 3


def test_radius_small_and_large(spark):
    s = sites(spark)
    assert names(C.items(s, lat=48.86, lon=2.35, radius=1000).page) == ["Paris"]
    big = names(C.items(s, lat=47.0, lon=3.5, radius=500000).page)
    assert "Paris" in big and "Lyon" in big


def test_point_query_and_range_check(spark):
    s = sites(spark)
    assert names(C.items(s, lat=48.86, lon=2.35).page) == ["Paris"]
    with pytest.raises(ValueError):
        C.items(s, lat=91, lon=2.35)
    with pytest.raises(ValueError):
        C.items(s, lat=48.0, lon=2.0, radius=-5)
    with pytest.raises(ValueError, match="radius requires"):
        C.items(s, radius=1000)
    with pytest.raises(ValueError):
        C.items(s, lat=48.0)


def test_paging_links(spark):
    s = sites(spark)
    r = C.items(s, limit=2)
    assert r.page.count() == 2
    links = r.links()
    assert links["next"] == 2 and "prev" not in links and links["last"] == 2
    r2 = C.items(s, limit=2, offset=2)
    assert r2.page.count() == 1
    l2 = r2.links()
    assert "next" not in l2 and l2["prev"] == 0


def test_limit_clamps():
    assert C.clamp_limit(0) == 25 and C.clamp_limit("junk") == 25
    assert C.clamp_limit(-3) == 1 and C.clamp_limit(1000) == 100
    assert C.clamp_offset(-4) == 0


def test_pages_concatenate_to_full_order(spark):
    c = cities(spark)
    ids = []
    for off in range(0, 5, 2):
        ids += [r["id"] for r in C.items(c, limit=2, offset=off).page.collect()]
    assert ids == [1, 2, 3, 4, 5]


def test_datetime_instant_and_intervals(spark):
    e = events(spark)
    assert names(C.items(e, datetime="2024-01-15").page) == ["A"]
    assert names(C.items(e, datetime="2024-01-01/2024-12-31").page) == ["A", "B"]
    assert names(C.items(e, datetime="2025-01-01/..").page) == ["C"]
    # end date means its midnight
    assert names(C.items(e, datetime="2024-01-01/2024-06-20").page) == ["A"]


def test_datetime_needs_column(spark):
    with pytest.raises(ValueError):
        C.items(sites(spark), datetime="2024-01-15")


def test_output_crs_3857(spark):
    s = sites(spark)
    crs = "http://www.opengis.net/def/crs/EPSG/0/3857"
    g = C.output_geometry(s, CRS.check_supported(s.srid, crs))
    row = s.df.filter(F.col("name") == "Paris").select(g["parts"][0][0][0].alias("v")).first()["v"]
    assert 200000 < row["x"] < 300000 and 6200000 < row["y"] < 6300000


def test_unsupported_crs(spark):
    with pytest.raises(ValueError):
        C.items(sites(spark), crs="http://www.opengis.net/def/crs/EPSG/0/9999")


def test_exposed_fields_alias(spark):
    rows = [(1, "Paris", 2161000, "SEC-75", 2.35, 48.86), (2, "Lyon", 522969, "SEC-69", 4.83, 45.76)]
    c = point_collection(spark, rows, "id int, name string, population int, secret_code string, lon double, lat double",
                         exposed_fields=[("name", "city"), ("population", None)])
    page = C.items(c).page
    assert set(page.columns) == {"id", "city", "population", "geometry"}
    q = {r["name"]: r["type"] for r in C.queryables(c).collect()}
    assert q == {"geometry": "geometry", "city": "string", "population": "integer"}
    # hidden columns stay filterable
    assert C.items(c, P.eq(c.df, "secret_code", "SEC-75")).number_matched() == 1


def test_empty_exposed_list_means_all(spark):
    c = sites(spark)
    c.exposed_fields = []
    assert "name" in C.items(c).page.columns


def test_unknown_property(spark):
    with pytest.raises(ValueError, match="Unknown property"):
        P.eq(sites(spark).df, "nope", 1)


def test_feature_by_id(spark):
    s = sites(spark)
    assert C.feature_by_id(s, "2").first()["name"] == "Lyon"
    assert C.feature_by_id(s, 99).count() == 0


def test_geojson_and_wkt_text(spark):
    s = sites(spark)
    page = C.items(s, P.eq(s.df, "name", "Paris")).page.first()
    assert page["geometry"] == '{"type":"Point","coordinates":[2.35,48.86]}'
    res = C.items(s, P.eq(s.df, "name", "Paris"), geometry_as="wkt").page.first()
    assert res["geometry"] == "POINT(2.35 48.86)"


def test_spatial_literal_predicates(spark):
    c = cities(spark)
    france_north = Geom.from_wkt("POLYGON((-2 46, 6 46, 6 50, -2 50, -2 46))")
    got = names(c.df.filter(S.relate_literal(c, "s_within", france_north)))
    assert got == ["Nantes", "Paris"]
    disj = names(c.df.filter(S.relate_literal(c, "s_disjoint", france_north)))
    assert disj == ["Lyon", "Marseille", "Toulouse"]
    line = Geom.from_wkt("LINESTRING(2.35 48.86, 4.83 45.76)")
    assert names(c.df.filter(S.relate_literal(c, "s_touches", line))) == ["Lyon", "Paris"]
    assert names(c.df.filter(S.relate_literal(c, "s_equals", Geom.point(4.83, 45.76)))) == ["Lyon"]


def test_collection_metadata_lists_crs(spark):
    assert CRS.supported_crs(2154) == [CRS.CRS84_URI] + [CRS.srid_to_uri(x) for x in (4326, 3857, 2154)]
    s = sites(spark)
    assert CRS.check_supported(s.srid, None) == 4326
    assert CRS.check_supported(s.srid, "http://www.opengis.net/def/crs/EPSG/0/2154") == 2154
