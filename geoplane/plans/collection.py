"""Feature collections and the items query (SRC-5, SRC-6, PRJ-1..4, PRJ-7,
PAG-1..3, SNK-3, SNK-4, JN-3, AGG-1, SPA-14).

A :class:`Collection` is a DataFrame plus the configuration the reference
keeps in its ``collections`` table.  :func:`items` assembles one declarative
plan: ``scan -> filter(bbox & point/radius & datetime & predicate) ->
project -> order by id -> offset/limit``; the match count is a second
aggregate over the same filtered frame with the geometry pruned away.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as _crs
from ..functions import geometry as G
from ..operators import predicates as P
from ..operators import spatial as S
from ..schema import BBOX_COLUMNS, json_type

# Page size default and maximum.
DEFAULT_LIMIT = 25
MAX_LIMIT = 100


@dataclass
class Collection:
    df: DataFrame
    name: str
    geometry_type: str = "Point"
    srid: int = 4326
    id_column: str = "id"
    geometry_column: str = "geom"
    datetime_column: str | None = None
    exposed_fields: list | None = None       # [(source, alias|None), ...] or None
    workspace: str = "default"
    title: str | None = None
    description: str | None = None

    @property
    def collection_id(self) -> str:
        return f"{self.workspace}:{self.name}"

    def with_df(self, df: DataFrame) -> "Collection":
        return replace(self, df=df)

    # ------------------------------------------------------------ PRJ-3
    def property_columns(self) -> list[str]:
        hidden = {self.id_column, self.geometry_column, *BBOX_COLUMNS}
        return [c for c in self.df.columns if c not in hidden]

    def exposed_columns(self) -> list[tuple[str, str]]:
        """(source, output name) of the published properties.

        ``None`` *or an empty list* means every non-id/geometry column (the
        reference's code path; its docs claim otherwise).  Unknown sources are
        published as text nulls by :func:`project_properties`.
        """
        if not self.exposed_fields:
            return [(c, c) for c in self.property_columns()]
        out = []
        for f in self.exposed_fields:
            src, alias = (f, None) if isinstance(f, str) else (f[0], f[1] if len(f) > 1 else None)
            out.append((src, alias or src))
        return out


def register_collection(df: DataFrame, name: str, geometry_column: str = "geom", id_column: str = "id",
                        srid: int = 4326, geometry_type: str | None = None, **kw) -> Collection:
    """SRC-6: publish an existing table with defaults geom / id / 4326.

    Missing bbox columns are derived from the geometry.
    """
    if geometry_column not in df.columns:
        raise ValueError(f"Geometry column {geometry_column!r} not found")
    if id_column not in df.columns:
        raise ValueError(f"Id column {id_column!r} not found")
    if not set(BBOX_COLUMNS) <= set(df.columns):
        df = G.with_bbox(df, geometry_column)
    return Collection(df=df, name=name, geometry_column=geometry_column, id_column=id_column,
                      srid=srid, geometry_type=geometry_type or "Geometry", **kw)


def parse_collection_id(cid: str) -> tuple[str, str]:
    """``ws:name`` split at the first colon; an id without a colon names no collection."""
    if ":" not in cid:
        raise ValueError("Collection not found")
    ws, name = cid.split(":", 1)
    return ws, name


# ---------------------------------------------------------------- projections
def project_properties(coll: Collection, as_text: bool = False) -> list[Column]:
    """PRJ-1/PRJ-2 (and PRJ-10 when ``as_text``): exposed properties with aliases."""
    cols = set(coll.df.columns)
    out = []
    for src, alias in coll.exposed_columns():
        c = F.col(f"`{src}`") if src in cols else F.lit(None).cast("string")
        out.append((c.cast("string") if as_text else c).alias(alias))
    return out


def properties_json(coll: Collection) -> Column:
    """PRJ-1: properties as one JSON object; nulls kept (JSONB keeps them)."""
    props = project_properties(coll)
    if not props:
        return F.lit("{}")
    return F.to_json(F.struct(*props), {"ignoreNullFields": "false"})


def queryables(coll: Collection) -> DataFrame:
    """PRJ-4: (name, title, type) rows; ``geometry`` first, then every exposed field."""
    spark = coll.df.sparkSession
    types = {f.name: f.dataType for f in coll.df.schema.fields}
    rows = [("geometry", "geometry", "geometry")]
    for src, alias in coll.exposed_columns():
        rows.append((alias, alias, json_type(types[src]) if src in types else "string"))
    return spark.createDataFrame(rows, "name string, title string, type string")


def output_geometry(coll: Collection, out_srid: int) -> Column:
    """PRJ-7: reproject only when the output SRID differs from storage."""
    return G.transform_geom(F.col(coll.geometry_column), coll.srid, out_srid)


# ---------------------------------------------------------------- items
def clamp_limit(limit) -> int:
    """PAG-1: default 25, clamp 1..100; 0 or junk -> 25, negative -> 1."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        return DEFAULT_LIMIT
    if n == 0:
        return DEFAULT_LIMIT
    return max(1, min(n, MAX_LIMIT))


def clamp_offset(offset) -> int:
    try:
        return max(0, int(offset))
    except (TypeError, ValueError):
        return 0


def items_filter(coll: Collection, where: Column | None = None, bbox=None, bbox_crs=None,
                 lon: float | None = None, lat: float | None = None, radius: float | None = None,
                 datetime: str | None = None) -> Column:
    """SPA-14: bbox AND point/radius AND datetime AND the predicate, all ANDed."""
    conds = []
    if bbox is not None:
        conds.append(S.bbox(coll, bbox, bbox_crs))
    if radius is not None and (lon is None or lat is None):
        raise ValueError("radius requires lat and lon")
    if lon is not None or lat is not None:
        if lon is None or lat is None:
            raise ValueError("lat and lon are both required")
        if radius is not None:
            conds.append(S.radius(coll, float(lon), float(lat), float(radius)))
        else:
            conds.append(S.point_intersects(coll, float(lon), float(lat)))
    if datetime:
        conds.append(P.datetime_param(coll.df, coll.datetime_column, datetime))
    if where is not None:
        conds.append(where)
    return P.all_of(*conds)


@dataclass
class ItemsResult:
    page: DataFrame           # id, properties..., geometry (output CRS) ordered by id
    matched: DataFrame        # one row: number_matched
    limit: int
    offset: int
    extra: dict = field(default_factory=dict)

    def number_matched(self) -> int:
        return int(self.matched.first()[0])

    def links(self, n_matched: int | None = None) -> dict:
        """PAG-3: self always; next if o+l<n; prev if o>0 at max(o-l,0); first; last."""
        n = self.number_matched() if n_matched is None else n_matched
        return page_links(n, self.limit, self.offset)


def page_links(n: int, limit: int, offset: int) -> dict:
    out = {"self": offset, "first": 0}
    if offset + limit < n:
        out["next"] = offset + limit
    if offset > 0:
        out["prev"] = max(offset - limit, 0)
    if n > 0:
        out["last"] = ((n - 1) // limit) * limit
    return out


# Offsets up to this are skipped by one top-k task; deeper ones are found by rank first.
TOP_OFFSET = 10_000


def page_of(df: DataFrame, order_col: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset + limit`` of the ascending order of ``order_col`` (nulls last).

    A plain top-k keeps offset + limit rows in one task.  Behind ``TOP_OFFSET``
    the value at the offset is located by :func:`select_ranks` instead, and
    only rows from that value on are ordered; the page is the same.
    """
    if offset > TOP_OFFSET:
        from ..operators.profile import select_ranks
        filled = df.filter(F.col(order_col).isNotNull()).count()
        if offset >= filled:
            return df.filter(F.col(order_col).isNull()).offset(offset - filled).limit(limit)
        value, below = select_ranks(df.select(order_col), order_col, [offset])[offset]
        df = df.filter((F.col(order_col) >= F.lit(value)) | F.col(order_col).isNull())
        offset -= below
    return df.orderBy(F.col(order_col).asc_nulls_last()).offset(offset).limit(limit)


def items(coll: Collection, where: Column | None = None, *, bbox=None, bbox_crs=None, lon=None, lat=None,
          radius=None, datetime=None, crs: str | None = None, limit=DEFAULT_LIMIT, offset=0,
          geometry_as: str = "geojson") -> ItemsResult:
    """The items query.  ``where`` is a Column built with the predicate builders."""
    out_srid = _crs.check_supported(coll.srid, crs)
    lim, off = clamp_limit(limit), clamp_offset(offset)
    filtered = coll.df.filter(items_filter(coll, where, bbox, bbox_crs, lon, lat, radius, datetime))
    geom = output_geometry(coll, out_srid)
    geom_text = G.to_geojson(geom) if geometry_as == "geojson" else G.to_wkt(geom)
    page = (filtered
            .select(F.col(coll.id_column).alias("id"), *project_properties(coll), geom_text.alias("geometry"))
            .transform(lambda d: page_of(d, "id", off, lim)))
    matched = filtered.select(F.count(F.lit(1)).alias("number_matched"))
    return ItemsResult(page=page, matched=matched, limit=lim, offset=off)


def page_with_count(result: ItemsResult) -> DataFrame:
    """JN-3 / SNK-3 as one frame: the page plus numberMatched / numberReturned columns.

    numberMatched is one aggregate (a scalar action over the filtered frame
    without geometry); numberReturned follows from it, the limit and the
    offset.  An empty page still reports its counts: one row whose feature
    columns are null, as the reference's ``RIGHT JOIN ... ON TRUE`` does.
    """
    n = result.number_matched()
    returned = max(0, min(result.limit, n - result.offset))
    counts = {"number_matched": F.lit(n).cast("bigint"), "number_returned": F.lit(returned).cast("bigint")}
    if returned > 0:
        return result.page.withColumns(counts)
    from pyspark.sql.types import StructField, StructType
    spark = result.page.sparkSession
    schema = StructType([StructField(f.name, f.dataType, True) for f in result.page.schema.fields])
    empty = spark.createDataFrame([tuple(None for _ in result.page.columns)], schema)
    return empty.withColumns(counts)


# ---------------------------------------------------------------- SNK-4 / JN-9
def feature_by_id(coll: Collection, fid, crs: str | None = None) -> DataFrame:
    """SNK-4: equality on the id column (literal cast to the id type)."""
    out_srid = 4326 if not crs else _crs.resolve_output_srid(crs)[0]
    id_col, dt = P.resolve(coll.df, coll.id_column)
    geom = output_geometry(coll, out_srid)
    return (coll.df.filter(id_col == P.typed_lit(fid, dt))
            .select(id_col.alias("id"), *project_properties(coll), G.to_geojson(geom).alias("geometry")))


def features_by_ids(coll: Collection, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """JN-9 batch id lookup: left-semi join of the features with an id table."""
    dt = dict(coll.df.dtypes)[coll.id_column]
    keys = ids.select(F.col(id_col).cast(dt).alias("__id")).distinct()
    return coll.df.join(keys, F.col(coll.id_column) == F.col("__id"), "left_semi")


def n_pages(n: int, limit: int) -> int:
    return math.ceil(n / limit) if limit else 0


def batch_pages(pairs: DataFrame, group_col: str, order_col: str = "id", limit: int = DEFAULT_LIMIT,
                offset: int = 0) -> DataFrame:
    """PAG-1 batch form: the page (offset, limit) of every request, ordered by id.

    ``row_number() <= k`` over a window lets Spark insert a per-partition
    group limit before the shuffle, so a request matching a huge share of
    the features still ships at most ``offset + limit`` rows per map task.
    """
    from pyspark.sql import Window
    lim, off = clamp_limit(limit), clamp_offset(offset)
    w = Window.partitionBy(group_col).orderBy(F.col(order_col).asc_nulls_last())
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("rank") > off) & (F.col("rank") <= off + lim)).select(group_col, order_col, "rank")


def exposed_columns_with_types(coll: Collection) -> list[tuple[str, str]]:
    """PRJ-3: (output name, column type) of the published properties in order;
    an exposed source that is not a column is published as text."""
    types = {f.name: f.dataType.simpleString() for f in coll.df.schema.fields}
    return [(alias, types.get(src, "string")) for src, alias in coll.exposed_columns()]


def items_filter_columns(coll: Collection) -> list[str]:
    """Properties an items filter may name: every column but the id (hidden ones included,
    aliases not) -- pass as ``allowed=`` to the predicate builders."""
    return [c for c in coll.df.columns if c not in (coll.id_column, *BBOX_COLUMNS)]
