"""Mapbox Vector Tile bytes for a whole pyramid (TIL-5, AGG-12).

One layer per tile, named after the collection; properties as text; no
feature id; extent 4096; geometry clipped to the tile buffered by 256 units
and quantised with y pointing down.

Everything is JVM expressions (protobuf as hex text, varints by bit
arithmetic): points take the tiles of their bbox, lines and areas come clipped
from the quadtree descent (:mod:`quadtree`).

Scale plan: a tile's features are spread over ``salt`` chunks.  A small
aggregate counts the property values of each chunk, so every chunk knows
the offset of its values in the layer's value table before encoding.  The
chunks are encoded in parallel.  :func:`tile_parts` returns them as they are,
with as many chunks a tile as keep each one small, so a tile of any size is
never in one row or task; :func:`tile_blobs` concatenates the ``salt`` texts of
each tile to the bytes that one request answers.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quadtree as QT
from . import tiles as TL

EXTENT = TL.EXTENT
BUFFER = TL.BUFFER


# ---------------------------------------------------------------- protobuf primitives
def varint(n: int) -> bytes:
    out = bytearray()
    n = int(n)
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def field_key(num: int, wire: int) -> bytes:
    return varint((num << 3) | wire)


def ld(num: int, payload: bytes) -> bytes:
    return field_key(num, 2) + varint(len(payload)) + payload


# ---------------------------------------------------------------- Spark plan
PART_FEATURES = 2048           # mean features of a part in the fullest tile of a zoom


def _features(coll, zooms, props: list[str]) -> DataFrame:
    """(tile, feature) rows; mixed geometries go as points, lines and areas, each by its own plan."""
    parts = [(_point_features if family == "Point" else _shape_features)(c, zooms, props)
             for family, c in TL.families(coll)]
    return reduce(DataFrame.unionByName, parts)


def _slim(coll, props: list[str] | None):
    """The collection with its id, geometry, box and the properties as text; and the properties' names."""
    if props is None:
        props = [a for _, a in coll.exposed_columns()]
    sources = dict((a, s) for s, a in coll.exposed_columns())
    return replace(coll, df=coll.df.select(
        *[F.col(c) for c in ("_xmin", "_ymin", "_xmax", "_ymax")],
        F.col(coll.id_column).alias("__id"), F.col(coll.geometry_column).alias("__g"),
        *[F.col(sources.get(p, p)).cast("string").alias(p) for p in props]), id_column="__id", geometry_column="__g"), props


def tile_blobs(coll, zooms, props: list[str] | None = None, salt: int = 8, layer: str | None = None,
               only: DataFrame | None = None) -> DataFrame:
    """TIL-5 / AGG-12: (z, x, y, mvt binary) for every non-empty tile of the zoom range
    (or only the tiles listed in ``only``: a semi-join before any encoding work).

    A collection of mixed geometries goes as points, lines and areas, each by its own plan, into the same tiles.
    A tile is one value here; whole pyramids of large collections go by :func:`tile_parts`.
    """
    slim, props = _slim(coll, props)
    return _assemble(_features(slim, zooms, props), props, salt, layer or coll.name, only)


def part_counts(coll, zooms, features: int = PART_FEATURES) -> dict[int, int]:
    """Parts of a tile at each zoom: its fullest tile's features over ``features`` (at most 31 rows come back)."""
    zooms = sorted({int(z) for z in zooms})
    total = coll.df.count()
    if total <= features:
        return dict.fromkeys(zooms, 1)
    peak = TL.pyramid_counts(coll, zooms).groupBy("z").agg(F.max("n_features").alias("n")).collect()
    return dict.fromkeys(zooms, 1) | {int(r["z"]): -(-int(r["n"]) // features) for r in peak}


def tile_parts(coll, zooms, props: list[str] | None = None, salt: int | dict[int, int] | None = None,
               only: DataFrame | None = None) -> DataFrame:
    """TIL-5 / AGG-12 for tiles of any size: (z, x, y, part, first_value, features, values), each part a bounded row.

    ``features`` and ``values`` are encoded messages of the layer; the tags of
    a part's features name only values of that part, which start at index
    ``first_value`` of the tile's value table.  A tile's bytes are
    :func:`layer_head` of its size, the features of its parts in order, their
    values in order, and :data:`LAYER_TAIL`: those of :func:`tile_blobs` with
    the same ``salt``.  Without ``salt``, :func:`part_counts` says how many
    parts each zoom has; points are then cut in parts where they lie
    (:func:`_point_parts`), so that a point moves once, not once a tile.
    """
    slim, props = _slim(coll, props)
    if salt is None and only is None and coll.geometry_type == "Point":
        return _point_parts(slim, sorted({int(z) for z in zooms}), props)
    salt = part_counts(slim, zooms) if salt is None else salt
    return _chunks(_features(slim, zooms, props), props, salt, only).select(
        "z", "x", "y", F.col("__chunk").alias("part"), F.col("__base").alias("first_value"),
        F.unhex("__f").alias("features"), F.unhex("__v").alias("values"))


LAYER_TAIL = field_key(5, 0) + varint(EXTENT) + field_key(15, 0) + varint(2)


def layer_head(layer: str, props: list[str], n_bytes: int) -> bytes:
    """What stands before a tile's features, whose features and values have ``n_bytes`` bytes."""
    names = ld(1, layer.encode()) + b"".join(ld(3, p.encode()) for p in props)
    return field_key(3, 2) + varint(len(names) + n_bytes + len(LAYER_TAIL)) + names


# ---------------------------------------------------------------- decoder (tests, inspection)
def decode(blob: bytes) -> list[dict]:
    """Minimal MVT decoder: layers with name, keys, values and features (type, tags, geometry ints)."""
    def read_varint(b, i):
        shift = n = 0
        while True:
            c = b[i]
            i += 1
            n |= (c & 0x7F) << shift
            shift += 7
            if not c & 0x80:
                return n, i

    def fields(b):
        i = 0
        while i < len(b):
            key, i = read_varint(b, i)
            num, wire = key >> 3, key & 7
            if wire == 0:
                v, i = read_varint(b, i)
            elif wire == 2:
                ln, i = read_varint(b, i)
                v, i = b[i:i + ln], i + ln
            else:
                raise ValueError("unsupported wire type")
            yield num, v

    def unpack(b):
        out, i = [], 0
        while i < len(b):
            v, i = read_varint(b, i)
            out.append(v)
        return out

    layers = []
    for num, v in fields(blob):
        if num != 3:
            continue
        lay = {"name": None, "keys": [], "values": [], "features": [], "extent": None, "version": None}
        for n2, v2 in fields(v):
            if n2 == 1:
                lay["name"] = v2.decode()
            elif n2 == 3:
                lay["keys"].append(v2.decode())
            elif n2 == 4:
                lay["values"].append(next(v3.decode() for n3, v3 in fields(v2) if n3 == 1))
            elif n2 == 5:
                lay["extent"] = v2
            elif n2 == 15:
                lay["version"] = v2
            elif n2 == 2:
                f = {"tags": [], "type": None, "geometry": []}
                for n3, v3 in fields(v2):
                    if n3 == 2:
                        f["tags"] = unpack(v3)
                    elif n3 == 3:
                        f["type"] = v3
                    elif n3 == 4:
                        f["geometry"] = unpack(v3)
                lay["features"].append(f)
        layers.append(lay)
    return layers


# ---------------------------------------------------------------- hex protobuf
def varint_hex(v: Column, max_bytes: int = 6) -> Column:
    """Protobuf varint of a non-negative integer Column below 2^(7 ``max_bytes``) as upper-case hex text.

    All groups of seven bits are laid out once, the lowest first; its length says which bytes are marked and
    which are cut off.  Two bytes and more are one number whose first byte is 0x80 at least, so its hex has every
    digit.  A known bound keeps the code short: generated methods beyond 8,000 bytes are never compiled.
    """
    v = v.cast("bigint")
    one = F.lpad(F.hex(v), 2, "0")
    if max_bytes == 1:
        return one
    laid = reduce(Column.bitwiseOR, [F.shiftleft(F.shiftright(v, 7 * i).bitwiseAND(F.lit(0x7F)).cast("bigint"), 8 * (max_bytes - 1 - i))
                                     for i in range(max_bytes)])

    def by_length(of) -> Column:
        if max_bytes == 2:
            return F.lit(of(2))
        out = F.when(v < 1 << 14, F.lit(of(2)))
        for n in range(3, max_bytes):
            out = out.when(v < 1 << 7 * n, F.lit(of(n)))
        return out.otherwise(F.lit(of(max_bytes)))

    marks = by_length(lambda n: sum(0x80 << 8 * (max_bytes - 1 - i) for i in range(n - 1))).cast("bigint")
    number = laid.bitwiseOR(marks)
    if max_bytes > 2:
        number = F.call_function("shiftright", number, by_length(lambda n: 8 * (max_bytes - n)))
    return F.when(v < 0x80, one).otherwise(F.hex(number))


def _ld_hex(field: int, payload_hex: Column, max_bytes: int = 6) -> Column:
    """Length-delimited field (hex) around a hex payload, whose length is a varint of ``max_bytes`` at most."""
    key = f"{(field << 3) | 2:02X}"
    return F.concat(F.lit(key), varint_hex(F.shiftright(F.octet_length(payload_hex), 1), max_bytes), payload_hex)


def _zigzag(c: Column) -> Column:
    c = c.cast("bigint")
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def _point_features(coll, zooms, props: list[str]) -> DataFrame:
    """(tile, point feature) rows for :func:`_assemble`: the vertices inside the buffered tile, quantised, as commands."""
    if coll.geometry_type == "Point":
        return _single_points(coll, zooms, props)
    from ..functions.geometry import transform_geom
    # reprojected once a feature, before it is copied into its tiles
    merc = transform_geom(F.col("__g"), coll.srid, 3857)
    t = TL.assign_tiles(replace(coll, df=coll.df.withColumn("__g", merc)), zooms, ["__id", "__g", *props])
    t = t.select("z", "x", "y", "__id", "__g", *props).filter(F.col("__g").isNotNull())
    # tile-local coordinates of every vertex; keep those inside the buffered tile (before rounding)
    w = TL.tile_width(F.col("z"))
    txmin = F.col("x") * w - TL.H
    tymax = F.lit(TL.H) - F.col("y") * w
    fx = lambda v: (v["x"] - txmin) / w * EXTENT
    fy = lambda v: (tymax - v["y"]) / w * EXTENT
    inside = lambda v: ((fx(v) >= -BUFFER) & (fx(v) <= EXTENT + BUFFER)
                        & (fy(v) >= -BUFFER) & (fy(v) <= EXTENT + BUFFER))
    vs = F.transform(F.col("__g")["parts"], lambda part: part[0][0])
    q = F.transform(F.filter(vs, inside), lambda v: F.struct(F.floor(fx(v) + 0.5).alias("qx"),
                                                             F.floor(fy(v) + 0.5).alias("qy")))
    t = t.withColumn("__q", q).drop("__g")
    # Geometry: MoveTo(n) then zigzag deltas from the previous point (the first from 0, 0).
    qx = F.transform(F.col("__q"), lambda p: p["qx"])
    qy = F.transform(F.col("__q"), lambda p: p["qy"])
    n = F.size(F.col("__q"))
    rest = F.greatest(n - 1, F.lit(0))
    prevx = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(qx, 1, rest))
    prevy = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(qy, 1, rest))
    dx = F.zip_with(qx, prevx, lambda a, b: a - b)
    dy = F.zip_with(qy, prevy, lambda a, b: a - b)
    deltas = F.array_join(F.zip_with(dx, dy, lambda a, b: F.concat(varint_hex(_zigzag(a)), varint_hex(_zigzag(b)))), "")
    return t.select("z", "x", "y", "__id", *props, (n > 0).alias("__in"), F.lit("1801").alias("__kind"),
                    F.concat(varint_hex(F.lit(1).bitwiseOR(F.shiftleft(n.cast("bigint"), 3))), deltas).alias("__geom"))


def _single_points(coll, zooms, props: list[str]) -> DataFrame:
    """:func:`_point_features` of features of one vertex, which their box holds: plain columns, no arrays."""
    t = _quantised(coll, zooms, props)
    return t.select("z", "x", "y", "__id", *props, "__in", F.lit("1801").alias("__kind"),
                    F.concat(F.lit("09"), varint_hex(F.col("__qx")), varint_hex(F.col("__qy"))).alias("__geom"))


def _quantised(coll, zooms, keep: list[str]) -> DataFrame:
    """(tile, point) rows with ``keep``: whether the point is drawn, and its zigzag coordinates there."""
    t = TL.assign_wide(coll, zooms, ["__id", *keep])
    w = F.col("__w")
    fx = (F.col("mx1") - (F.col("x") * w - TL.H)) / w * EXTENT
    fy = ((F.lit(TL.H) - F.col("y") * w) - F.col("my1")) / w * EXTENT
    t = t.select("z", "x", "y", "__id", *keep, fx.alias("__fx"), fy.alias("__fy"))
    inside = F.col("__fx").between(-BUFFER, EXTENT + BUFFER) & F.col("__fy").between(-BUFFER, EXTENT + BUFFER)
    return t.select("z", "x", "y", "__id", *keep, F.coalesce(inside, F.lit(False)).alias("__in"),
                    *[_zigzag(F.floor(F.col(f"__f{a}") + 0.5)).alias(f"__q{a}") for a in "xy"])


def _commands(rings: Column, areas: bool) -> Column:
    """The command integers of rings or lines as hex: MoveTo, LineTo and, for rings, ClosePath."""
    flat = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda v, i: F.struct(
        v["x"].alias("x"), v["y"].alias("y"), i.alias("i"), F.size(r).alias("n")))))

    def step(v, before):
        lead = F.when(v["i"] == 0, F.lit("09")).when(
            v["i"] == 1, varint_hex(F.shiftleft((v["n"] - 1).cast("bigint"), 3).bitwiseOR(F.lit(2)))).otherwise(F.lit(""))
        close = F.when(v["i"] == v["n"] - 1, F.lit("0F")).otherwise(F.lit("")) if areas else F.lit("")
        return F.concat(lead, varint_hex(_zigzag(v["x"] - before["x"])), varint_hex(_zigzag(v["y"] - before["y"])), close)

    def hexed(f):
        origin = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"))
        at = F.transform(f, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
        return F.zip_with(f, F.concat(F.array(origin), F.slice(at, F.lit(1), F.size(f) - 1)), step)

    return F.array_join(F.get(F.transform(F.array(flat), hexed), F.lit(0)), "")


def _shape_features(coll, zooms, props: list[str]) -> DataFrame:
    """(tile, line or area) rows for :func:`_assemble`, clipped by the quadtree descent; a feature that
    keeps nothing after quantising has no part in the tile, its values neither."""
    areas = coll.geometry_type.endswith("Polygon")
    t = QT.tile_features(coll, zooms, ["__id", *props])
    return t.select("z", "x", "y", "__id", *props, F.lit(True).alias("__in"), F.lit("1803" if areas else "1802").alias("__kind"),
                    _commands(F.col("rings"), areas).alias("__geom"))


def _chunks(t: DataFrame, props: list[str], salt: int | dict[int, int], only: DataFrame | None) -> DataFrame:
    """Encoded chunks (z, x, y, __chunk, __base, __f, __v) from (z, x, y, __id, properties, __in, __kind,
    __geom): the geometry type field and the commands as hex; a feature with ``__in`` false keeps its
    values but is not drawn.

    The value index of each property is the chunk's offset plus a running sum
    within the chunk (a window over at most one chunk of one tile).
    """
    if only is not None:
        t = t.join(only.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_semi")
    n = F.lit(int(salt)) if isinstance(salt, int) else F.element_at(
        F.create_map(*[F.lit(int(k)) for pair in sorted(salt.items()) for k in pair]), F.col("z"))
    t = t.withColumn("__chunk", F.pmod(F.xxhash64("__id"), n).cast("int"))
    keys = ["z", "x", "y", "__chunk"]
    nonnull = [F.col(p).isNotNull().cast("int") for p in props]
    t = t.withColumn("__nv", sum(nonnull, F.lit(0)))
    # value-index base of every chunk inside its tile (one slim row a chunk)
    counts = t.groupBy(*keys).agg(F.sum("__nv").cast("long").alias("__cnv"))
    wc = Window.partitionBy("z", "x", "y").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__base", F.coalesce(F.sum("__cnv").over(wc), F.lit(0)).cast("long"))
    wf = Window.partitionBy(*keys).orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__before", F.coalesce(F.sum("__nv").over(wf), F.lit(0)))
    t = t.join(offsets.select(*keys, "__base").hint("merge"), keys)         # in the window's order: no other sort
    t = t.withColumn("__vstart", F.col("__base") + F.col("__before"))
    tags, texts, vals, before = [], [], [], F.lit(0)
    for k, p in enumerate(props):
        present = F.col(p).isNotNull()
        idx = F.col("__vstart") + before
        tags.append(F.when(present, F.concat(varint_hex(F.lit(k)), varint_hex(idx))).otherwise(F.lit("")))
        texts.append(F.when(present, F.concat(F.lit("0A"), varint_hex(F.octet_length(F.col(p))), F.hex(F.col(p))))
                     .alias(f"__m{k}"))
        vals.append(F.when(F.col(f"__m{k}").isNotNull(), _ld_hex(4, F.col(f"__m{k}"))).otherwise(F.lit("")))
        before = before + present.cast("int")
    # one projection per level of nesting: every hex piece is computed once
    t = t.select(*keys, "__base", "__id", "__in", "__kind", "__geom", *texts,
                 (F.concat(*tags) if tags else F.lit("")).alias("__tags"))
    t = t.select(*keys, "__base", "__id", "__in", (F.concat(*vals) if vals else F.lit("")).alias("__v"), F.concat(
        F.when(F.octet_length("__tags") > 0, _ld_hex(2, F.col("__tags"))).otherwise(F.lit("")),
        F.col("__kind"), _ld_hex(4, F.col("__geom"))).alias("__body"))
    t = t.select(*keys, "__base", "__id", "__v",
                 F.when(F.col("__in"), _ld_hex(2, F.col("__body"))).otherwise(F.lit("")).alias("__f"))
    chunks = t.groupBy(*keys, "__base").agg(
        F.sort_array(F.collect_list(F.struct("__id", "__f", "__v"))).alias("__rows"))
    return chunks.select(*keys, "__base", F.array_join(F.transform("__rows", lambda r: r["__f"]), "").alias("__f"),
                         F.array_join(F.transform("__rows", lambda r: r["__v"]), "").alias("__v"))


# Points of a group: one task sorts their rows in all tiles in some tens of MB.
GROUP_POINTS = 1 << 15
# Offsets of parts that are broadcast, at some 100 bytes each; more are joined by a shuffle.
BROADCAST_PARTS = 500_000
_GROUP = ("__gx", "__gy", "__gs")


def _point_groups(coll, zooms, props: list[str]) -> tuple[DataFrame, int, int]:
    """The points in Mercator with a group of neighbours each, the groups wanted, and a bound on (group, tile) pairs.

    A group is a tile of the deepest zoom with no more tiles than groups are wanted, dealt by the id where
    it holds more than ``GROUP_POINTS``: most tiles of deeper zooms lie in one group.
    """
    mx, my = TL._crs.transform_xy(F.col("_xmin"), F.col("_ymin"), coll.srid, 3857)
    df = coll.df.filter(F.col("_xmin").isNotNull()).select("__id", *props, mx.alias("_xmin"), my.alias("_ymin"))
    wanted = max(1, -(-coll.df.count() // GROUP_POINTS))
    counts = TL.pyramid_counts(coll, zooms)
    tiles = {r["z"]: r for r in counts.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.max("n_features").alias("most")).collect()}
    at = max((z for z, r in tiles.items() if r["n"] <= wanted), default=None)
    if at is None:
        # no constants: a constant key would leave the group out of the partitioning that the windows rely on
        deal = F.pmod(F.xxhash64("__id"), F.lit(wanted))
        df = df.withColumns({"__gx": deal, "__gy": F.bitwise_not(deal), "__gn": F.lit(1)})
        bound = wanted * sum(r["n"] for r in tiles.values())
    else:
        w = F.lit(2 * TL.H / 2.0 ** at)
        cells = counts.filter(F.col("z") == at).select(F.col("x").alias("__gx"), F.col("y").alias("__gy"),
                                                       F.ceil(F.col("n_features") / GROUP_POINTS).alias("__gn"))
        df = df.withColumns({"__gx": F.floor((F.col("_xmin") + TL.H) / w), "__gy": F.floor((F.lit(TL.H) - F.col("_ymin")) / w)})
        df = df.join(F.broadcast(cells) if wanted <= BROADCAST_PARTS else cells, ["__gx", "__gy"], "left")
        each = -(-tiles[at]["most"] // GROUP_POINTS)
        # a group meets the tiles beside its own by their margins, a deeper tile the groups around it
        bound = sum(4 * (2 * wanted + tiles[at]["n"]) if z <= at else 4 * each * r["n"] for z, r in tiles.items())
    deal = F.pmod(F.xxhash64("__id"), F.coalesce("__gn", F.lit(1))).cast("int")
    return df.withColumn("__gs", deal).drop("__gn"), wanted, bound


def _point_parts(coll, zooms, props: list[str]) -> DataFrame:
    """:func:`tile_parts` of points: a group's rows in all tiles are made, ordered and encoded in the task that
    got its points, in parts of at most ``PART_FEATURES`` features; only the points are shuffled."""
    df, wanted, bound = _point_groups(coll, zooms, props)
    tile = ["z", "x", "y"]
    nv = sum([F.col(p).isNotNull().cast("int") for p in props], F.lit(0)).alias("__nv")

    def rows(df: DataFrame, make, keep: list[str]) -> DataFrame:
        boxed = df.withColumns({"_xmax": F.col("_xmin"), "_ymax": F.col("_ymin")})
        return make(replace(coll, df=boxed, srid=3857), zooms, keep)

    # where the values and parts of a group's share of a tile start
    shares = rows(df.select("_xmin", "_ymin", *_GROUP, nv), TL.assign_wide, [*_GROUP, "__nv"]).groupBy(*_GROUP, *tile).agg(
        F.sum("__nv").alias("__values"), F.ceil(F.count(F.lit(1)) / PART_FEATURES).alias("__parts"))
    before = Window.partitionBy(*tile).orderBy(*_GROUP).rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.select(*_GROUP, *tile, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n)
                                             for c, n in (("__values", "__base"), ("__parts", "__first"))])
    starts = F.broadcast(starts) if bound <= BROADCAST_PARTS else starts.hint("merge")

    n = max(wanted, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.repartition(n, *_GROUP)
    # the values' messages and the keys' presence are the same in all of a point's tiles
    texts = [F.when(F.col(p).isNotNull(), F.concat(F.lit("0A"), varint_hex(F.octet_length(F.col(p)), 5), F.hex(F.col(p)))).alias(f"__m{k}")
             for k, p in enumerate(props)]
    has = [F.col(p).isNotNull().alias(f"__p{k}") for k, p in enumerate(props)]
    df = df.select("__id", "_xmin", "_ymin", *_GROUP, nv, *has, *texts)
    vals = [F.when(F.col(f"__p{k}"), _ld_hex(4, F.col(f"__m{k}"), 5)).otherwise(F.lit("")) for k in range(len(props))]
    flags = [f"__p{k}" for k in range(len(props))]
    df = df.select("__id", "_xmin", "_ymin", *_GROUP, "__nv", *flags, (F.concat(*vals) if vals else F.lit("")).alias("__v"))
    keep = [*_GROUP, "__nv", *flags, "__v"]
    t = rows(df, _quantised, keep)
    # what is drawn lies in the buffered tile: its zigzag coordinates are below 2 * 4353
    t = t.select(*tile, "__id", *keep, F.when(F.col("__in"), F.concat(
        F.lit("09"), varint_hex(F.col("__qx"), 2), varint_hex(F.col("__qy"), 2))).alias("__geom"))
    t = t.withColumn("__geom", F.coalesce(F.concat(F.lit("1801"), _ld_hex(4, F.col("__geom"), 1)), F.lit("")))

    w = Window.partitionBy(*_GROUP, *tile).orderBy("__id")
    t = t.select("*", F.row_number().over(w).alias("__row"), F.coalesce(F.sum("__nv").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    t = t.join(starts, [*_GROUP, *tile])
    number = F.floor((F.col("__row") - 0.5) * (1.0 / PART_FEATURES))
    t = t.withColumns({"part": (F.col("__first") + number).cast("int"), "__at": F.col("__base") + F.col("__before")})
    # bytes of a value's index, of the tags' length and of the body's, by the values that all points may have
    index = len(varint(max(1, wanted * GROUP_POINTS * len(props))))
    most = sum(len(varint(k)) + index for k in range(len(props)))
    n_tags, n_body = len(varint(most)), len(varint(most + 14))
    tags, at = [], F.col("__at")
    for k in range(len(props)):
        tags.append(F.when(F.col(f"__p{k}"), F.concat(F.lit(varint(k).hex().upper()), varint_hex(at, index))).otherwise(F.lit("")))
        at = at + F.col(f"__p{k}").cast("int")
    own = [*tile, "part", *_GROUP]
    t = t.select(*own, "__row", "__at", "__v", "__geom", (F.concat(*tags) if tags else F.lit("")).alias("__tags"))
    t = t.select(*own, "__row", "__at", "__v", "__geom", F.concat(
        F.when(F.octet_length("__tags") > 0, _ld_hex(2, F.col("__tags"), n_tags)).otherwise(F.lit("")), "__geom").alias("__body"))
    f = F.when(F.octet_length("__geom") > 0, _ld_hex(2, F.col("__body"), n_body)).otherwise(F.lit(""))
    parts = t.select(*own, "__row", "__at", "__v", f.alias("__f")).groupBy(*own).agg(
        F.min("__at").alias("first_value"), F.sort_array(F.collect_list(F.struct("__row", "__f", "__v"))).alias("__rows"))
    return parts.select(*tile, "part", "first_value", F.unhex(F.array_join(F.col("__rows.__f"), "")).alias("features"),
                        F.unhex(F.array_join(F.col("__rows.__v"), "")).alias("values"))


def _assemble(t: DataFrame, props: list[str], salt: int, layer: str, only: DataFrame | None) -> DataFrame:
    """Whole tiles from the rows of :func:`_chunks`, concatenated in chunk order (in a chunk: in id order)."""
    tiles = _chunks(t, props, salt, only).groupBy("z", "x", "y").agg(
        F.sort_array(F.collect_list(F.struct("__chunk", "__f", "__v"))).alias("__c"))
    feats = F.array_join(F.transform("__c", lambda c: c["__f"]), "")
    values = F.array_join(F.transform("__c", lambda c: c["__v"]), "")
    header_hex = (ld(1, layer.encode()) + b"".join(ld(3, p.encode()) for p in props)).hex().upper()
    tiles = tiles.select("z", "x", "y", feats.alias("__f"), values.alias("__v")).filter(F.length("__f") > 0)
    tiles = tiles.select("z", "x", "y", F.concat(F.lit(header_hex), "__f", "__v", F.lit(LAYER_TAIL.hex().upper())).alias("__l"))
    return tiles.select("z", "x", "y", F.unhex(_ld_hex(3, F.col("__l"))).alias("mvt"))
