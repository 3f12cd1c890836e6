"""Centroid clustering by dimension-sharded Lloyd rounds, in exact integers.

Vectors are cut into column blocks.  The rows of a block come in packs (some
thousand rows, one binary matrix); a pack's task computes exact partial squared
distances to its slice of the centroids, the packs of the same rows meet by
their pack number, are added and give the nearest centroid, and each column
block sums its members' slices to make its own slice of the next centroids.

The driver holds the centroids only (number of clusters x dimensions).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoplane.llm.common import prepare, written

# Rows of a pack and columns of a block.
PACK_ROWS, BLOCK_DIMS = 2048, 16
# A scaled component of this size or more takes no part, like a non-finite one: integers stay within a long.
LIMIT = 2.0 ** 62


def to_bytes(m: np.ndarray) -> bytes:
    """An integer matrix in the narrowest type that holds it; integers beyond a long as text."""
    if m.dtype == object:
        top = max((abs(int(v)) for v in m.flat), default=0)
        if top >= 1 << 62:
            return b"t" + " ".join(map(str, m.flat)).encode()
        m = m.astype(np.int64)
    top = int(np.abs(m).max()) if m.size else 0
    kind = "h" if top < 1 << 15 else "i" if top < 1 << 31 else "q"
    return kind.encode() + m.astype(kind).tobytes()


def from_bytes(data: bytes, width: int) -> np.ndarray:
    if data[:1] == b"t":
        return np.array([int(v) for v in data[1:].split()], dtype=object).reshape(-1, width)
    return np.frombuffer(data, dtype=data[:1].decode(), offset=1).reshape(-1, width).astype(np.int64)


def partial_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroid slices.

    In doubles while no intermediate value passes 2^53, else in Python integers.
    """
    reach = (int(np.abs(x).max()) if x.size else 0) + (int(np.abs(c).max()) if c.size else 0)
    if reach * reach * max(x.shape[1], 1) * 4 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


def floor_scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles (exact while below LIMIT)."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def kept(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``__id, __v``: the integer vectors that take part."""
    v = F.col(vec_col)
    # a null array has size null, and NaN compares above every number
    good = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(
        F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(LIMIT), F.lit(False)))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).alias("__id"), floor_scaled(v, scale).alias("__v"))


def seeds(rows: DataFrame, k: int, dims: int, salt: str) -> np.ndarray:
    """The ``k`` rows with the smallest sha256 of ``salt`` and the id (k rows come to the driver).

    Null ids come last; equal ids are ordered by their components.
    """
    key = F.sha2(F.concat(F.lit(salt), F.col("__id").cast("string")), 256)
    top = rows.orderBy(key.asc_nulls_last(), F.col("__v")).limit(k).collect()
    return np.array([r["__v"] for r in top], dtype=np.int64).reshape(len(top), dims)


def shards(rows: DataFrame, dims: int, what: str = "kmeans-shards") -> DataFrame:
    """``pack, block, ids, data``: packs of rows cut into column blocks; the ids are in block 0."""
    id_type = rows.schema["__id"].dataType.simpleString()
    cuts = [(lo, min(lo + BLOCK_DIMS, dims)) for lo in range(0, dims, BLOCK_DIMS)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        vectors: list = []

        def packs(least: int) -> Iterator[pd.DataFrame]:
            nonlocal ids, vectors, seq
            while len(ids) >= least and ids:
                own, m = ids[:PACK_ROWS], np.stack(vectors[:PACK_ROWS])
                ids, vectors = ids[PACK_ROWS:], vectors[PACK_ROWS:]
                yield pd.DataFrame({"pack": [part << 32 | seq] * len(cuts), "block": range(len(cuts)),
                                    "ids": [own if j == 0 else None for j in range(len(cuts))],
                                    "data": [to_bytes(m[:, lo:hi]) for lo, hi in cuts]})
                seq += 1

        for b in batches:
            ids += [None if pd.isna(i) else i for i in b["__id"]]
            vectors += list(b["__v"])
            yield from packs(PACK_ROWS)
        yield from packs(1)

    # ids as text: an id column with nulls would reach pandas as floats
    src = rows.select(F.col("__id").cast("string").alias("__id"), "__v")
    cut = src.mapInPandas(run, "pack long, block int, ids array<string>, data binary")
    return written(cut.withColumn("ids", F.col("ids").cast(f"array<{id_type}>")), what)


def block_slice(centroids: np.ndarray, block: int) -> np.ndarray:
    return centroids[:, block * BLOCK_DIMS:(block + 1) * BLOCK_DIMS]


def assigned(parts: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``pack, nearest, distance`` (arrays by row): partial distances per column block, added by pack, argmin.

    The smaller number wins a tie.  A distance beyond a long is null.
    """
    k, dims = centroids.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for block, data in zip(b["block"], b["data"], strict=True):
                own = block_slice(centroids, block)
                out.append(to_bytes(partial_distances(from_bytes(data, own.shape[1]), own)))
            yield pd.DataFrame({"pack": b["pack"], "data": out})

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in pdf["data"]:
            d = from_bytes(data, k)
            # blocks below 2^62 each may pass a long together
            safe = d.dtype != object and int(d.max(initial=0)) < 1 << 40 and (total is None or total.dtype != object)
            d = d if safe else d.astype(object)
            total = d if total is None else total + d
        at = np.argmin(total, axis=1)
        best = [int(v) if int(v) < 1 << 63 else None for v in total[np.arange(len(at)), at]]
        return pd.DataFrame({"pack": pdf["pack"].iloc[:1].to_numpy(), "nearest": [at.astype(np.int32).tolist()],
                             "distance": [pd.array(best, dtype="Int64").to_numpy(object, na_value=None)]})

    return parts.select("pack", "block", "data").mapInPandas(partial, "pack long, data binary").groupBy(
        "pack").applyInPandas(nearest, "pack long, nearest array<int>, distance array<long>")


def updated(parts: DataFrame, near: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: each column block sums its members' slices; floor of sum / count, empty ones stay."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        for b in batches:
            for block, data, own in zip(b["block"], b["data"], b["nearest"], strict=True):
                own = np.asarray(own)
                x = from_bytes(data, block_slice(centroids, block).shape[1])
                # 2^40 rows of a task keep such sums below 2^63
                x = x if x.size and int(np.abs(x).max()) < 1 << 23 else x.astype(object)
                for c in np.unique(own):
                    rows = x[own == c]
                    s, n = held.get((block, int(c)), (0, 0))
                    held[block, int(c)] = s + rows.sum(0), n + len(rows)
        rows = [(block, c, block * BLOCK_DIMS + j, str(int(v)), n) for (block, c), (s, n) in held.items()
                for j, v in enumerate(s)]
        yield pd.DataFrame(rows, columns=["block", "cluster", "dim", "total", "n"])

    both = parts.select("pack", "block", "data").join(near.select("pack", "nearest"), "pack")
    per = both.mapInPandas(sums, "block int, cluster int, dim int, total string, n long").groupBy("cluster", "dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in per.collect():                     # at most clusters x dimensions rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def centroid_digest(row: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:",
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per kept vector, and the centroids.

    Vectors that are null, of another length, or hold a null, non-finite or
    huge component (``scale`` times it is 2^62 or more) take no part.  The first
    centroids are the ``k`` kept vectors with the smallest hash (all, if fewer;
    null ids last), ties go to the smaller cluster number, and rows with equal
    ids or equal vectors are rows of their own.  A distance or inertia beyond a
    long is null.  An empty table gives no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = kept(vectors, id_col, vec_col, dims, scale)
    centroids = seeds(rows, k, dims, salt)
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    parts = shards(rows, dims)
    for _ in range(rounds):
        near = written(assigned(parts, centroids), "kmeans-near")
        centroids = updated(parts, near, centroids)
    last = written(assigned(parts, centroids), "kmeans-last")
    ids = parts.filter(F.col("block") == 0).select("pack", "ids")
    each = ids.join(last, "pack").select(F.inline(F.arrays_zip("ids", "nearest", "distance"))).select(
        F.col("ids").alias(id_col), F.col("nearest").alias("cluster"), "distance")
    total = last.select(F.inline(F.arrays_zip("nearest", "distance"))).groupBy("nearest").agg(
        F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s"))
    found = {r["nearest"]: None if r["s"] is None else int(r["s"]) for r in total.collect()}     # at most k rows
    everything = None if None in found.values() else sum(found.values())

    def long(v: int | None) -> int | None:
        return v if v is not None and v < 1 << 63 else None

    facts = spark.createDataFrame(
        [(c, long(s), long(everything), centroid_digest(centroids[c])) for c, s in sorted(found.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a cluster: k at most
    return each.join(F.broadcast(facts), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def _sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """DuckDB text of the contract's query (ids without repetition)."""
    def nearest(i: int) -> str:
        return f"""m{i} AS (SELECT vec_id, c, s FROM (SELECT e.vec_id, k.c, sum((e.x - k.x) * (e.x - k.x)) AS s
            FROM e JOIN c{i} k ON e.d = k.d GROUP BY e.vec_id, k.c)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s, c) = 1)"""

    parts = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dims}
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
             f"e AS (SELECT vec_id, unnest(range({dims})) AS d, unnest(v) AS x FROM kept)",
             f"""c0 AS (SELECT c, unnest(range({dims})) AS d, unnest(v) AS x FROM (SELECT
        row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c, v FROM kept) WHERE c < {k})"""]
    for i in range(rounds):
        parts.append(nearest(i))
        parts.append(f"""c{i + 1} AS (SELECT k.c, k.d, coalesce(u.x, k.x) AS x FROM c{i} k LEFT JOIN (
            SELECT m.c, e.d, CAST(floor(sum(e.x) / count(*)) AS BIGINT) AS x FROM m{i} m JOIN e USING (vec_id) GROUP BY m.c, e.d)
            u ON k.c = u.c AND k.d = u.d)""")
    parts.append(nearest(rounds))
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance,
        CAST(sum(s) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia,
        h.sha AS centroid_sha256 FROM m{rounds} m JOIN h ON m.c = h.c"""


SQL = _sql()
