"""Approximate nearest neighbours: a forest of random-projection trees.

Inner-product search becomes Euclidean search by one more coordinate: a
vector x gets sqrt(M^2 - |x|^2) (M: the largest norm), a query gets 0.  Each
tree halves space between two random points of a bounded sample until a leaf
holds few of them.  A query walks all trees through one shared priority queue,
the least distance to a crossed boundary first, and takes leaves until they
hold a given number of vectors; the members of those leaves are ranked exactly.
That number is measured on the table itself: some of the queries are answered
by brute force first, and the queue goes on until it holds their neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoplane.llm.common import hash_sample, prepare, sample_share, written

TREES = 16
SAMPLE = 20_000             # vectors that the trees are fitted on
LEAF = 24                   # sample points in a leaf at most
BLOCK = 4096                # vectors that a task ranks at once
FACTOR, POWER = 8.0, 0.75   # a query's leaves hold at least FACTOR * n ** POWER vectors (all of a small table)
PROBES = 128                # queries answered by brute force before the search
RECALL = 0.95               # share of their neighbours that the leaves must hold
SPARE = 6                   # more sample neighbours than asked for that set a query's pruning bound


@dataclass(frozen=True)
class Forest:
    """All trees in one node table: children of node i, or -1 - leaf where a branch ends."""

    normal: np.ndarray       # nodes x (dim + 1)
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray
    leaf_points: list        # sample rows in each leaf
    sample: np.ndarray       # sample vectors (without the added coordinate)
    max_norm: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.max_norm ** 2 - (x * x).sum(axis=1), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree (rows x trees)."""
        z = self.lifted(x)
        out = np.empty((len(z), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(z), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", z[inner], self.normal[node]) > self.offset[node]
                at[inner] = np.where(side, self.right[node], self.left[node])
            out[:, t] = -1 - at
        return out

    def visited(self, query: np.ndarray, sizes: np.ndarray, budget: int) -> list[int]:
        """Leaves that one query takes from the shared queue until they hold ``budget`` vectors."""
        margin = self.normal[:, :-1] @ query - self.offset
        queue = [(0.0, int(r)) for r in self.roots]
        heapq.heapify(queue)
        out, held = [], 0
        while queue and held < budget:
            far, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                near, other = (self.right, self.left) if m > 0 else (self.left, self.right)
                heapq.heappush(queue, (max(far, abs(float(m))), int(other[node])))
                node = int(near[node])
            out.append(-1 - node)
            held += int(sizes[-1 - node])
        return out


def fit(sample: np.ndarray, max_norm: float, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    rng = np.random.default_rng(seed)
    x = np.asarray(sample, dtype=np.float64)
    z = np.hstack([x, np.sqrt(np.maximum(max_norm ** 2 - (x * x).sum(axis=1), 0))[:, None]])
    normal, offset, left, right, leaves = [], [], [], [], []

    def end(rows: np.ndarray) -> int:
        leaves.append(rows)
        return -len(leaves)

    def grow(rows: np.ndarray) -> int:
        """Node of ``rows`` (an explicit stack, so that no tree is too deep)."""
        root = [-1]
        stack = [(rows, root, 0)]
        while stack:
            rows, parent, at = stack.pop()
            node = None
            if len(rows) > leaf:
                for _ in range(5):                       # five tries for a split that is not one-sided
                    a, b = z[rng.choice(rows, 2, replace=False)]
                    n = b - a
                    length = np.linalg.norm(n)
                    if length < 1e-12:
                        continue
                    n /= length
                    side = z[rows] @ n
                    cut = float(np.median(side)) if len(rows) < 8 * leaf else float(n @ (a + b) / 2)
                    share = (side > cut).mean()
                    if 0.05 < share < 0.95:
                        node = len(normal)
                        break
            if node is None:
                parent[at] = end(rows)
                continue
            normal.append(n)
            offset.append(cut)
            child_l, child_r = [0], [0]
            left.append(child_l)
            right.append(child_r)
            parent[at] = node
            stack.append((rows[side <= cut], child_l, 0))
            stack.append((rows[side > cut], child_r, 0))
        return root[0]

    roots = [grow(np.arange(len(z))) for _ in range(trees)]
    dim = z.shape[1]
    forest = Forest(np.array(normal).reshape(-1, dim), np.array(offset), np.array([v[0] for v in left], dtype=np.int64),
                    np.array([v[0] for v in right], dtype=np.int64), np.array(roots, dtype=np.int64),
                    [None] * len(leaves), x, float(max_norm))
    held = forest.leaves(x)
    order = np.argsort(held.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(held.ravel(), minlength=len(leaves)))
    forest.leaf_points[:] = np.split(order // trees, ends[:-1])
    return forest


def budget(n: int, trees: int) -> int:
    """How many vectors, counted once a tree, a query's leaves hold at least; everything up to 2,000 vectors."""
    return max(int(FACTOR * n ** POWER), min(n, 2000) * trees)


def needed(forest: Forest, query: np.ndarray, sizes: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """The least budget with which ``query`` visits each vector, given the vectors' leaves (rows x trees)."""
    order = np.array(forest.visited(query, sizes, int(sizes.sum()) + 1), dtype=np.int64)
    before = np.full(len(sizes), sizes.sum(), dtype=np.int64)
    before[order] = np.cumsum(sizes[order]) - sizes[order]
    return before[leaves].min(axis=1) + 1


def measured_budget(placed: DataFrame, shared, sizes: np.ndarray, k: int, probes: int = PROBES,
                    recall: float = RECALL) -> int:
    """The least budget whose leaves hold ``recall`` of the ``k`` nearest vectors of ``probes`` queries.

    The probes are chosen by hash of the id; their neighbours are found by brute force in one scan.
    """
    spark = placed.sparkSession
    chosen = (placed.filter("asks").select("rep", "v").orderBy(F.xxhash64("rep", F.lit(11)), "rep")
              .limit(probes).collect())
    if not chosen:
        return 0
    own = np.array([r["rep"] for r in chosen], dtype=np.int64)
    plan = spark.sparkContext.broadcast((own, np.array([np.frombuffer(r["v"]) for r in chosen]), sizes))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q, _ = plan.value
        score = np.full((len(q), k), -np.inf)
        places = None
        for b in batches:
            if not len(b):
                continue
            x = np.frombuffer(b"".join(b["v"])).reshape(len(b), -1)
            leaf = np.array(b["leaves"].tolist(), dtype=np.int64).reshape(len(b), -1)
            if places is None:
                places = np.zeros((len(q), k, leaf.shape[1]), dtype=np.int64)
            new = q @ x.T
            new[own[:, None] == b["rep"].to_numpy()[None, :]] = -np.inf
            both = np.hstack([score, new])
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(both, top, axis=1)
            old = top < k
            places = np.where(old[:, :, None],
                              np.take_along_axis(places, np.minimum(top, k - 1)[:, :, None], axis=1),
                              leaf[np.maximum(top - k, 0)])
        if places is not None:
            i, j = np.nonzero(score > -np.inf)
            yield pd.DataFrame({"probe": i, "score": score[i, j], "leaves": list(places[i, j])})

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        _, q, sizes = plan.value
        near = rows.nlargest(k, "score")
        leaves = np.array(near["leaves"].tolist(), dtype=np.int64)
        return pd.DataFrame({"need": needed(shared.value, q[int(near["probe"].iloc[0])], sizes, leaves)})

    found = placed.select("rep", "v", "leaves").mapInPandas(scan, "probe long, score double, leaves array<long>")
    need = np.sort([r["need"] for r in found.groupBy("probe").applyInPandas(walk, "need long").collect()])
    return int(need[int(np.ceil(recall * len(need))) - 1]) if len(need) else 0


def usable(vec: Column, dim: int) -> Column:
    """Vectors of ``dim`` finite, non-null components that are not all zero."""
    return ((F.size(vec) == dim)
            & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(vec, lambda x: x != 0))


def _packed(sizes: np.ndarray, tree_of: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each leaf (neighbouring leaves of a tree up to ``block`` members), and into how many parts it is split."""
    group, parts = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    number, held, last = -1, 0, -1
    for i, n in enumerate(sizes):
        if number < 0 or tree_of[i] != last or held + n > block:
            number, held, last = number + 1, 0, tree_of[i]
        group[i] = number
        held += int(n)
        parts[i] = max(1, -(-int(n) // block))
    return group, parts


def nearest(vectors: DataFrame, queries: Column, k: int = 20, trees: int = TREES, sample: int = SAMPLE,
            leaf: int = LEAF, block: int = BLOCK, id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query row.

    ``queries`` is a condition on ``vectors``.  Scores are inner products of
    the original vectors in double precision; ties go to the smaller id; a
    query never finds its own id; fewer candidates than ``k`` are all returned.

    The trees are fitted on at most about ``sample`` distinct vectors, chosen
    by hash of the id; every vector is indexed.  How many leaves a query takes
    is measured on a sample of the queries (``measured_budget``).  Equal vectors are one entry
    with their k + 1 smallest ids (no query can need more), so a group of
    copies of any size costs one candidate.  Vectors that are null, zero, of
    another length than most, or hold a null or non-finite component, and rows
    without an id, take no part; repeated rows count once; an empty table
    gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vec_col).cast("array<double>").alias("v"),
                         F.coalesce(queries, F.lit(False)).alias("asks")).filter("vec_id is not null and v is not null")
    lengths = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or lengths["d"] < 1:
        return spark.createDataFrame([], schema)
    dim = lengths["d"]
    plus = F.transform("v", lambda x: x + F.lit(0.0))            # -0.0 equals 0.0
    src = src.filter(usable(F.col("v"), dim)).select("vec_id", plus.alias("v"), "asks")
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    rows = src.groupBy("v", "vec_id").agg(F.max("asks").alias("asks"))
    first = written(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.max("asks").alias("asks")), "vectors")
    members = (rows.withColumn("r", F.row_number().over(by_vector)).filter(F.col("r") <= k + 1)
               .select("v", "vec_id"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = first.agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("m")).first()
    n = stats["n"]
    if not n:
        return spark.createDataFrame([], schema)
    picked = hash_sample(first.select("rep", "v"), "rep", sample_share(sample, n)).collect()
    picked.sort(key=lambda r: r["rep"])
    points = np.array([r["v"] for r in picked], dtype=np.float64).reshape(-1, dim)
    forest = fit(points, float(np.sqrt(stats["m"])), trees, leaf)
    shared = spark.sparkContext.broadcast(forest)                 # bounded by ``sample`` and ``trees``

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["v"].tolist(), dtype=np.float64).reshape(-1, dim)
            yield pd.DataFrame({"rep": b["rep"], "asks": b["asks"], "v": [r.tobytes() for r in x],
                                "leaves": list(shared.value.leaves(x))})

    placed = written(first.mapInPandas(place, "rep long, asks boolean, v binary, leaves array<long>"), "leaves")
    sizes = np.zeros(len(forest.leaf_points), dtype=np.int64)
    tree_of = np.zeros(len(sizes), dtype=np.int64)
    for r in placed.select(F.posexplode("leaves").alias("t", "leaf")).groupBy("leaf", "t").count().collect():
        sizes[r["leaf"]], tree_of[r["leaf"]] = r["count"], r["t"]
    group, parts = _packed(sizes, tree_of, block)
    plan = spark.sparkContext.broadcast((sizes, group, parts))
    wanted = budget(n, trees)
    if n > 2000:
        wanted = max(wanted, measured_budget(placed, shared, sizes, k))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, group, parts = plan.value
        for b in batches:
            at = np.array(b["leaves"].tolist(), dtype=np.int64).reshape(len(b), -1)
            rep = np.repeat(b["rep"].to_numpy(), at.shape[1])
            leaf = at.ravel()
            yield pd.DataFrame({"grp": group[leaf], "part": rep % parts[leaf], "leaf": leaf, "rep": rep,
                                "v": np.repeat(b["v"].to_numpy(), at.shape[1])})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = shared.value
        sizes, group, parts = plan.value
        for b in batches:
            rows = []
            for rep, v in zip(b["rep"], b["v"], strict=True):
                x = np.frombuffer(v)
                seen = np.array(forest.visited(x, sizes, wanted), dtype=np.int64)
                near = np.unique(np.concatenate([forest.leaf_points[i] for i in seen]))
                found = forest.sample[near] @ x
                need = k + 1 + SPARE
                least = float(np.partition(found, len(found) - need)[-need]) if len(found) >= need else -np.inf
                order = seen[np.argsort(group[seen], kind="stable")]
                cuts = np.flatnonzero(np.diff(group[order])) + 1
                for own in np.split(order, cuts):
                    for part in range(int(parts[own].max())):
                        rows.append((int(group[own[0]]), part, rep, v, least, own))
            yield pd.DataFrame(rows, columns=["grp", "part", "rep", "v", "least", "seen"])

    def rank(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(asking):
            x = np.frombuffer(b"".join(members["v"])).reshape(-1, dim)
            q = np.frombuffer(b"".join(asking["v"])).reshape(-1, dim)
            least = asking["least"].to_numpy()
            who = np.repeat(np.arange(len(asking)), [len(s) for s in asking["seen"]])
            leaf = np.concatenate(list(asking["seen"]))
            order = np.argsort(leaf, kind="stable")
            who, leaf = who[order], leaf[order]
            own = members["leaf"].to_numpy()
            held = np.argsort(own, kind="stable")
            own = own[held]
            for one in np.unique(leaf):
                m = held[np.searchsorted(own, one):np.searchsorted(own, one, "right")]
                w = who[np.searchsorted(leaf, one):np.searchsorted(leaf, one, "right")]
                if len(m) and len(w):
                    score = q[w] @ x[m].T
                    i, j = np.nonzero(score >= least[w][:, None] - 1e-9)
                    out.append((w[i], m[j], score[i, j]))
        if not out:
            return pd.DataFrame({"rep": [], "found": [], "score": []})
        w, m, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"rep": asking["rep"].to_numpy()[w], "found": members["rep"].to_numpy()[m],
                             "score": score}).drop_duplicates(["rep", "found"])

    left = placed.mapInPandas(index, "grp long, part long, leaf long, rep long, v binary")
    right = placed.filter("asks").select("rep", "v").mapInPandas(
        ask, "grp long, part long, rep long, v binary, least double, seen array<long>")
    pairs = (left.groupBy("grp", "part").cogroup(right.groupBy("grp", "part"))
             .applyInPandas(rank, "rep long, found long, score double")
             .groupBy("rep", "found").agg(F.max("score").alias("score")))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "found")
    pairs = pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    ids = members.join(first.select("v", "rep"), "v").select(F.col("rep").alias("found"), "vec_id")
    asking = rows.filter("asks").join(first.select("v", "rep"), "v").select("rep", F.col("vec_id").alias("query_id"))
    hits = pairs.join(ids, "found").join(asking, "rep").filter("vec_id <> query_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
