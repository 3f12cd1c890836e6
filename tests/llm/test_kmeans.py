import hashlib
import math

import numpy as np
import pytest

from geoplane.llm import kmeans as K


def brute(rows, k=40, rounds=5, dims=64, scale=256, salt="2:"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]

    def key(r):
        return r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]

    cent = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cent))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cent)):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if mine:
                cent[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(v) for _, v in kept]
    inertia = {j: sum(d for d, c in last if c == j) for j in range(len(cent))}
    fits = [d if d < 1 << 63 else None for d in (*inertia.values(), sum(inertia.values()))]
    return sorted(((i, c, d if d < 1 << 63 else None, fits[c], fits[-1],
                    hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest())
                   for (i, _), (d, c) in zip(kept, last, strict=True)), key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in K.cluster(df, **kw)[0].collect()), key=str)


SCHEMA = "vec_id long, embedding array<double>, label int, pack long, block int, ids int, data int, cluster int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("n,k,dims", [(300, 7, 20), (90, 40, 64), (5, 40, 16), (200, 3, 1)])
def test_equal_to_brute_force(spark, monkeypatch, n, k, dims):
    monkeypatch.setattr(K, "PACK_ROWS", 16)
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(size=dims) * rng.choice([0.01, 1.0])).tolist()) for i in range(n)]
    rows += rows[: n // 3]                                                   # repeated rows
    rows += [(900 + i, rows[0][1]) for i in range(20)]                       # one vector many times
    assert run(make(spark, rows), k=k, dims=dims) == brute(rows, k=k, dims=dims)


def test_what_takes_no_part(spark):
    v = [0.5] * 64
    bad = [None, [], v[:63], [*v, 0.5], [*v[:63], None], [*v[:63], math.nan], [*v[:63], math.inf]]
    rows = [(i, b) for i, b in enumerate(bad)] + [(None, v), (50, v), (50, [-x for x in v]), (None, [0.1] * 64)]
    assert run(make(spark, rows)) == brute(rows)
    assert run(make(spark, rows[:7])) == []
    assert run(make(spark, rows).limit(0)) == []


@pytest.mark.parametrize("size", [1e4, 1e6, 1e9, 1e15])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * size).tolist()) for i in range(60)]
    assert run(make(spark, rows), k=5, rounds=3) == brute(rows, k=5, rounds=3)


def test_huge_components_take_no_part(spark):
    rows = [(1, [1e300] * 64), (2, [2.0 ** 54] * 64), (3, [1.0] * 64)]
    assert [r[0] for r in run(make(spark, rows))] == [3]


def test_table_against_brute_force(spark):
    from geoplane.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = sorted((tuple(r) for r in QUERIES["op11_kmeans"](spark, sf).collect()), key=str)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == brute(rows)
