import hashlib
import random

import numpy as np
import pytest

from geoplane.llm import bwtdedup as B


def brute(texts, length):
    """n_removed, n_spans and kept bytes of every text by counting every string."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i:i + length]] = seen.get(r[i:i + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60, words=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(words)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 80))) for _ in range(n)]
    out = []
    for t in base:
        kind = rng.random()
        other = rng.choice(base)
        if kind < 0.2:
            out.append(other)                                              # copy
        elif kind < 0.5:
            a, b = sorted(rng.randint(0, len(other)) for _ in range(2))
            c = rng.randint(0, len(t))
            out.append(t[:c] + other[a:b] + t[c:])                         # shared passage
        elif kind < 0.6:
            out.append(rng.choice(["ab", "a", "abcde ", "é"]) * rng.randint(1, 60) + t[:20])   # loops
        else:
            out.append(t)
    return out + [None, "", "x"]


def result(spark, texts, length, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(B.remove_repeats(df, length=length, **more).collect(), key=lambda r: r["doc_id"])
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows]


@pytest.mark.parametrize("seed,length,paired", [(1, 20, 48), (2, 33, 48), (3, 24, 2), (4, 60, 3)])
def test_equals_brute_force(spark, seed, length, paired):
    texts = corpus(seed)
    assert result(spark, texts, length, shard_bytes=700, paired=paired) == brute(texts, length)


def test_production_length_and_long_copies(spark):
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage, long = line(75), line(900)
    texts = [line(100) + passage + line(50), passage + line(80), long, long[:1500] + "X" + long[1501:], long,
             "As " * 300, "As " * 133, "no " * 200 + "end", passage[:399], passage[-400:], line(10) + passage[3:403]]
    assert result(spark, texts, 400) == brute(texts, 400)


def test_defined_edges(spark):
    df = spark.createDataFrame([(None, "z" * 30, 1), (5, None, 2), (5, "", 3)], "doc_id long, text string, shard long")
    rows = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in B.remove_repeats(df, length=20).collect()}
    assert rows == {(None, 30): 30, (5, 0): 0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.remove_repeats(empty, length=20).count() == 0


def test_transform_orders_suffixes_and_maps_back():
    rng = np.random.default_rng(0)
    pieces = rng.integers(0, 3, 40).astype(np.uint64)
    chained = rng.random(40) < 0.85
    chained[-1] = False
    rows, before, lf = B.transform(pieces, chained)
    last = np.flatnonzero(~chained)

    def suffix(i):
        end = last[np.searchsorted(last, i)]
        return [int(p) + 100 for p in pieces[i:end]] + [int(np.searchsorted(last, i))]

    assert [suffix(i) for i in rows] == sorted(suffix(i) for i in range(40))
    place = np.empty(40, dtype=int)
    place[rows] = np.arange(40)
    for j, i in enumerate(rows):
        if i and chained[i - 1]:
            assert lf[j] == place[i - 1]
