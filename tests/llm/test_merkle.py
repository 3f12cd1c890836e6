import hashlib
import zlib

import pytest

from geoplane.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, low=False):
    text = r["text"]
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = own, levels([leaf(r) for r in own])
    top = levels([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        own, lv = trees[s]
        for i, r in enumerate(own):
            path = []
            for tree, at in ((lv, i), (top, k)):
                for nodes in tree[:-1]:
                    a = at - at % 16
                    path.append((nodes[a:at], nodes[at + 1:a + 16]))
                    at //= 16
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            acc = leaf(r, low=hit)
            for before, after in path:
                acc = h(*before, acc, *after)
            proof = h(*[x for b, a in path for x in b + a])
            out.append((r["doc_id"], leaf(r), lv[-1][0], top[-1][0], proof, acc, acc == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    got = M.manifest(df, M.one_in_five(M.F.col("doc_id")))
    out = got.select("doc_id", "leaf", "subroot", "root", M.proof(M.F.col("path")).alias("p"), "folded_root", "verified")
    return sorted(map(tuple, out.collect()), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, no long, n long, hash string, kids int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, 5, 5, "x", 1) for i, t, lang, s, n in rows], SCHEMA)


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 2, None: 1}, {"a": 16, "b": 17, "c": 1, "d": 0}, {"a": 300, None: 33},
                                    {"é": 4097, "z": 4096, "y": 40}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_equal_to_brute_force(spark, counts):
    rows, i = [], 0
    for s, n in counts.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 100_003, f"Text {i} ÀB" if i % 9 else None, "en" if i % 4 else None, s,
                         i if i % 5 else None))
    df = make(spark, rows)
    assert rows_of(df) == brute([r.asDict() for r in df.collect()])


def test_nulls_ties_long_and_empty_texts(spark):
    rows = [(None, "A", "en", "s", 1), (None, "A", "en", "s", 1), (5, "", None, None, None), (5, "", None, None, None),
            (5, "B" * 300_000, "fr", "s", 3), (5, "C", "fr", "s", 3), (-3, None, None, "", 0), (0, "É z", "a", "s", 1)]
    rows += [(0, "É z", "a", "s", 1)] * 20
    df = make(spark, rows)
    assert rows_of(df) == brute([r.asDict() for r in df.collect()])
    assert rows_of(df.limit(0)) == []


def test_many_ranges_and_several_block_levels(spark, monkeypatch):
    monkeypatch.setattr(M, "DIGITS", 1)
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "RANGE_ROWS", 50)
    rows = [(i, f"Doc {i}", "en", "hot" if i % 3 else f"s{i % 70}", i) for i in range(2000)]
    df = make(spark, rows)
    assert rows_of(df) == brute([r.asDict() for r in df.collect()])


def test_a_leaf_folds_to_the_root_and_a_changed_one_does_not(spark):
    df = make(spark, [(i, f"Doc {i}" if i % 2 else f"doc {i}", "en", "s", 1) for i in range(100)])
    got = {r[0]: r for r in rows_of(df)}
    for i in range(100):
        changed = i % 2 == 1 and zlib.crc32(str(i).encode()) % 5 == 0
        assert got[i][-1] is not changed


def test_table_against_brute_force(spark):
    from geoplane.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, QUERIES["op13_merkle"](spark, sf).collect()), key=str)
    assert got == brute([r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
