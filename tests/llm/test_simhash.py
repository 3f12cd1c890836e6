import random
import re

import pytest
import xxhash

from geoplane.llm import simhash as S
from geoplane.llm.components import connected_components


def plain(text, shingle=3):
    """The fingerprint bit by bit, with Python integers."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(fps, bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t", "one", "Two Words", "A b c d", "İX ẞ ab\x0bcd\x85e \x1cf g",
                                  "word " * 500, "É e\n\nÉ e É", "a b c a b c"])
def test_fingerprint_equals_bitwise_form(text):
    assert S.fingerprint(text) == plain(text)


def near_texts(rng, n):
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 140))] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for _ in range(3 * n):
        b = list(rng.choice(base))
        b[rng.randrange(len(b))] = rng.choice(words)
        out.append(" ".join(b))
    return out + [None, "", " ", out[0], out[0].upper()]


def test_groups_equal_brute_force_on_both_paths(spark):
    texts = near_texts(random.Random(3), 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in S.simhash_groups(df).collect()}
    want = classes([plain(t) for t in texts])
    assert [rows[i]["component_id"] for i in range(len(texts))] == want
    assert [rows[i]["fp"] % (1 << 64) for i in range(len(texts))] == [plain(t) for t in texts]


@pytest.mark.parametrize("paired", [2, 5, 1000])
def test_links_do_not_depend_on_the_bucket_bound(spark, paired):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comp = {r["node"]: r["root"] for r in connected_components(S.links(df, paired=paired), "a", "b").collect()}
    want = classes([f % (1 << 64) for f in fps])
    assert [comp.get(f, f) for f in fps] == [fps[i] for i in want]


def test_one_per_group_and_edges(spark):
    rows = [(4, "a b c d", "en"), (2, "A b c d", None), (None, "a b c d", "x"), (7, None, None), (9, "", None),
            (2, "A b c d", None), (8, "quite another text here", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = S.one_per_group(df)
    assert kept.columns == df.columns
    # the row without an id is a copy of one that has an id
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [
        (2, "A b c d"), (7, ""), (8, "quite another text here")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_groups(empty).count() == 0
    assert S.one_per_group(empty).count() == 0
    with pytest.raises(ValueError):
        S.links(df.select("doc_id"), max_bits=3)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (2000, 2000)]
    rng = random.Random(1)
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r["node"]: r["root"] for r in connected_components(df, "x", "y").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
