import random
import string

import pytest
from tokenizers import Tokenizer

from geoplane.llm import bpetree as B

ODD = ["", " ", "\x1c", "a\x1cb\x1f c", "x" * 5000, "ab" * 3000, "It's they'LL 1234 don't!!!???", "é́é ǅ ẞ İ Σς",
       "日本語のテキスト" * 300, "a b　c d​e", "<|endoftext|>a<|startoftext|>b " * 3, "<|endof" * 40,
       "x" * 70 + "<|endoftext|>" + "y's" * 90, "\n\ttab \r\n", "😀👍🏽" * 200, "́́ ́a", "\x00\x01" * 80,
       "༳ཱཱིུ" * 40, "a" + "̖́" * 120]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.default_path())


def same(coder, library, texts):
    ids, offsets, back = coder.encode(texts)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == expected
    assert back == [library.decode(e, skip_special_tokens=False) for e in expected]


@pytest.mark.parametrize("leaf,long,window", [(64, 64, 4), (1, 0, 1), (3, 5, 2), (2, 0, 1)])
def test_odd_texts(library, leaf, long, window):
    same(B.TreeCoder(B.read_spec(), leaf, long, window), library, ODD)


def test_random_runs_by_small_leaves(library):
    rng = random.Random(5)
    coder = B.TreeCoder(B.read_spec(), leaf=2, long=0, window=1)
    words = ["the", "ing", "internationalisation", "aa", "hello", "ab", "tion", "s"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(120)]
    texts += ["".join(rng.choices("aab", k=rng.randint(1, 300))) for _ in range(120)]
    texts += ["".join(rng.choices(string.printable + "éßдя中文", k=200)) for _ in range(120)]
    same(coder, library, texts)


def test_windows_grow_until_both_sides_agree(library):
    coder = B.TreeCoder(B.read_spec(), leaf=5, long=0, window=1)
    seen = []
    inner = coder._encode
    coder._encode = lambda items: seen.append(max(len(i[0]) for i in items)) or inner(items)
    same(coder, library, ["a" * 333])
    assert max(seen) > 20                      # one letter repeated: the first windows do not agree


def test_cache_reset_changes_nothing(library):
    coder = B.TreeCoder(B.read_spec(), cache_runs=2)
    for part in (ODD[:5], ODD[4:9], ODD):
        same(coder, library, part)


def test_other_kinds_of_tokenizer_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        B.TreeCoder(B.read_spec(public_tokenizers.path("byte_bpe_50k.json")))


def test_documents(spark, library):
    rows = [(1, "Hello  there", 9), (None, None, 9), (3, "", 9), (1, "Hello  there", 9), (4, "w\n" * 50_000, 9),
            (5, "z" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = B.encode_documents(df)
    out = got.collect()
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in out) == sorted(
        (str(i), e := library.encode(t or "", add_special_tokens=False).ids,
         library.decode(e, skip_special_tokens=False)) for i, t, _ in rows)
    back = {(r["doc_id"], r["text"]) for r in B.decode_ids(got).collect()}
    assert back == {(r["doc_id"], r["decoded"]) for r in out}
    assert B.encode_documents(df.limit(0)).count() == 0


def test_whole_table_against_the_library(spark, library):
    import hashlib

    from geoplane.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op12_bpetree"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
