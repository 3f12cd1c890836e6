import struct

import pytest
import sentencepiece

from geoplane.llm import sentencepiece as S

TEXTS = ["", " ", "  a  b ", "naïve 😀\n\n tab\t x", "\x00a", "   lead", "trail   ", "a　b", "<s> hi </s> <unk> <0x41>",
         "é ẞ", "hello world " * 200, "x" * 5000, "日本語 text ⅷ ﬁ"]


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            continue
        tag = number << 3 | (0 if isinstance(value, int) else 2)
        head = b""
        while tag > 127:
            head += bytes([tag & 127 | 128])
            tag >>= 7
        out += head + bytes([tag])
        n = value if isinstance(value, int) else len(value)
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        out += bytes([n]) + (b"" if isinstance(value, int) else value)
    return out


def unigram_model(byte_fallback, squeeze):
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁abc", "▁b", "ca", "cab", "▁cab"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    out = b"".join(message((1, message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    trainer = message((3, 1), (35, int(byte_fallback)), (4, len(pieces)))
    return out + message((2, trainer)) + message((3, message((1, b"identity"), (3, 1), (4, int(squeeze)), (5, 1))))


def test_public_model_parity_and_round_trip():
    data = S.read_model()
    coder, ref = S._load(data)
    rows = S.encode_batch(TEXTS, coder, ref, 1)
    assert [list(r[0]) for r in rows] == ref.encode(TEXTS)
    assert all(r[2] for r in rows) and all(r[1] for r in rows)
    # the whole-text tokenizer gives the same as the word table
    assert [e.ids for e in coder.full.encode_batch(TEXTS, add_special_tokens=False)] == [list(r[0]) for r in rows]
    assert S.encode_batch(["▁x ▁▁y"], coder, ref, 1)[0][1:] == (False, True)     # a literal marker reads as a space


@pytest.mark.parametrize("byte_fallback,squeeze", [(True, False), (True, True), (False, False)])
def test_unigram_model_parity(byte_fallback, squeeze):
    data = unigram_model(byte_fallback, squeeze)
    spec = S.parse_model(data)
    assert (spec.model_type, spec.byte_fallback, spec.remove_extra_whitespaces) == (1, byte_fallback, squeeze)
    ref = sentencepiece.SentencePieceProcessor(model_proto=data)
    coder = S.Coder(spec)
    texts = ["abc cab", "a  b", "cabab abcab bca", "  ab c ", "abc" * 40, ""]
    if byte_fallback:
        texts += ["xyz é", "abc😀c"]
    ids, _ = coder.encode(texts)
    assert [list(i) for i in ids] == ref.encode(texts)


def test_cache_reset_changes_nothing():
    spec = S.parse_model(S.read_model())
    small, large = S.Coder(spec, cache_words=3), S.Coder(spec)
    for part in (TEXTS[:4], TEXTS[4:9], TEXTS[2:]):
        assert [list(i) for i in small.encode(part)[0]] == [list(i) for i in large.encode(part)[0]]


def test_documents(spark):
    df = spark.createDataFrame([(1, "hello  there", 9), (None, None, 9), (3, "", 9), (1, "hello  there", 9),
                                (4, "w\n" * 50_000, 9)], "doc_id long, text string, ids long")
    got = S.encode_documents(df, parity_every=1)
    rows = got.collect()
    assert len(rows) == 5 and all(r["restored"] and r["parity"] for r in rows)
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    back = {r["doc_id"]: r["text"] for r in S.decode_ids(got).collect()}
    assert back[1] == "hello  there" and back[None] == "" and back[4] == "w\n" * 50_000
    assert S.encode_documents(df.limit(0)).count() == 0


def test_parity_is_verified_on_every_row(spark):
    data = S.read_model()
    spec, ref = S.parse_model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [f"number {i} goes  on " for i in range(40)] + ["", " ", "x " * 9]
    assert [r[2] for r in S.encode_batch(texts, S.Coder(spec, reference=ref), ref, 8)] == [True] * 43
    a, b = ref.piece_to_id("▁number"), ref.piece_to_id("▁people")
    pieces = list(spec.pieces)
    pieces[a], pieces[b] = pieces[b], pieces[a]                                   # two ids change places
    other = S.Coder(S.Spec(**{**vars(spec), "pieces": tuple(pieces)}), reference=ref)
    assert [r[2] for r in S.encode_batch(texts, other, ref, 8)] == [False] * 40 + [True] * 3
    broken = S.Coder(spec, reference=ref)
    words = broken._words
    broken._words = lambda t: words(t)[:-1]                                       # words that lose the text's end
    assert [r[2] for r in S.encode_batch(texts[:40], broken, ref, 0)] == [False] * 40
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    assert [r["parity"] for r in S.encode_documents(df).collect()] == [True] * 44


@pytest.mark.parametrize("byte_fallback,squeeze", [(True, False), (True, True), (False, False)])
def test_unigram_rows_have_parity(byte_fallback, squeeze):
    coder, ref = S._load(unigram_model(byte_fallback, squeeze))
    rows = S.encode_batch(["abc cab", "a  b ", " ", "cabab abcab bca", "  ab c ", "", "abc" * 40], coder, ref, 0)
    assert all(r[2] for r in rows)


def test_bad_models_are_refused():
    with pytest.raises(ValueError):
        S.parse_model(b"")
    with pytest.raises(ValueError):
        S.build_tokenizer(S.Spec((("a", 0.0, 1),), model_type=4))


def test_words_already_met_are_looked_up_once():
    from geoplane.llm import sentencepiece as S

    class Index(dict):
        again = 0

        def __getitem__(self, word):
            Index.again += 1
            return dict.__getitem__(self, word)

    coder, _ = S._load(S.read_model())
    texts = ["one word and one word more", "", "one more"]
    want = coder.checked(texts)
    coder.index = Index(coder.index)
    got = coder.checked(texts)
    assert Index.again == 0 and [a.tolist() for a in got[0]] == [a.tolist() for a in want[0]] and got[1:] == want[1:]
    assert [a.tolist() for a in want[0]] == [e.ids for e in coder.full.encode_batch_fast(texts, add_special_tokens=False)]


def test_words_that_agree_are_compared_as_one_list():
    class Same(list):
        asked = 0

        def __eq__(self, other):
            Same.asked += 1
            return list.__eq__(self, other)

        __hash__ = None

    coder, ref = S._load(S.read_model())
    words = [" one", " word", " and", " more"]
    ids = Same(ref.encode([w[1:] for w in words]))
    assert coder._agrees(words, ids) == [True] * 4 and Same.asked == 1
    assert coder._agrees([*words, " "], [*ids, [ref.piece_to_id(S.META)]]) == [True] * 5
    assert coder._agrees(words, [ids[1], *ids[1:]]) == [False, True, True, True]
    assert S.CACHE_WORDS >= 1_000_000        # words of a worker met once must not crowd out those met again
