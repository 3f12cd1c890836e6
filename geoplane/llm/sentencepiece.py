"""SentencePiece models run on the ``tokenizers`` library.

The model protobuf is parsed here (wire format; only the fields that decide an
encoding), and the pipeline is rebuilt from ``tokenizers`` parts: the
normaliser's character map, white space clean-up, the metaspace marker, the
unigram scores or the merges of a BPE model, and byte fallback.  Each Arrow
batch is encoded in one multithreaded call, decoded again, and checked.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoplane.llm.common import prepare

# Fixed values of the public sentencepiece_model.proto.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
META = "▁"


@dataclass(frozen=True)
class Spec:
    """What a model file says about encoding."""

    pieces: tuple[tuple[str, float, int], ...]      # text, score, type
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    whitespace_suffix: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        if wire not in (1, 2, 5):
            raise ValueError(f"wire type {wire} in a model file")
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        yield tag >> 3, data[at:at + size]
        at += size


def parse_model(data: bytes) -> Spec:
    """Parse a serialised ModelProto (pieces 1, trainer 2, normaliser 3)."""
    pieces: list[tuple[str, float, int]] = []
    trainer: dict[int, int | bytes] = {}
    normaliser: dict[int, int | bytes] = {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
            pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if not pieces:
        raise ValueError("the model file holds no piece")
    return Spec(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0)),
                bytes(normaliser.get(2, b"")), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)),
                bool(normaliser.get(5, 1)))


def merges(pieces: tuple[tuple[str, float, int], ...]) -> list[tuple[str, str]]:
    """Merge rules of a BPE model: every split of a normal piece into two pieces, by falling score."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    rules = []
    for piece, score, kind in pieces:
        if kind != NORMAL or len(piece) < 2:
            continue
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                rules.append((-score, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(rules)]


def build_tokenizer(spec: Spec):
    """A ``tokenizers.Tokenizer`` that encodes and decodes like the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if spec.whitespace_suffix:
        raise ValueError("models with the marker at the word's end are not supported")
    unknown = next((i for i, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN), None)
    if spec.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unknown,
                               byte_fallback=spec.byte_fallback)
    elif spec.model_type == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec.pieces),
                           unk_token=None if unknown is None else spec.pieces[unknown][0], fuse_unk=True,
                           byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type}: only unigram and BPE models are supported")
    tok = Tokenizer(model)
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(" " if not spec.escape_whitespaces else META))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", META))
    tok.normalizer = normalizers.Sequence(steps)
    if splits_at_markers(spec):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{META}*[^{META}]+|{META}+"), "isolated")
    extra = [AddedToken(p, normalized=False, special=False) for p, _, kind in spec.pieces if kind == USER_DEFINED]
    if extra:
        tok.add_tokens(extra)
    parts = [decoders.Replace(META, " "), decoders.ByteFallback(), decoders.Fuse()]
    if spec.add_dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    tok.decoder = decoders.Sequence(parts)
    return tok


def default_model() -> str:
    """The public model installed with the tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# Distinct words whose ids a worker keeps; the table starts anew beyond it.
CACHE_WORDS = 1_000_000
# Words encoded in one multithreaded call (an encoding takes far more memory than its ids).
CALL_WORDS = 4096
# Threads of a worker's encoding calls: the cores that an executor of the usual shape gives a task.
THREADS = 2


def splits_at_markers(spec: Spec) -> bool:
    """Whether no piece goes on past a marker, so that words (with the markers before them) encode alone."""
    return spec.escape_whitespaces and not any(
        META in p.lstrip(META) for p, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)) and not any(
        kind == USER_DEFINED for _, _, kind in spec.pieces)


class Coder:
    """Encodes batches of texts with a rebuilt tokenizer.

    Where the model splits at markers, the distinct words of a batch that the
    worker has not met are encoded in one multithreaded call, decoded again
    and kept; texts are gathered from the table.  Other models encode whole
    texts in one multithreaded call.

    With a ``reference`` processor, each word is also encoded by the reference
    as it is learnt, and each text's words must join to the reference's
    normalised text: no piece goes past a marker, so the reference's ids of a
    text are those of its words one after the other.
    """

    def __init__(self, spec: Spec, cache_words: int = CACHE_WORDS, reference=None):
        from tokenizers import Tokenizer

        self.spec, self.cache_words = spec, cache_words
        self.full = build_tokenizer(spec)
        self.by_word = splits_at_markers(spec)
        self.word_tok = Tokenizer(self.full.model)
        self.word_tok.decoder = self.full.decoder
        self.plain = not spec.charsmap and not spec.remove_extra_whitespaces
        # normalising a word again must change nothing, and a marker alone must be a piece
        self.reference = reference if (reference is not None and self.by_word and self.plain and reference.piece_to_id(
            META) != reference.unk_id()) else None
        self.marker = None if self.reference is None else [reference.piece_to_id(META)]
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)
        self.same = np.zeros(0, dtype=bool)
        self.met = np.zeros(0, dtype=np.int64)

    def _shrink(self) -> None:
        """Keep the words met most often, half of what the table may hold at most, with what was proven of them."""
        words, k = list(self.index), len(self.index)
        most = np.argsort(-self.met[:k], kind="stable")[:self.cache_words // 2]
        keep = np.sort(most[self.met[most] > 1])
        lo, n = self.start[keep], self.start[keep + 1] - self.start[keep]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        good, same, met = self.good[keep], self.same[keep], self.met[keep] // 2
        self._reset()
        self.index = {words[i]: j for j, i in enumerate(keep.tolist())}
        self.flat = np.concatenate([flat, self.flat])
        self.start = np.concatenate([[0], ends])
        self.good, self.same, self.met = good, same, met

    def _words(self, text: str) -> list[str]:
        """The marker-bounded words of the normalised text, with spaces for markers."""
        if not text:
            return []
        if not self.plain:
            return _NORMAL_WORD.findall(self.full.normalizer.normalize_str(text).replace(META, " "))
        if META in text:
            text = text.replace(META, " ")
        return _NORMAL_WORD.findall(" " + text if self.spec.add_dummy_prefix else text)

    def _learn(self, words: list[str]) -> None:
        marked = [w.replace(" ", META) for w in words]
        ids = [e.ids for e in self.word_tok.encode_batch_fast(marked, add_special_tokens=False)]
        back = self.word_tok.decode_batch(ids, skip_special_tokens=False)
        cut = self.spec.add_dummy_prefix
        good = [b == (w[1:] if cut and w[0] == " " else w) for b, w in zip(back, words, strict=True)]
        same = self._agrees(words, ids)
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        at = self.start[len(self.index)]
        ends = at + np.cumsum(lengths)
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(2 * int(ends[-1]) - len(self.flat), dtype=np.int32)])
        self.flat[at:ends[-1]] = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32,
                                             count=int(ends[-1] - at))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        k = len(self.index)
        if k + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.empty(k + 1, dtype=np.int64)])
            self.good = np.concatenate([self.good, np.empty(k + 1, dtype=bool)])
            self.same = np.concatenate([self.same, np.empty(k + 1, dtype=bool)])
        self.start[k - len(words) + 1:k + 1] = ends
        self.good[k - len(words):k] = good
        self.same[k - len(words):k] = same

    def _agrees(self, words: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the reference gives each word the same ids (it puts the first marker itself)."""
        if self.reference is None:
            return [False] * len(words)
        cut = self.spec.add_dummy_prefix
        expected = self.reference.encode([w[1:] if cut else w for w in words], num_threads=1)
        if ids == expected:             # the lists as a whole: nearly always
            return [True] * len(words)
        return [i == (self.marker if w == " " else e) for i, e, w in zip(ids, expected, words, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Token ids of each whole text, and whether decoding them gives the text back."""
        return self.checked(texts)[:2]

    def checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool] | None]:
        """``encode``, and whether the reference agrees on each text (None: it was not asked word by word)."""
        if not self.by_word:
            coded = self.full.encode_batch_fast(texts, add_special_tokens=False)
            back = self.full.decode_batch([e.ids for e in coded], skip_special_tokens=False)
            return ([np.asarray(e.ids, dtype=np.int32) for e in coded],
                    [b == t for b, t in zip(back, texts, strict=True)], None)
        if len(self.index) > self.cache_words:
            self._shrink()
        words = [self._words(t) for t in texts]
        places = [np.fromiter(map(self.index.get, own, itertools.repeat(-1)), dtype=np.int64, count=len(own))
                  for own in words]
        unmet = [np.flatnonzero(at < 0).tolist() for at in places]
        new = list(dict.fromkeys(own[j] for own, js in zip(words, unmet, strict=True) for j in js))
        for lo in range(0, len(new), CALL_WORDS):
            self._learn(new[lo:lo + CALL_WORDS])
        for at, own, js in zip(places, words, unmet, strict=True):
            if js:
                at[js] = [self.index[own[j]] for j in js]
        normal = None if self.reference is None else self.reference.normalize(texts)
        ids, restored, same = [], [], []
        used = [np.zeros(0, dtype=np.int64)]
        for i, (text, own, at) in enumerate(zip(texts, words, places, strict=True)):
            used.append(at)
            lo = self.start[at]
            n = self.start[at + 1] - lo
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids.append(self.flat[np.repeat(lo - (ends - n), n) + np.arange(total)])
            whole = "".join(own)
            if normal is not None:
                same.append(bool(self.same[at].all()) and whole.replace(" ", META) == normal[i])
            if self.spec.add_dummy_prefix:
                whole = whole[1:]
            restored.append(bool(self.good[at].all()) and whole == text)
        met = np.bincount(np.concatenate(used), minlength=len(self.index))
        met[:len(self.met)] += self.met
        self.met = met
        return ids, restored, None if normal is None else same


_NORMAL_WORD = re.compile(" *[^ ]+| +")
_LOADED: dict[str, tuple] = {}


def _load(data: bytes) -> tuple:
    """Coder and reference processor, built once in each worker process."""
    import sentencepiece

    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        _LOADED[key] = (Coder(parse_model(data), reference=reference), reference)
    return _LOADED[key]


def read_model(path: str | None = None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


def _checked(text: str, every: int) -> bool:
    """Whether the text belongs to the rows also compared as a whole: 1 in ``every`` by its content's hash."""
    return every == 1 or (every > 0 and int.from_bytes(
        hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % every == 0)


def encode_batch(texts: list[str], coder: Coder, reference, parity_every: int) -> list[tuple]:
    """(ids, restored, parity) of each text.

    Parity is verified on every text: word by word where the coder can, and on
    1 text in ``parity_every`` (0: none) as a whole too; otherwise all as a whole.
    """
    ids, restored, same = coder.checked(texts)
    if same is None:
        same, parity_every = [True] * len(texts), 1
    picked = [i for i, t in enumerate(texts) if _checked(t, parity_every)]
    if picked:
        for i, expected in zip(picked, reference.encode([texts[i] for i in picked], num_threads=1), strict=True):
            same[i] = same[i] and len(expected) == len(ids[i]) and bool(
                (ids[i] == np.asarray(expected, dtype=np.int32)).all())
    return list(zip(ids, restored, same, strict=True))


def encode_documents(docs: DataFrame, model: bytes | None = None, parity_every: int = 0,
                     id_col: str = "doc_id", text_col: str = "text", strict: bool = True) -> DataFrame:
    """``doc_id, ids, n_tokens, restored, parity`` for every row of ``docs``.

    ``ids`` are the whole text's token ids (null or empty text: none, restored);
    ``restored`` says that decoding gives the text back; ``parity`` that the
    sentencepiece library gives the same ids, verified on every row
    (``encode_batch``): word by word, and for models that do not split at markers
    as whole texts; one text in ``parity_every`` (1: every row, 0: none), chosen
    by its hash, is also compared as a whole where its words are proven.  ``strict`` fails the job on a row without parity.  Null ids and
    repeated rows keep their rows, an empty table gives none, other columns
    are not read.  No shuffle.
    """
    prepare(docs.sparkSession)
    data = model or read_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))      # read when the first call starts the threads
        coder, reference = _load(data)
        for b in batches:
            texts = [t or "" for t in b["__t"]]
            rows = encode_batch(texts, coder, reference, parity_every)
            if strict and not all(p for _, _, p in rows):
                raise ValueError("the rebuilt tokenizer and the model disagree")
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [r[0] for r in rows],
                                "n_tokens": np.array([len(r[0]) for r in rows], dtype=np.int64),
                                "restored": [r[1] for r in rows], "parity": [r[2] for r in rows]})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__t"))
    return src.mapInPandas(run, "doc_id long, ids array<int>, n_tokens long, restored boolean, parity boolean")


def decode_ids(coded: DataFrame, model: bytes | None = None, ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the texts of token id lists (null ids: empty text)."""
    prepare(coded.sparkSession)
    data = model or read_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _load(data)[0].full
        for b in batches:
            ids = [[] if v is None else [int(i) for i in v] for v in b["__ids"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": tok.decode_batch(ids, skip_special_tokens=False)})

    src = coded.select("doc_id", F.col(ids_col).alias("__ids"))
    return src.mapInPandas(run, "doc_id long, text string")
