"""BPE encoding and decoding by tree concatenation.

A text is split where the tokenizer always splits: at white space, which no
pre-token spans.  A long unsplit run (no white space, and one pre-token) is cut
into halves down to leaves, the leaves of a batch are encoded in one
multithreaded call, and halves are joined level by level: a window of tokens
around the join is encoded again, and grows until its outermost token on each
side is the one that side already had.

Why that is exact: a row of tokens is the BPE encoding of its text exactly when
each two neighbours, encoded as one text, come out as these two again (the
first merge across a border in the whole would also happen in the pair alone).
Pairs inside a half keep that property, and the agreed window supplies the
pairs around the join.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoplane.llm.common import prepare

# The characters that the tokenizers' regular expressions take as white space.
SPACES = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RUN = re.compile(f"[^{SPACES}]+")
# Separators that str.split takes as white space too, and the library does not.
_OTHER = re.compile("[\x1c-\x1f]")

# Runs of more code points are taken apart; a leaf of the tree holds at most LEAF symbols.
LONG, LEAF = 64, 64
# Tokens on each side of a join that are encoded again first; doubled until both sides agree.
WINDOW = 4
# Distinct runs a worker keeps, and runs encoded in one multithreaded call.
CACHE_RUNS, CALL_RUNS = 300_000, 4096
# Longer runs are kept for their batch only, so that CACHE_RUNS bounds the table's bytes.
KEEP = 256
THREADS = 2


def default_path() -> str:
    """The public word-level BPE file installed with the tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TreeCoder:
    """Encodes texts as ``Tokenizer.from_str(spec).encode(text, add_special_tokens=False)`` does."""

    def __init__(self, spec: str, leaf: int = LEAF, long: int = LONG, window: int = WINDOW,
                 cache_runs: int = CACHE_RUNS):
        from tokenizers import Tokenizer, models

        self.leaf, self.long, self.window, self.cache_runs = max(leaf, 1), long, max(window, 1), cache_runs
        self.full = Tokenizer.from_str(spec)
        self.full.no_truncation()
        self.full.no_padding()
        parts = json.loads(spec)
        model = parts["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        # a piece's last symbol carries the word-end suffix: `close` encodes such ends, `open` what goes on
        self.open = Tokenizer(models.BPE(vocab, merges))
        self.close = Tokenizer(models.BPE(vocab, merges, end_of_word_suffix=self.suffix) if self.suffix else
                               models.BPE(vocab, merges))
        added = parts.get("added_tokens", [])
        self.special = re.compile("|".join(re.escape(a["content"]) for a in sorted(
            added, key=lambda a: -len(a["content"])))) if added else None
        self.special_ids = {a["content"]: a["id"] for a in added}
        size = max([*vocab.values(), *self.special_ids.values()]) + 1
        self.tokens = [self.full.id_to_token(i) or "" for i in range(size)]
        # symbols a token covers, its suffix left out
        self.symbols = np.array([len(t) - len(self.suffix) * bool(self.suffix and t.endswith(self.suffix))
                                 for t in self.tokens], dtype=np.int64)
        self._check(parts, vocab)
        self._reset()

    def _check(self, parts: dict, vocab: dict) -> None:
        """Whether this tokenizer splits at white space and every symbol has an id: the method rests on both."""
        from tokenizers import pre_tokenizers

        model, steps = parts["model"], parts.get("pre_tokenizer") or {}
        bad = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") \
            or model.get("ignore_merges") or model["type"] != "BPE"
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"])
                    for a in parts.get("added_tokens", []))
        split = steps.get("pretokenizers", [{}])[0]
        alphabet = pre_tokenizers.ByteLevel.alphabet()
        if bad or not plain or split.get("type") != "Split" or split.get("behavior") != "Removed" \
                or not split.get("invert") or not all(c in vocab and c + self.suffix in vocab for c in alphabet) \
                or parts.get("decoder") is not None or parts.get("post_processor") is not None:
            raise ValueError("only byte-level BPE files that drop white space are supported")

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.decoded: list[str] = []
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 12, dtype=np.int64)
        self.seen = np.zeros(0, dtype=np.int64)

    def _shrink(self) -> None:
        """Keep the runs met most often, half of what the table may hold at most."""
        runs, k = list(self.index), len(self.index)
        most = np.argsort(-self.seen[:k], kind="stable")[:self.cache_runs // 2]
        keep = np.sort(most[self.seen[most] > 1]).tolist()
        ids = [self.flat[self.start[i]:self.start[i + 1]].tolist() for i in keep]
        seen = self.seen[keep] // 2
        self._reset()
        if keep:
            self._add([runs[i] for i in keep], ids)
            self.seen = seen

    # ------------------------------------------------------------------ the tree
    def _encode(self, items: list[tuple[str, bool]]) -> list[np.ndarray]:
        """Ids of (symbols, whether they end a piece), in two multithreaded calls."""
        out: list[np.ndarray] = [None] * len(items)
        for tok, ends in ((self.open, False), (self.close, True)):
            at = [i for i, (_, e) in enumerate(items) if e == ends]
            for lo in range(0, len(at), CALL_RUNS):
                part = at[lo:lo + CALL_RUNS]
                for i, e in zip(part, tok.encode_batch_fast([items[i][0] for i in part], add_special_tokens=False),
                                strict=True):
                    out[i] = np.asarray(e.ids, dtype=np.int64)
        return out

    def join(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of whole pre-tokens (byte-level symbols), each encoded as a tree of halves."""
        nodes: list[list[tuple[int, int, np.ndarray]]] = []
        leaves = []
        for p in pieces:
            depth = max((len(p) - 1) // self.leaf, 0).bit_length()
            cuts = [len(p) * i >> depth for i in range((1 << depth) + 1)]
            nodes.append(list(itertools.pairwise(cuts)))
            leaves += [(p[a:b], b == len(p)) for a, b in nodes[-1]]
        ids = iter(self._encode(leaves))
        nodes = [[(a, b, next(ids)) for a, b in own] for own in nodes]
        while any(len(own) > 1 for own in nodes):
            pairs = [(k, j) for k, own in enumerate(nodes) for j in range(0, len(own) - 1, 2)]
            joined = self._join_level([(pieces[k], nodes[k][j], nodes[k][j + 1]) for k, j in pairs])
            done = dict(zip(pairs, joined, strict=True))
            nodes = [[done.get((k, j), own[j]) for j in range(0, len(own), 2)] for k, own in enumerate(nodes)]
        return [own[0][2] for own in nodes]

    def _join_level(self, pairs: list[tuple]) -> list[tuple[int, int, np.ndarray]]:
        out: list = [None] * len(pairs)
        width = [self.window] * len(pairs)
        open_ = list(range(len(pairs)))
        while open_:
            items, spans = [], []
            for i in open_:
                piece, (_, cut, left), (_, end, right) = pairs[i]
                lo = cut - int(self.symbols[left[-width[i]:]].sum())
                hi = cut + int(self.symbols[right[:width[i]]].sum())
                spans.append((lo, hi))
                items.append((piece[lo:hi], hi == len(piece)))
            left_over = []
            for i, (lo, hi), mid in zip(open_, spans, self._encode(items), strict=True):
                piece, (a, cut, left), (_, end, right) = pairs[i]
                w = width[i]
                whole_left, whole_right = w >= len(left), w >= len(right)
                if (whole_left or mid[0] == left[-w]) and (whole_right or mid[-1] == right[w - 1]):
                    out[i] = (a, end, np.concatenate([left[:-w] if not whole_left else left[:0], mid, right[w:]]))
                else:
                    width[i] = 2 * w
                    left_over.append(i)
            open_ = left_over
        return out

    def _long_run(self, run: str) -> np.ndarray:
        """Ids of a long run: special strings, then pre-tokens, the long ones as trees."""
        found: list = []
        at = 0
        for m in itertools.chain(self.special.finditer(run) if self.special else (), [None]):
            text = run[at:m.start() if m else len(run)]
            if text:
                normal = self.full.normalizer.normalize_str(text) if self.full.normalizer else text
                found += [p for p, _ in self.full.pre_tokenizer.pre_tokenize_str(normal)]
            if m:
                found.append(self.special_ids[m.group()])
                at = m.end()
        ids = iter(self.join([f for f in found if isinstance(f, str)]))
        parts = [next(ids) if isinstance(f, str) else np.array([f]) for f in found]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    # ------------------------------------------------------------------ texts
    def _add(self, runs: list[str], ids: list) -> None:
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        k, at = len(self.index), int(self.start[len(self.index)])
        ends = at + np.cumsum(lengths)
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(2 * int(ends[-1]) - len(self.flat), dtype=np.int32)])
        if k + len(ids) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(k + len(ids) + 1, dtype=np.int64)])
        own = list(itertools.chain.from_iterable(ids))
        self.flat[at:ends[-1]] = own
        self.start[k + 1:k + len(ids) + 1] = ends
        self.index.update(zip(runs, range(k, k + len(ids)), strict=True))
        words = list(map(self.tokens.__getitem__, own))
        cuts = (ends - at).tolist()
        self.decoded += [" ".join(words[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, runs: list[str]) -> None:
        """Ids of new runs: letters of ASCII are one pre-token, the library splits other short runs itself."""
        plain, other, long = [], [], []
        for r in runs:
            (long if len(r) > self.long else plain if r.isascii() and r.isalpha() else other).append(r)
        for tok, part in ((self.close, plain), (self.full, other)):
            for lo in range(0, len(part), CALL_RUNS):
                own = part[lo:lo + CALL_RUNS]
                texts = [r.lower() for r in own] if tok is self.close else own
                self._add(own, [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
        for run in sorted(long, key=len):
            self._add([run], [self._long_run(run)])

    def _forget_long(self) -> None:
        """Drop the runs of more than KEEP code points, which are the last ones learnt."""
        while self.decoded and len(last := next(reversed(self.index))) > KEEP:
            del self.index[last]
            self.decoded.pop()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids in one array, the offsets of each text in it (len + 1), and each text decoded again."""
        if len(self.index) > self.cache_runs:
            self._shrink()
        runs = [t.split() if t.isascii() and not _OTHER.search(t) else _RUN.findall(t) for t in texts]
        self._learn(list(set(itertools.chain.from_iterable(runs)) - self.index.keys()))
        counts = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(runs)), dtype=np.int64,
                         count=int(counts.sum()))
        met = np.bincount(at, minlength=len(self.index))
        met[:len(self.seen)] += self.seen
        lo = self.start[at]
        n = self.start[at + 1] - lo
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(lo - ends[:-1], n) + np.arange(ends[-1])]
        first = np.concatenate([[0], np.cumsum(counts)])
        decoded, words = self.decoded, at.tolist()
        # a run of ignorable symbols only has no token and no part in the decoded text
        back = [" ".join([d for i in words[a:b] if (d := decoded[i])]) for a, b in itertools.pairwise(first.tolist())]
        self._forget_long()
        self.seen = met[:len(self.index)]
        return ids, ends[first], back


_LOADED: dict[str, TreeCoder] = {}


def _load(spec: str) -> TreeCoder:
    """One coder a worker process and tokenizer file."""
    if spec not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        _LOADED.clear()
        _LOADED[spec] = TreeCoder(spec)
    return _LOADED[spec]


def read_spec(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs``.

    ``ids`` are the whole text's token ids, ``decoded`` the text that the
    library's ``decode(ids, skip_special_tokens=False)`` gives.  Null and empty
    texts have no ids and decode to an empty text; null ids and repeated rows
    keep their rows; texts of any length are whole; an empty table gives no
    rows; other columns are not read.  No shuffle.
    """
    prepare(docs.sparkSession)
    spec = read_spec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _load(spec)
        for b in batches:
            ids, offsets, back = coder.encode([t or "" for t in b.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(back, type=pa.string())],
                                             names=["doc_id", "ids", "decoded"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__t"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode_ids(coded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: token id lists decoded by the library (null ids: empty text)."""
    prepare(coded.sparkSession)
    spec = read_spec(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _load(spec).full
        for b in batches:
            ids = [i or [] for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(tok.decode_batch(ids, skip_special_tokens=False), type=pa.string())],
                names=["doc_id", "text"])

    return coded.select("doc_id", F.col(ids_col).alias("__ids")).mapInArrow(run, "doc_id long, text string")
