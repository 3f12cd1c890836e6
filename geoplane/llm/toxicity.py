"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel compares two words by their common subsequences of three
characters; a subsequence that spans k characters weighs ``decay ** k`` and
spans of up to ``span`` characters count, so that a gap or an inserted
character lowers a match instead of breaking it.  Words are compared with a
set of landmark words; multiplying the landmark similarities with the inverse
square root of the landmarks' kernel matrix gives the Nyström features on
which the machine is trained.  A sentence scores as its strongest word and a
text as its strongest sentence; since only the text's label is known, training
alternates between choosing the witness words of toxic sentences and fitting.

The trained machine is linear in the subsequence weights, so it is kept as one
table with a weight for each subsequence, and a word costs a few lookups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoplane.llm.common import code_points, fold, hash_sample, prepare, sample_share

ALPHABET = 80                # a to z and a word's two ends have their own codes, other characters share the rest
SPAN, DECAY = 6, 0.7
FLOOR = -0.5                 # margins are not told apart below this
TRAIN_DOCS = 3000            # bound of the labelled sample, half of it toxic where there are enough
LANDMARKS = 128
NEGATIVES = 20_000           # distinct clean words that the machine is fitted on
CACHE_WORDS = 300_000        # distinct words whose score a worker keeps
PIECE, OVERLAP = 48, 12      # longer words are scored in overlapping pieces

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]


def sentence_words(sentence: str) -> set[str]:
    """Distinct lower-cased words without outer punctuation; spaced-out letters also count as one word."""
    low = sentence.lower()
    out = set(low.split())
    if _SPACED.search(low):
        out |= {"".join(m.group().split()) for m in _SPACED.finditer(low)}
    return out


def bare(word: str) -> str:
    return _EDGE.sub("", word)


def stretched(word: str) -> list[str]:
    """``word`` with one character inserted at each inner place, and with all of them filled."""
    return [f"{word[:i]}{c}{word[i:]}" for i in range(1, len(word)) for c in "x-"] + [".".join(word)]


def _pieces(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words cut into overlapping pieces, and the word each piece belongs to."""
    out, owner = [], []
    for i, w in enumerate(words):
        if len(w) <= PIECE:
            out.append(w)
            owner.append(i)
        else:
            for at in range(0, len(w) - OVERLAP, PIECE - OVERLAP):
                out.append(w[at:at + PIECE])
                owner.append(i)
    return out, np.array(owner, dtype=np.int64)


def _occurrences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, subsequence code) of every occurrence and its weight, one step pattern at a time.

    The ends of a word are characters of their own, so that subsequences tell
    a word's first and last letters from inner ones.
    """
    chars, ends = code_points([f"\x02{w}\x03" for w in words])
    code = chars.astype(np.int64)
    code = np.where((code >= 97) & (code <= 122), code - 97,
                    np.where((code == 2) | (code == 3), code + 24, 28 + code % (ALPHABET - 28)))
    row = np.repeat(np.arange(len(words)), np.diff(ends))
    for a, b in _STEPS:
        n = len(code) - a - b
        if n > 0:
            inside = np.flatnonzero(row[:n] == row[a + b:])
            found = code[inside] * (ALPHABET * ALPHABET) + code[inside + a] * ALPHABET + code[inside + a + b]
            yield row[inside], found, DECAY ** (a + b + 1)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence code, weight), one entry for each distinct subsequence of each word."""
    parts = [(r * ALPHABET ** 3 + c, np.full(len(r), w)) for r, c, w in _occurrences(words)]
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    weight = np.bincount(at, np.concatenate([w for _, w in parts]), minlength=len(key))
    return key // ALPHABET ** 3, key % ALPHABET ** 3, weight


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised kernel of each pair (for the landmarks and the tests; words without a subsequence give 0)."""
    codes: dict[int, int] = {}

    def dense(words: list[str]) -> list[dict[int, float]]:
        out: list[dict[int, float]] = [{} for _ in words]
        for r, c, w in zip(*subsequences(words), strict=True):
            out[r][codes.setdefault(int(c), len(codes))] = float(w)
        return out

    a, b = dense(left), dense(right)

    def matrix(rows: list[dict[int, float]]) -> np.ndarray:
        m = np.zeros((len(rows), max(1, len(codes))))
        for i, r in enumerate(rows):
            m[i, list(r)] = list(r.values())
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    return matrix(a) @ matrix(b).T


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray        # weight of each subsequence code
    bias: float
    slope: float             # score = 1 / (1 + exp(-(slope * margin + offset)))
    offset: float

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's margin of each word (its strongest piece), FLOOR where it is lower."""
        out = np.full(len(words), FLOOR)
        pieces, owner = _pieces(words)
        for lo in range(0, len(pieces), 20_000):
            part, own = pieces[lo:lo + 20_000], owner[lo:lo + 20_000]
            dot, least = np.zeros(len(part)), np.zeros(len(part))
            for r, c, w in _occurrences(part):
                dot += w * np.bincount(r, self.table[c], minlength=len(part))
                least += w * w * np.bincount(r, minlength=len(part))
            # repeated subsequences only make a word's norm larger: most words are settled by this bound
            near = np.flatnonzero(dot > (FLOOR - self.bias) * np.sqrt(least))
            if len(near):
                row, _, weight = subsequences([part[i] for i in near])
                norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(near)))
                np.maximum.at(out, own[near], dot[near] / np.maximum(norm, 1e-12) + self.bias)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _landmarks(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, size: int) -> list[str]:
    """Half from the words that most mark toxic texts, unlike one another; half frequent clean words."""
    def odds(w: str) -> float:
        return (np.log((toxic[w] + 0.5) / (n_toxic + 1)) - np.log((clean[w] + 0.5) / (n_clean + 1))) * np.sqrt(toxic[w])

    ranked = sorted((w for w in toxic if len(w) > 2), key=lambda w: (-odds(w), w))[: 4 * size]
    marks: list[str] = []
    if ranked:
        k = kernel(ranked, ranked)
        near = np.zeros(len(ranked))
        value = np.array([max(odds(w), 0.0) for w in ranked])
        while len(marks) < size // 2:
            i = int(np.argmax(value * (1.02 - near)))
            if value[i] <= 0 or near[i] > 0.98:
                break
            marks.append(ranked[i])
            near = np.maximum(near, k[i])
    common = sorted((w for w in clean if len(w) > 2 and w not in marks), key=lambda w: (-clean[w], w))
    return marks + common[: size - len(marks)]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps (last weight: the bias)."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        slack = 1 - y * (a @ w)
        on = slack > 0
        if not on.any():
            break
        ao, wo = a[on], weight[on]
        step = np.linalg.solve(reg * np.eye(len(w)) + ao.T @ (ao * wo[:, None]), ao.T @ (wo * y[on]))
        if np.abs(step - w).max() < 1e-8:
            break
        w = step
    return w


def fit(documents: list[tuple[bool, list[list[str]]]], landmarks: int = LANDMARKS,
        negatives: int = NEGATIVES, rounds: int = 3) -> ToxicityModel:
    """Train on (toxic, sentences as lists of words); without a toxic document every text scores near 0.

    Words longer than PIECE take part by their pieces.
    """
    docs = [(t, [s for s in ([w for w in _pieces(words)[0] if len(w) > 2] for words in sentences) if s])
            for t, sentences in documents]
    toxic: Counter[str] = Counter()
    clean: Counter[str] = Counter()
    for t, sentences in docs:
        (toxic if t else clean).update({w for s in sentences for w in s})
    n_toxic = sum(t for t, _ in docs)
    n_clean = len(docs) - n_toxic
    if not toxic or not clean:
        return ToxicityModel(np.zeros(ALPHABET ** 3), -1.0, 4.0, 0.0 if n_clean or not docs else 8.0)
    marks = _landmarks(toxic, clean, n_toxic, n_clean, landmarks)
    value, vector = np.linalg.eigh(kernel(marks, marks))
    value = np.where(value > 1e-6, value, np.inf)
    root = (vector / np.sqrt(value)) @ vector.T                       # inverse square root
    # landmark kernel rows as a table: code -> contribution to each landmark
    row, code, weight = subsequences(marks)
    norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(marks)))
    used, at = np.unique(code, return_inverse=True)
    place = np.zeros(ALPHABET ** 3, dtype=np.int64)
    place[used] = np.arange(1, len(used) + 1)
    small = np.zeros((len(used) + 1, len(marks)))          # row 0: subsequences of no landmark
    small[at + 1, row] = weight / np.maximum(norm[row], 1e-12)

    def similarity(words: list[str]) -> np.ndarray:
        """Nyström features of words."""
        out = np.zeros((len(words), len(marks)))
        for lo in range(0, len(words), 2000):
            part = words[lo:lo + 2000]
            r, c, g = subsequences(part)
            hit = place[c] > 0
            np.add.at(out[lo:lo + 2000], r[hit], small[place[c[hit]]] * g[hit, None])
            n = np.sqrt(np.bincount(r, g * g, minlength=len(part)))
            out[lo:lo + len(part)] /= np.maximum(n, 1e-12)[:, None]
        return out @ root

    # clean words: the most frequent and a spread of the others
    order = sorted(clean, key=lambda w: (-clean[w], w))
    step = max(1, len(order) // negatives)
    bad = order[::step][:negatives]
    x_bad = similarity(bad)
    odds = {w: np.log((toxic[w] + 0.5) / (n_toxic + 1)) - np.log((clean[w] + 0.5) / (n_clean + 1)) for w in toxic}
    strength = {w: o * np.sqrt(toxic[w]) for w, o in odds.items()}
    model = ToxicityModel(np.zeros(ALPHABET ** 3), 0.0, 1.0, 0.0)
    for _ in range(rounds):
        witness: Counter[str] = Counter()
        for t, sentences in docs:
            if t and sentences:
                best = max((w for s in sentences for w in s), key=lambda w: (strength[w], w))
                for s in sentences:                     # the document's witness, and its sentences' strong words
                    w = max(s, key=lambda v: (strength[v], v))
                    if w == best or (strength[w] > 0.5 * strength[best] and odds[w] > 2):
                        witness[w] += 1
        good = sorted(witness)
        more = [(v, 0.5 * witness[w] / len(stretched(w))) for w in good for v in stretched(w)]
        x = np.vstack([similarity(good + [v for v, _ in more]), x_bad])
        y = np.concatenate([np.ones(len(good) + len(more)), -np.ones(len(bad))])
        count = np.array([witness[w] for w in good] + [c for _, c in more], dtype=float)
        weight = np.concatenate([count / count.sum(), np.full(len(bad), 1.0 / len(bad))])
        w = _svm(x, y, weight)
        alpha = root @ w[:-1]
        table = np.zeros(ALPHABET ** 3)
        table[used] = small[1:] @ alpha
        model = ToxicityModel(table, float(w[-1]), 1.0, 0.0)
        words = list(toxic)
        margin = dict(zip(words, model.margins(words), strict=True))
        # the next witnesses: strong for the machine and marked by the labels
        strength = {v: (1 + margin[v]) * max(odds[v], 0.0) for v in words}
    every = list(set(toxic) | set(clean))
    margin = dict(zip(every, model.margins(every), strict=True))
    top = np.array([max((margin[w] for s in sentences for w in s), default=FLOOR) for _, sentences in docs])
    label = np.array([t for t, _ in docs], dtype=bool)
    # the cut that errs least on the training texts, in the middle of its gap
    cuts = np.unique(top)
    middles = np.concatenate([(cuts[:-1] + cuts[1:]) / 2, [cuts[-1] + 1e-6]]) if len(cuts) > 1 else cuts
    pos, neg = np.sort(top[label]), np.sort(top[~label])
    errors = np.searchsorted(pos, middles) + (len(neg) - np.searchsorted(neg, middles))
    best = middles[np.flatnonzero(errors == errors.min())]
    cut = float(np.median(best))
    spread = max(1e-3, float(np.median(pos) - np.median(neg)))
    slope = 8.0 / spread
    return ToxicityModel(table, model.bias, slope, -slope * cut)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Fit on at most about ``max_docs`` labelled documents, chosen by hash of the id.

    ``labels`` holds doc_id and toxic (0 or 1); documents with contradicting
    or null labels are left out.  The sample's distinct words by sentence, not
    its texts, come to the driver.
    """
    prepare(docs.sparkSession)
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).filter("lo = hi")
             .select("doc_id", (F.col("lo") > 0).alias("__toxic")))
    n = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for kind in (True, False):
        part = hash_sample(known.filter(F.col("__toxic") == kind), "doc_id",
                           sample_share(max_docs // 2, n.get(kind, 0)))
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__t")).join(
        F.broadcast(picked), "doc_id")          # bounded by max_docs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, toxic in zip(b["doc_id"], b["__t"], b["__toxic"], strict=True):
                seen: set[str] = set()
                sentences = []
                for s in _SENTENCE.split(t or ""):
                    words = set(_pieces([bare(w) for w in sentence_words(s)])[0]) - seen
                    seen |= words
                    sentences.append(sorted(w for w in words if len(w) > 2))
                rows.append((i, bool(toxic), [" ".join(s) for s in sentences if s]))
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "sentences"])

    rows = sample.mapInPandas(run, "doc_id long, toxic boolean, sentences array<string>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["sentences"]))
    return fit([(r["toxic"], [s.split(" ") for s in r["sentences"]]) for r in rows])


class Scorer:
    """Scores texts, keeping the margins of the words it has met."""

    def __init__(self, model: ToxicityModel, cache_words: int = CACHE_WORDS):
        self.model, self.cache_words = model, cache_words
        self.known: dict[str, float] = {}

    def margins(self, texts: Iterable[str | None]) -> np.ndarray:
        if len(self.known) > self.cache_words:
            self.known = {}
        found = [sentence_words(t) if t else set() for t in texts]
        new = set().union(*found) - self.known.keys()
        if new:
            raw = list(new)
            core = [bare(w) for w in raw]
            joined = [w if w.isalnum() else _INNER.sub("", w) for w in core]     # i-d-i-o-t
            once = list({*core, *joined})
            value = dict(zip(once, self.model.margins(once).tolist(), strict=True))
            self.known.update((w, max(value[a], value[b])) for w, a, b in zip(raw, core, joined, strict=True))
        get = self.known.__getitem__
        return np.array([max(map(get, words), default=FLOOR) for words in found])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: more likely toxic) for every row of ``docs``.

    The whole text is scored.  Null, empty and wordless texts get the score of
    a text without any marked word; null ids and repeated rows keep their
    rows; an empty table gives none; other columns are not read.  No shuffle.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            p = model.probability(scorer.margins(b["__t"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": p})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__t"))
    return src.mapInPandas(run, "doc_id long, score double")


def train_labels(labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Labels outside the held-out fold of crc32(doc_id as text)."""
    return labels.filter(fold(F.col("doc_id"), folds) != held)
