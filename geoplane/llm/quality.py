"""Quality scores by positive-unlabelled learning.

The classifier sees trusted positives (documents labelled good) and unlabelled
web text, never negatives.  With the class prior p of good text among the
unlabelled, the risk of calling bad is estimated from unlabelled text minus
p times the positives; a flexible model can push that estimate below zero, so
it is clipped there (the non-negative unbiased risk) and minimised by gradient
steps.  The prior is estimated from the same two samples.

Features describe the form of a text, not its words: counts of one, two and
three neighbouring character classes, and how much its words repeat.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoplane.llm.common import code_points, fold, hash_sample, prepare, sample_share

CLASSES = 12
TRAIN_POSITIVES = 2500      # bounds of the two training samples
TRAIN_UNLABELLED = 5000
CHUNK = 1 << 18             # code points counted at once
_MARKS = {".": 5, ",": 6, "|": 7, "!": 8}
_WORD_STATS = 6
WIDTH = CLASSES + CLASSES ** 2 + CLASSES ** 3 + _WORD_STATS


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 lower, 1 upper, 2 other letter, 3 digit, 4 space, 5 to 8 marks,
    9 line end, 10 other ASCII sign, 11 the rest."""
    out = np.full(sys.maxunicode + 1, 11, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch in _MARKS:
            out[c] = _MARKS[ch]
        elif ch.isalpha():
            out[c] = 0 if ch.islower() else 1 if ch.isupper() else 2
        elif ch.isdigit():
            out[c] = 3
        elif ch in "\n\r":
            out[c] = 9
        elif ch.isspace():
            out[c] = 4
        elif c < 128:
            out[c] = 10
    return out


def word_statistics(text: str) -> list[float]:
    """Length, distinct share of words, the commonest word's share, mean word length, repeated lines, wordlessness."""
    words = text.split()
    if not words:
        return [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    distinct = set(words)
    # the share of neighbouring equal words stands for the commonest word in looping text
    loops = sum(map(str.__eq__, words, words[1:])) / len(words)
    lines = [x for x in text.split("\n") if x]
    twice = 1 - len(set(lines)) / len(lines)
    return [min(np.log1p(len(words)) / 10, 1.5), len(distinct) / len(words), loops,
            min(len(text) / len(words), 30) / 30, twice, 0.0]


def features(texts: list[str | None]) -> np.ndarray:
    """One row a text: square roots of class n-gram shares and word statistics of the whole text."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    sizes = (CLASSES, CLASSES ** 2, CLASSES ** 3)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or (size + len(texts[end] or "") <= CHUNK and end - at < 128)):
            size += len(texts[end] or "")
            end += 1
        n = end - at
        chars, ends = code_points([t or "" for t in texts[at:end]])
        cls = _classes()[chars].astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(ends))
        gram, col = np.zeros(len(cls), dtype=np.int64), 0
        for order, width in enumerate(sizes, 1):
            if len(cls) < order:
                break
            gram = gram[:len(cls) - order + 1] * CLASSES + cls[order - 1:]
            inside = row[:len(gram)] == row[order - 1:]
            counts = np.bincount((row[:len(gram)] * width + gram)[inside], minlength=n * width).reshape(n, width)
            total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
            out[at:end, col:col + width] = np.sqrt(counts / total)
            col += width
        at = end
    out[:, -_WORD_STATS:] = [word_statistics(t or "") for t in texts] if texts else 0
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_pu_risk(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of positives called bad, negative-class estimate before clipping) of margins, logistic loss."""
    r_pos = prior * np.logaddexp(0, -pos).mean()
    r_neg = np.logaddexp(0, unl).mean() - prior * np.logaddexp(0, pos).mean()
    return float(r_pos), float(r_neg)


def _minimise(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, reg: float,
              rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam steps on the non-negative risk; where the clipped part is negative its gradient is reversed."""
    d = xp.shape[1]
    w, m, v = (np.zeros(d + 1, dtype=np.float32) for _ in range(3))

    def sig(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for t in range(1, steps + 1):
        zp, zu = xp @ w[:d] + w[d], xu @ w[:d] + w[d]
        _, r_neg = nn_pu_risk(zp, zu, prior)
        gp, gu = sig(zp), sig(zu)
        if r_neg >= 0:
            cp = prior * (gp - 1) / len(zp) - prior * gp / len(zp)
            cu = gu / len(zu)
        else:                                      # step back from an over-fitted negative part
            cp = prior * gp / len(zp)
            cu = -gu / len(zu)
        g = np.concatenate([cp @ xp + cu @ xu + reg * w[:d], [cp.sum() + cu.sum()]]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:d], float(w[d])


def estimate_prior(xp: np.ndarray, xu: np.ndarray, steps: int = 150) -> float:
    """Share of good text among the unlabelled.

    A classifier tells positives from unlabelled text on one half of each
    sample; on the other half, the fewest unlabelled texts a positive that
    scores above a cut stands for, over the cuts, bounds the share.
    """
    if len(xp) < 4 or len(xu) < 4:
        return 0.5
    a, b = xp[::2], xp[1::2]
    c, d = xu[::2], xu[1::2]
    # ordinary logistic regression of "positive" against "unlabelled": prior 1/2, nothing subtracted
    x = np.vstack([a, c])
    y = np.concatenate([np.ones(len(a)), np.zeros(len(c))])
    weight = np.concatenate([np.full(len(a), 0.5 / len(a)), np.full(len(c), 0.5 / len(c))]).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1] + 1, dtype=np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        z = np.clip(x @ w[:-1] + w[-1], -30, 30)
        r = (weight * (1 / (1 + np.exp(-z)) - y)).astype(np.float32)
        g = np.concatenate([r @ x + 1e-3 * w[:-1], [r.sum()]]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.02 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    sp, su = np.sort(b @ w[:-1]), np.sort(d @ w[:-1])
    cuts = np.quantile(sp, np.linspace(0.0, 0.8, 33))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    ratio = above_u / np.maximum(above_p, 1e-9)
    return float(np.clip(ratio.min(), 0.05, 0.99))


def fit(xp: np.ndarray, xu: np.ndarray, steps: int = 400, reg: float = 1e-3,
        prior: float | None = None) -> QualityModel:
    """Train on positive and unlabelled feature rows; without positives every text scores the prior of one half."""
    both = np.vstack([xp, xu])
    mean = both.mean(axis=0) if len(both) else np.zeros(WIDTH, dtype=np.float32)
    scale = np.maximum(both.std(axis=0) if len(both) else np.ones(WIDTH, dtype=np.float32), np.float32(0.02))
    weights = np.zeros(WIDTH, dtype=np.float32)
    if not len(xp) or not len(xu):
        return QualityModel(mean, scale, weights, 0.0, 0.5)
    live = np.flatnonzero((both != 0).sum(axis=0) >= 5)          # n-grams that the samples hold at all
    zp, zu = (((x[:, live] - mean[live]) / scale[live]).astype(np.float32) for x in (xp, xu))
    prior = estimate_prior(zp, zu) if prior is None else prior
    weights[live], b = _minimise(zp, zu, prior, steps, reg)
    return QualityModel(mean, scale, weights, b, prior)


def train(docs: DataFrame, labels: DataFrame, positives: int = TRAIN_POSITIVES,
          unlabelled: int = TRAIN_UNLABELLED) -> QualityModel:
    """Fit on bounded samples chosen by hash of the id.

    ``labels`` holds doc_id and quality; rows of quality 1 are the trusted
    positives (ids that are also labelled 0 are left out).  The unlabelled
    sample comes from all of ``docs``, whatever their labels.  Features, not
    texts, come to the driver.
    """
    prepare(docs.sparkSession)
    good = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("lo")).filter("lo = 1").select("doc_id"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = features(list(b["__t"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [r.astype(np.float16).tobytes() for r in x]})

    def rows(part: DataFrame) -> np.ndarray:
        found = part.mapInPandas(run, "doc_id long, x binary").collect()
        found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["x"]))
        return np.array([np.frombuffer(r["x"], dtype=np.float16) for r in found],
                        dtype=np.float32).reshape(-1, WIDTH)

    picked = hash_sample(good, "doc_id", sample_share(positives, good.count()), seed=13)
    xp = rows(src.join(F.broadcast(picked), "doc_id"))            # bounded by ``positives``
    xu = rows(hash_sample(src, "doc_id", sample_share(unlabelled, src.count()), seed=17))
    return fit(xp, xu)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: more likely good) for every row of ``docs``.

    The whole text is scored; null reads as empty, and an empty text scores
    like any other feature row.  Null ids and repeated rows keep their rows, an
    empty table gives none, other columns are not read.  No shuffle.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.probability(features(list(b["__t"])))})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__t"))
    return src.mapInPandas(run, "doc_id long, score double")


def train_labels(labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Labels outside the held-out fold of crc32(doc_id as text)."""
    return labels.filter(fold(F.col("doc_id"), folds) != held)
