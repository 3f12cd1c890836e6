"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier over hashed character
n-grams predicts each bit.  Loss-weighted decoding sums, for each codeword, the
logistic loss of the predicted margins against its bits, weighted by how well
each bit's classifier does, and takes the nearest codeword.  A text whose
second codeword is nearly as near is flagged as ambiguous.
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

from geoplane.llm.common import code_points, fold, prepare

UNDETERMINED = "und"
BUCKETS = 4096          # hashed n-grams of 1 to 3 characters
TRAIN_DOCS = 3000       # bound of the training sample, shared by the languages
MIN_GAP = 0.05          # ambiguity: loss gap of the two nearest codewords over the weights' sum
CHUNK = 1 << 18         # code points hashed at once


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool,
                       count=sys.maxunicode + 1)


def _count(chars: np.ndarray, rows: np.ndarray, n_rows: int, buckets: int, lead: int = 0) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of each row; grams do not cross rows or start at a gap.

    Grams that end in the first ``lead`` characters were counted before.
    """
    out = np.zeros(n_rows * buckets, dtype=np.float64)
    h = chars.astype(np.uint64)
    base = rows * buckets
    for order in (1, 2, 3):
        if order > 1:
            if len(chars) < order:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[order - 1:].astype(np.uint64)
        inside = (rows[:len(h)] == rows[order - 1:]) & ((chars[:len(h)] != 0) | (order > 1))
        inside[:max(lead - order + 1, 0)] = False
        slot = ((h + np.uint64(order)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - buckets.bit_length() + 1)
        out += np.bincount((base[:len(h)] + slot.astype(np.int64))[inside], minlength=n_rows * buckets)
    return out.reshape(n_rows, buckets)


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Row-normalised square-root counts of each whole text, and whether it has a letter.

    ``buckets`` is a power of two.  Non-letters become one gap symbol; a very
    long text is counted in chunks that overlap by two characters, every n-gram once.
    """
    lowered = [(t or "").lower() for t in texts]
    x = np.zeros((len(texts), buckets), dtype=np.float32)
    has = np.zeros(len(texts), dtype=bool)
    at = 0
    while at < len(lowered):
        end, size = at, 0
        while end < len(lowered) and (end == at or (size + len(lowered[end]) <= CHUNK and end - at < 128)):
            size += len(lowered[end])
            end += 1
        chars, ends = code_points(lowered[at:end])
        letter = _letters()[chars]
        chars = np.where(letter, chars, 0)
        rows = np.repeat(np.arange(end - at), np.diff(ends))
        counts = np.zeros((end - at, buckets))
        for lo in range(0, max(1, len(chars)), CHUNK):
            lead = min(lo, 2)
            counts += _count(chars[lo - lead:lo + CHUNK], rows[lo - lead:lo + CHUNK], end - at, buckets, lead)
        total = counts.sum(axis=1, keepdims=True)
        x[at:end] = np.sqrt(counts / np.maximum(total, 1))
        has[at:end] = np.bincount(rows[letter], minlength=end - at) > 0
        at = end
    return x, has


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 bits for each of ``n`` classes.

    Up to seven classes take the exhaustive code (every split into two
    non-empty sides, 2^(n-1) - 1 bits, minimum distance 2^(n-2)); more take
    random balanced columns without repeats or complements, 12 log2(n) of them.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 2 ** (n - 1))
        bits = np.vstack([np.zeros(len(splits), dtype=int)]
                         + [(splits >> i) & 1 for i in range(n - 1)])
        return np.where(bits == 0, 1.0, -1.0)
    rng, cols = np.random.default_rng(5), {}
    while len(cols) < int(np.ceil(12 * np.log2(n))):
        c = np.ones(n)
        c[rng.permutation(n)[: n // 2]] = -1
        cols.setdefault(tuple(c * c[0]), c * c[0])
    return np.column_stack(list(cols.values()))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray        # languages x bits
    weights: np.ndarray     # buckets x bits
    bias: np.ndarray
    bit_weight: np.ndarray
    min_gap: float = MIN_GAP

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its probability, the second nearest, and whether the two are too close."""
        if not self.languages:
            z = np.zeros(len(x), dtype=int)
            return z, np.zeros(len(x)), z, np.zeros(len(x), dtype=bool)
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -4.0 * margin * c) * self.bit_weight).sum(axis=1)
                         for c in self.code], axis=1)
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p = e / e.sum(axis=1, keepdims=True)
        order = np.argsort(loss, axis=1, kind="stable")
        best, second = order[:, 0], order[:, min(1, loss.shape[1] - 1)]
        r = np.arange(len(x))
        gap = (loss[r, second] - loss[r, best]) / self.bit_weight.sum()
        return best, p[r, best], second, (gap < self.min_gap) & (best != second)


def fit(x: np.ndarray, lang: np.ndarray, ridge: float = 0.01, min_gap: float = MIN_GAP) -> LanguageModel:
    """One ridge-regularised linear classifier a bit, and each bit's weight from its training error."""
    names = tuple(sorted(set(lang)))
    code = codewords(len(names))
    if not names:
        return LanguageModel((), code, np.zeros((x.shape[1], 1)), np.zeros(1), np.ones(1), min_gap)
    y = code[np.searchsorted(np.array(names, dtype=object), lang)]
    per_class = {n: (lang == n).sum() for n in names}
    w = np.array([1.0 / per_class[v] for v in lang])
    w = np.sqrt(w / w.sum())[:, None]                       # languages weigh alike
    a = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64) * w
    gram = a @ a.T + ridge / len(a) * np.eye(len(a))        # dual form: rows <= TRAIN_DOCS
    beta = a.T @ np.linalg.solve(gram, y * w)
    margin = x @ beta[:-1] + beta[-1]
    wrong = np.clip((w * w * (margin * y < 0)).sum(axis=0), 1e-3, 0.49)
    return LanguageModel(names, code, beta[:-1], beta[-1], np.log((1 - wrong) / wrong) / 2, min_gap)


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, buckets: int = BUCKETS,
          lang_col: str = "lang") -> LanguageModel:
    """Fit on at most about ``max_docs`` rows with a language, chosen by hash of the id, the languages alike.

    The sample's features, not its texts, come to the driver (two bytes a bucket).
    """
    prepare(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__t"),
                        F.col(lang_col).cast("string").alias("__lang")).filter(
        "__lang is not null and __t is not null and doc_id is not null")
    counts = {r["__lang"]: r["n"] for r in named.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, buckets), dtype=np.float32), np.array([], dtype=object))
    each = max(1, max_docs // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items())
                           for v in (lang, int(min(1.0, each / n) * (1 << 31)))])
    sample = named.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 31)) < share[F.col("__lang")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, has = features(list(b["__t"]), buckets)
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["__lang"],
                                "x": [v.astype(np.float16).tobytes() for v in x]})[has]

    rows = sample.mapInPandas(run, "doc_id long, lang string, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["x"]))
    x = np.array([np.frombuffer(r["x"], dtype=np.float16) for r in rows], dtype=np.float32).reshape(-1, buckets)
    return fit(x, np.array([r["lang"] for r in rows], dtype=object))


def predict(docs: DataFrame, model: LanguageModel, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, lang_pred, score, lang_second, ambiguous`` for every row of ``docs``.

    ``und`` with score 0 when the text is null or has no letter, or the model
    knows no language.  Null ids and repeated rows keep their rows, an empty
    table gives none, ties go to the first language by name, other columns
    are not read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield labelled(b["doc_id"], list(b["__t"]), model, buckets)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__t"))
    return src.mapInPandas(
        run, "doc_id long, lang_pred string, score double, lang_second string, ambiguous boolean")


def labelled(ids: pd.Series, texts: list[str | None], model: LanguageModel, buckets: int) -> pd.DataFrame:
    x, has = features(texts, buckets)
    best, p, second, close = model.decode(x)
    known = has & bool(model.languages)
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    return pd.DataFrame({
        "doc_id": ids, "lang_pred": np.where(known, names[best], UNDETERMINED),
        "score": np.where(known, p, 0.0), "lang_second": np.where(known, names[second], None),
        "ambiguous": known & close})


def identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5,
               buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` whose language is told: not ``und``, and not both ambiguous and below ``min_score``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = labelled(b["doc_id"], list(b["text"]), model, buckets)
            known = (found["lang_pred"] != UNDETERMINED).to_numpy()
            doubtful = (found["ambiguous"] & (found["score"] < min_score)).to_numpy()
            yield b[known & ~doubtful]

    return docs.mapInPandas(run, docs.schema)


def train_rows(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Rows outside the held-out fold of crc32(doc_id as text)."""
    return docs.filter(fold(F.col("doc_id"), folds) != held)
