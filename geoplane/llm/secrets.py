"""Secret scans: fixed credential patterns plus sliding-window Shannon entropy.

The base kinds are regular expressions.  The entropy kind looks at candidate
strings (unbroken runs of token characters).  For each character class a
window of fixed length slides over the runs of that class; the window's
Shannon entropy is kept up to date by incremental counts (one character
enters, one leaves), and windows at or above the class's threshold mark the
run's high-entropy stretch as a span.  Allow-listed candidates are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoplane.llm.common import prepare

# Fixed values of the result's contract.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

# A run of 32 hex digits holds every match of HEX that is long enough.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """A character class, its window length and the entropy (bits a character) that marks a window."""

    name: str
    chars: str
    window: int
    bits: float


HEX_CLASS = CharClass("hex", "0123456789abcdefABCDEF", 20, 2.9)
BASE64_CLASS = CharClass(
    "base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.9)

# Candidates that look random but are not secrets.
ALLOW = (
    r"0123456789abcdef",                                   # a written-out alphabet
    r"abcdefghijklmnop",
    r"ABCDEFGHIJKLMNOP",
    r"EXAMPLE",                                            # documentation keys
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",   # UUIDs
    r"^(?:[A-Za-z]+|[0-9]+)(?:[-_/=+](?:[A-Za-z]+|[0-9]+))*$",             # words, numbers and paths of them
)


@dataclass(frozen=True)
class EntropyRules:
    classes: tuple[CharClass, ...] = (HEX_CLASS, BASE64_CLASS)
    allow: tuple[str, ...] = ALLOW
    _allow: list = field(default_factory=list, compare=False, repr=False)

    def allowed(self, candidate: str) -> bool:
        if not self._allow and self.allow:
            self._allow.append(re.compile("|".join(f"(?:{a})" for a in self.allow)))
        return bool(self._allow and self._allow[0].search(candidate))


def window_entropies(s: str, n: int) -> Iterator[float]:
    """Shannon entropy of each length-``n`` window of ``s``; O(1) work a step.

    With counts c, H = log2(n) - sum(c log2 c) / n, so that a step only
    replaces the terms of the character that enters and the one that leaves.
    """
    if n < 1 or len(s) < n:
        return
    term = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    counts: Counter[str] = Counter(s[:n])
    total = sum(term[c] for c in counts.values())
    yield math.log2(n) - total / n
    for i in range(n, len(s)):
        new, old = s[i], s[i - n]
        if new != old:
            total += term[counts[new] + 1] - term[counts[new]]
            counts[new] += 1
            total += term[counts[old] - 1] - term[counts[old]]
            counts[old] -= 1
        yield math.log2(n) - total / n


def entropy_spans(text: str, rules: EntropyRules) -> list[tuple[int, int]]:
    """Maximal high-entropy stretches of the candidates of ``text`` (start, end), merged over the classes."""
    out: list[tuple[int, int]] = []
    for cand in _CANDIDATE.finditer(text):
        word = cand.group()
        if not any(c.isdigit() for c in word) or rules.allowed(word):
            continue
        marked: list[tuple[int, int]] = []
        for cls in rules.classes:
            for run in re.finditer(f"[{re.escape(cls.chars)}]{{{cls.window},}}", word):
                for i, h in enumerate(window_entropies(run.group(), cls.window)):
                    if h >= cls.bits:
                        lo = cand.start() + run.start() + i
                        if marked and marked[-1][0] <= lo <= marked[-1][1]:
                            marked[-1] = (marked[-1][0], max(marked[-1][1], lo + cls.window))
                        else:
                            marked.append((lo, lo + cls.window))
        for lo, hi in sorted(marked):
            if out and lo <= out[-1][1] and out[-1][0] >= cand.start():
                out[-1] = (out[-1][0], max(out[-1][1], hi))
            else:
                out.append((lo, hi))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed kinds, leftmost and non-overlapping within a kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LENGTH]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return out


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered(spans))


def find_spans(text: str | None, rules: EntropyRules) -> tuple[list, list]:
    """(base spans, all spans) of one text; null reads as empty."""
    text = text or ""
    base = ordered(base_spans(text))
    return base, ordered(base + [(a, b, "entropy") for a, b in entropy_spans(text, rules)])


def redacted(text: str | None, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str | None:
    """``text`` with every stretch covered by spans replaced by one ``mask``."""
    if text is None or not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


_SCHEMA = ("doc_id long, spans array<struct<start:int,end:int,kind:string>>, "
           "n_assign long, n_access long, n_hex long, base_sha256 string, span_list string")


def scan_secrets(docs: DataFrame, rules: EntropyRules | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: every span found in the whole text, and digests of them.

    Columns: doc_id, spans (array of start, end, kind in code points, end
    exclusive), n_assign, n_access, n_hex, base_sha256, span_list.  Null and
    empty texts have no span, null ids and repeated rows keep their rows, an
    empty table gives none, other columns are not read.  Spans of one kind do
    not overlap; spans of different kinds may, and are ordered by start, then
    kind.  No shuffle: each row is scanned where it is read.
    """
    prepare(docs.sparkSession)
    rules = rules or EntropyRules()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["__t"], strict=True):
                base, every = find_spans(t, rules)
                n = Counter(k for _, _, k in base)
                rows.append((i, [{"start": a, "end": e, "kind": k} for a, e, k in every],
                             n["assign"], n["access"], n["hex"],
                             hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(every)))
            out = pd.DataFrame(rows, columns=["doc_id", "spans", "n_assign", "n_access", "n_hex",
                                              "base_sha256", "span_list"])
            out["doc_id"] = b["doc_id"].to_numpy()
            yield out

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__t"))
    return src.mapInPandas(run, _SCHEMA)


def redact_secrets(docs: DataFrame, rules: EntropyRules | None = None, text_col: str = "text",
                   mask: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; all other columns and all rows stay as they are.

    ``length_col``, where given and not null, gets the code points of texts that changed.
    """
    prepare(docs.sparkSession)
    rules = rules or EntropyRules()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [redacted(t, find_spans(t, rules)[1], mask) for t in b[text_col]]
            if length_col:
                b[length_col] = [n if t == old or pd.isna(n) else len(t)
                                 for n, t, old in zip(b[length_col], texts, b[text_col], strict=True)]
            b[text_col] = texts
            yield b

    return docs.mapInPandas(run, docs.schema)
