"""Exact repeated-substring removal by merging the Burrows-Wheeler transforms of shards.

Texts are read as bytes in shards of a few megabytes.  A shard's texts are cut
at anchors that the bytes themselves choose (the smallest hash of a gram in
every window of grams), so that equal strings are cut alike wherever they
stand, and every string of ``length`` bytes holds an anchor.  The pieces are
the symbols of the shard's suffix array and Burrows-Wheeler transform.

The shards' transforms are merged by refining one interleave: a block holds
the suffixes, of all shards, that share a prefix of h symbols.  One step goes
through each shard's transform, takes the symbol before every suffix of a
block and, by the transform's last-to-first mapping, finds the block of h + 1
symbols in the shard's own order; only the sizes of the blocks are added up
over the shards.  No suffix is compared or sorted again.  Blocks of one suffix
are settled and leave; the others are repeated intervals whose common prefix
grows with h until it passes ``length`` bytes, which proves those bytes
repeated.

Strings that repeat only in part of a piece are settled exactly at the ends of
the proven runs: the bytes around an anchor there are compared with those
around the other anchors of its block (or, for blocks of many suffixes, by
counting each string of ``length`` bytes around them).
"""

from __future__ import annotations

import functools
import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoplane.llm.common import prepare, written

LENGTH = 400
SHARD_BYTES = 2 << 20
PAIRED = 48                     # blocks of at most this many suffixes compare bytes in pairs
_LOOPS = np.uint64(0xFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def sizes(length: int) -> tuple[int, int, int]:
    """(gram, longest loop, window of grams) for strings of ``length`` bytes."""
    gram = max(4, length // 6)
    loop = gram // 2
    return gram, loop, max(1, (length - gram - loop + 1) * 4 // 5)


@functools.cache
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for i, base in enumerate((_BASE, inverse)):
            p = np.full(max(n, SHARD_BYTES + 1), base, dtype=np.uint64)
            p[0] = 1
            np.cumprod(p, out=p)
            _POWERS[i:i + 1] = [p]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two."""
    with np.errstate(over="ignore"):
        x = a * _U(0xC2B2AE3D27D4EB4F) + (b if isinstance(b, np.ndarray) else _U(b)) * _U(0x165667B19E3779F9) + _U(77)
        x ^= x >> _U(29)
        x *= _U(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U(32))


class Cut:
    """Hashes and anchors of a buffer of texts."""

    def __init__(self, data: bytes, ends: np.ndarray, length: int):
        self.length = length
        self.gram, self.loop, self.window = sizes(length)
        self.ends = np.asarray(ends, dtype=np.int64)             # end of each text in the buffer
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        n = len(data)
        self.n = n
        power, self.inverse = _powers(n + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_bytes_table()[np.frombuffer(data, dtype=np.uint8)] * power[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + size] - self.sums[at]) * self.inverse[at]

    def find(self) -> None:
        """Anchors, their gram hashes, the hash of the piece up to the next anchor, and the looping strings."""
        k, w, n = self.gram, self.window, self.n
        self.pos = np.zeros(0, dtype=np.int64)
        self.loops = np.zeros(0, dtype=np.int64)                 # starts of strings without an anchor
        if n < k + w:
            return
        with np.errstate(over="ignore"):
            grams = (self.sums[k:] - self.sums[:n - k + 1]) * self.inverse[:n - k + 1]
            value = (grams * _U(0xD6E8FEB86659FD93)) >> _U(33)
        m = len(grams)
        text_of = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)[:m] if m else None
        stop = self.ends[text_of]                                # end of the text that holds each gram's start
        place = np.arange(m)
        for d in range(1, self.loop + 1):
            same = np.flatnonzero(grams[:m - d] == grams[d:])
            if len(same):
                value[same[same + k + d <= stop[same]]] = _LOOPS
        packed = (value << _U(32)) | place.astype(np.uint64)
        width = 1
        while width * 2 <= w:
            packed = np.minimum(packed[:-width], packed[width:])
            width *= 2
        if width < w:
            packed = np.minimum(packed[:len(packed) - (w - width)], packed[w - width:])
        q = np.flatnonzero(place[:len(packed)] + (w - 1 + k) <= stop[:len(packed)])     # windows inside a text
        low = packed[q]
        fine = (low >> _U(32)) != _LOOPS
        at = (low[fine] & _U(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=bool)
        self.pos = at[new]
        self.grams = grams[self.pos]
        owner = text_of[self.pos]
        self.owner = owner
        follows = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, dtype=np.int64)
        self.pieces = np.zeros(len(self.pos), dtype=np.uint64)    # 0: the text's last anchor
        if len(follows):
            a, b = self.pos[follows], self.pos[follows + 1]
            self.pieces[follows] = mixed(self.hashes(a, b - a), (b - a).astype(np.uint64))
        # strings whose sure windows all loop have no anchor that equal strings must share
        if not fine.all():
            sure = self.length - k - self.loop - w + 2           # windows that lie in a string with all they depend on
            loops = np.zeros(n + 1, dtype=np.int64)
            loops[q[~fine]] = 1
            run = np.cumsum(loops)
            ok = np.flatnonzero(place + self.length <= stop)
            full = run[np.minimum(ok + sure - 1, n)] - np.where(ok > 0, run[np.maximum(ok - 1, 0)], 0)
            self.loops = ok[full >= sure]

    def loop_keys(self) -> np.ndarray:
        return mixed(self.hashes(self.loops, self.length), 5)


def transform(pieces: np.ndarray, chained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, Burrows-Wheeler symbols and last-to-first mapping of chains of symbols.

    ``chained[i]`` says that suffix i goes on with suffix i + 1; a chain's last
    suffix is an end mark of its own, smaller than all symbols.  The symbol
    before a chain's first suffix is the chain's end mark (the mapping then
    leads to the chain's last suffix).  Returns the suffix at each row, the
    dense symbol before it and the row of the suffix one symbol longer.
    """
    n = len(pieces)
    last = np.flatnonzero(~chained)
    symbol = np.empty(n, dtype=np.int64)
    symbol[last] = np.arange(len(last))
    inner = np.flatnonzero(chained)
    symbol[inner] = np.unique(pieces[inner], return_inverse=True)[1] + len(last)
    chain_end = np.empty(n, dtype=np.int64)
    chain_end[:] = last[np.searchsorted(last, np.arange(n))] if n else 0
    rank, step = symbol.copy(), 1
    while n and rank.max() < n - 1 or (n and len(np.unique(rank)) < n):
        on = np.arange(n) + step
        inside = on <= chain_end
        key = (rank + 0) * (n + 1)
        key[inside] += rank[on[inside]] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step *= 2
    rows = np.argsort(rank, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = ~chained[:-1]
    before = np.where(first, symbol[chain_end], np.roll(symbol, 1))[rows] if n else symbol
    lf = np.empty(n, dtype=np.int64)
    lf[np.argsort(before, kind="stable")] = np.arange(n)
    return rows, before, lf


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    start = np.flatnonzero(new)
    return lo[start], hi[np.concatenate([start[1:] - 1, [len(hi) - 1]])]


def _packed(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def _unpacked(text: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text) if text else b""


def _i64(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, dtype=np.int64).tobytes()


def _from(b: bytes | None, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b, dtype=kind) if b else np.zeros(0, dtype=kind)


def _runs(at: np.ndarray) -> bytes:
    """Ascending places as runs of neighbours: starts, then ends (exclusive)."""
    return _i64(np.concatenate(_merged(at, at + 1)))


def _places(runs: bytes | None) -> np.ndarray:
    """The places of :func:`_runs`."""
    lo, hi = _from(runs).reshape(2, -1)
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _counted(shard: int, keys: np.ndarray) -> pd.DataFrame:
    key, n = np.unique(keys.view(np.int64), return_counts=True)
    return pd.DataFrame({"key": key, "shard": np.full(len(key), shard), "n": n.astype(np.int64)})


_KEYS = "key long, shard long, n long"
_SHARDS = ("shard long, ids array<string>, bytes binary, sha array<string>, text binary, pos binary, grams binary, "
           "pieces binary, loops binary, loop_keys binary")
_PARTS = ("shard long, ids array<string>, bytes binary, sha array<string>, which binary, text binary, ends binary, "
          "anchors binary, grams binary, loops binary, live binary, copies binary")


def _repeated(keys: DataFrame, what: str) -> DataFrame:
    """``shard, key, total`` of the keys counted twice or more over all shards."""
    total = F.sum("n").over(Window.partitionBy("key"))
    return written(keys.withColumn("total", total).filter("total > 1").select("shard", "key", "total"), what)


def _shards(docs: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    def cut(rows: list) -> dict:
        data = b"".join(t for _, t in rows)
        lengths = np.array([len(t) for _, t in rows], dtype=np.int64)
        c = Cut(data, np.cumsum(lengths), length)
        c.find()
        some = len(c.pos) > 0
        keys, n = np.unique(c.loop_keys().view(np.int64), return_counts=True)       # a loop has few distinct strings
        return {"ids": [i for i, _ in rows], "bytes": _i64(lengths),
                "sha": [hashlib.sha256(t).hexdigest() for _, t in rows], "text": _packed(data), "pos": _i64(c.pos),
                "grams": c.grams.tobytes() if some else b"", "pieces": c.pieces.tobytes() if some else b"",
                "loops": _runs(c.loops), "loop_keys": _i64(np.concatenate([keys, n]))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for b in batches:
            for i, t in zip(b["doc_id"], b["__t"], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                held.append((i, raw))
                size += len(raw)
                if size >= shard_bytes:
                    yield pd.DataFrame([{"shard": number, **cut(held)}])
                    number, held, size = number + 1, [], 0
        if held:
            yield pd.DataFrame([{"shard": number, **cut(held)}])

    # ids travel as text, so that a null among them does not turn the others into floats
    src = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").alias("__t"))
    return written(src.mapInPandas(run, _SHARDS), "shards")


def _copies(shards: DataFrame, length: int) -> DataFrame:
    """``shard, key, total``: places of texts of ``length`` bytes and more that occur whole more than once.

    ``total`` is 1 for the one place of each such text that stands for all of
    them in the search; every byte of every copy is covered, whatever else
    repeats, so the others need not be searched.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, sizes_of, sha in zip(b["shard"], b["bytes"], b["sha"], strict=True):
                at = np.flatnonzero(_from(sizes_of) >= length)
                if len(at):
                    yield pd.DataFrame({"shard": np.full(len(at), shard), "key": at, "sha": [sha[i] for i in at]})

    texts = shards.select("shard", "bytes", "sha").mapInPandas(run, "shard long, key long, sha string")
    # a text's copies are one row each of three numbers and a hash; a hot one is counted map-side first
    many = texts.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("shard", "key")).alias("one")).filter("n > 1")
    first = (F.col("shard") == F.col("one.shard")) & (F.col("key") == F.col("one.key"))
    return written(texts.join(many, "sha").select("shard", "key", first.cast("long").alias("total")), "copies")


def _searched(pos: np.ndarray, ends: np.ndarray, copies: pd.DataFrame) -> np.ndarray:
    """Which positions of a shard lie in texts that are searched."""
    left_out = copies["key"][copies["total"] == 0].to_numpy(dtype=np.int64)
    return ~np.isin(np.searchsorted(ends, pos, "right"), left_out)


def _gram_keys(shards: DataFrame, copies: DataFrame) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["key", "shard", "n"])
        r = left.iloc[0]
        grams = _from(r["grams"], "<u8")[_searched(_from(r["pos"]), np.cumsum(_from(r["bytes"])), right)]
        keys, n = _from(r["loop_keys"]).reshape(2, -1)
        loops = pd.DataFrame({"key": keys, "shard": np.full(len(keys), r["shard"]), "n": n})
        return pd.concat([_counted(r["shard"], mixed(grams, 3)), loops])

    return shards.select("shard", "bytes", "pos", "grams", "loop_keys").groupBy("shard").cogroup(
        copies.groupBy("shard")).applyInPandas(run, _KEYS)


def _parts(shards: DataFrame, hits: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """Each shard with the texts that may hold a repeat, and the transform of their repeated anchors."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[c.split()[0] for c in _PARTS.split(", ")])
        r = left.iloc[0]
        twice = np.sort(right["key"][right["kind"] == 0].to_numpy(dtype=np.int64))
        places = right[right["kind"] == 1]
        lengths = _from(r["bytes"])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        whole = _unpacked(r["text"])
        pos, grams, pieces = _from(r["pos"]), _from(r["grams"], "<u8"), _from(r["pieces"], "<u8")
        keys = mixed(grams, 3).view(np.int64)
        live = np.isin(keys, twice) & _searched(pos, ends, places)
        owner = np.searchsorted(ends, pos, "right")
        loops = _places(r["loops"])
        loops = loops[_searched(loops, ends, places)]
        looped = np.zeros(0, dtype=np.int64)
        if len(loops):
            c = Cut(whole, ends, length)
            c.loops = loops
            looped = loops[np.isin(c.loop_keys().view(np.int64), twice)]
        which = np.unique(np.concatenate([owner[live], np.searchsorted(ends, looped, "right")]))
        shift = np.zeros(len(lengths), dtype=np.int64)           # from the shard's to the part's offsets
        part_ends = np.cumsum(lengths[which])
        shift[which] = part_ends - lengths[which] - starts[which]
        text = b"".join(whole[starts[i]:ends[i]] for i in which)
        i = np.flatnonzero(live)
        chained = np.zeros(len(i), dtype=bool)
        if len(i) > 1:
            chained[:-1] = (np.diff(i) == 1) & (owner[i[1:]] == owner[i[:-1]])
        a = pos[i] + shift[owner[i]]
        rows, _, lf = transform(pieces[i], chained)
        first = np.ones(len(i), dtype=bool)
        first[1:] = ~chained[:-1]
        end = a + sizes(length)[0]
        goes_on = np.full(len(i), -1, dtype=np.int64)
        goes_on[:-1] = np.where(chained[:-1], a[1:], -1)
        live = {"row": np.arange(len(i)), "a": a[rows], "prev": np.where(first[rows], -1, lf),
                "before": np.roll(pieces[i], 1)[rows], "next": goes_on[rows], "key": keys[i][rows], "end": end[rows]}
        return pd.DataFrame([{"shard": r["shard"], "ids": r["ids"], "bytes": r["bytes"], "sha": r["sha"],
                              "which": _i64(which), "text": _packed(text), "ends": _i64(part_ends), "anchors": _i64(a),
                              "grams": _i64(keys[i]), "loops": _runs(looped + shift[np.searchsorted(ends, looped, "right")]),
                              "live": pickle.dumps(_narrow(live)), "copies": _i64(places["key"].to_numpy(dtype=np.int64))}])

    right = hits.select("shard", "key", F.lit(0).alias("kind")).unionByName(
        copies.select("shard", "key", F.lit(1).alias("kind"), "total"), allowMissingColumns=True)
    out = shards.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(run, _PARTS)
    return written(out, "parts")


def _narrow(live: dict) -> dict:
    """The same rows with positions and row numbers in four bytes where they fit."""
    return {k: v.astype(np.int32) if k not in ("before", "key") and (not len(v) or v.max() < 1 << 31) else v
            for k, v in live.items()}


_LIVE = "shard long, kind int, rows binary"


def _live_keys(live: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, raw in zip(b["shard"], b["rows"], strict=True):
                yield _counted(shard, pickle.loads(raw)["key"])

    return live.mapInPandas(run, _KEYS)


def _step(s: dict, twice: np.ndarray | None, length: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """One refinement of a shard's live rows.

    ``twice`` holds the repeated keys of this depth (None at the start, whose
    blocks are all repeated).  Rows in blocks counted once are settled and
    leave; the others prove their run repeated, and each goes on to the suffix
    one symbol longer, unless that one's own block is settled or its proven run
    is long enough.  Returns the proven runs of ``length`` bytes and more, and
    the rows of the next depth.
    """
    keep = np.arange(len(s["key"])) if twice is None else np.flatnonzero(np.isin(s["key"], twice))
    s = {k: v[keep] for k, v in s.items()}
    far = s["end"].astype(np.int64) - s["a"] >= length
    lo, hi = _merged(s["a"][far].astype(np.int64), s["end"][far].astype(np.int64))
    order = np.argsort(s["row"])
    place = np.searchsorted(s["row"], s["prev"], sorter=order)
    to = order[np.minimum(place, len(order) - 1)] if len(order) else place
    goes = (s["prev"] >= 0) & (s["row"][to] == s["prev"]) if len(order) else np.zeros(0, dtype=bool)
    goes &= s["end"][to].astype(np.int64) < s["next"][to].astype(np.int64) + length if len(order) else goes
    rows, to = np.flatnonzero(goes), to[goes]
    longer = {k: s[k][to] for k in ("row", "a", "prev", "before", "next")}
    longer["key"] = mixed(s["before"][rows], s["key"][rows].view(np.uint64)).view(np.int64)
    longer["end"] = s["end"][rows]
    return lo, hi, longer


def _refined(parts: DataFrame, length: int) -> list[DataFrame]:
    """``shard, rows`` tables of the runs that the refinement of the interleave proves repeated (starts, then ends)."""
    columns = ["shard", "kind", "rows"]

    def settled(shard: int, s: dict, twice: np.ndarray | None) -> list[tuple]:
        lo, hi, longer = _step(s, twice, length)
        out = [(shard, 0, _i64(np.concatenate([lo, hi])))] if len(lo) else []
        return out + ([(shard, 1, pickle.dumps(longer))] if len(longer["key"]) else [])

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [x for shard, raw in zip(b["shard"], b["live"], strict=True)
                    for x in settled(shard, pickle.loads(raw), None)]
            yield pd.DataFrame(rows, columns=columns)

    def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        twice = np.sort(right["key"].to_numpy(dtype=np.int64))
        rows = [x for shard, raw in zip(left["shard"], left["rows"], strict=True)
                for x in settled(shard, pickle.loads(raw), twice)]
        return pd.DataFrame(rows, columns=columns)

    now = written(parts.select("shard", "live").mapInPandas(start, _LIVE), "interleave")
    proven = []
    while True:
        proven.append(now.filter("kind = 0").select("shard", "rows"))
        live = now.filter("kind = 1")
        if live.isEmpty():
            return proven
        hits = _repeated(_live_keys(live.select("shard", "rows")), "blocks")
        now = written(live.groupBy("shard").cogroup(hits.groupBy("shard")).applyInPandas(step, _LIVE), "interleave")


def _around(a: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes around an anchor that strings of ``length`` which hold it can take, within its text."""
    text = np.searchsorted(ends, a, "right")
    start = np.concatenate([[0], ends[:-1]])[text]
    return np.maximum(start, a - (length - gram)), np.minimum(ends[text], a + length)


def _open_keys(parts: DataFrame, proven: DataFrame, length: int) -> DataFrame:
    """``key``: first blocks of the anchors around which proven runs leave a byte open; each shard's once."""
    gram = sizes(length)[0]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = np.zeros(0, dtype=np.int64)
        for x in left.itertuples():
            a, ends = _from(x.anchors), _from(x.ends)
            loops, loops_end = _from(x.loops).reshape(2, -1)
            if not len(a):
                continue
            covered = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
            for raw in right["rows"]:
                lo, hi = _from(raw).reshape(2, -1)
                np.add.at(covered, lo, 1)
                np.add.at(covered, hi, -1)
            np.add.at(covered, loops, 1)
            np.add.at(covered, loops_end - 1 + length, -1)
            holes = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) == 0)])
            lo, hi = _around(a, ends, length, gram)
            keys = np.unique(_from(x.grams)[(holes[hi] > holes[lo]) & (hi - lo >= length)])
        return pd.DataFrame({"key": keys})

    return parts.select("shard", "ends", "anchors", "grams", "loops").groupBy("shard").cogroup(
        proven.groupBy("shard")).applyInPandas(run, "key long")


_FOUND = "kind int, key long, shard long, n long, rows binary, left long, around binary"


def _compared(parts: DataFrame, asked: DataFrame, length: int, paired: int) -> DataFrame:
    """For asked blocks: the bytes around each distinct member (kind 1), or in large blocks every string (kind 2)."""
    gram = sizes(length)[0]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])
        if not len(left) or not len(right):
            return empty
        r = left.iloc[0]
        s, ends, text = {"a": _from(r["anchors"]), "gram": _from(r["grams"])}, _from(r["ends"]), _unpacked(r["text"])
        few = np.sort(right["key"][right["total"] <= paired].to_numpy(dtype=np.int64))
        many = np.sort(right["key"][right["total"] > paired].to_numpy(dtype=np.int64))
        lo, hi = _around(s["a"], ends, length, gram)
        long_enough = hi - lo >= length
        rows: dict[tuple, list[int]] = {}
        for j in np.flatnonzero(np.isin(s["gram"], few) & long_enough):
            rows.setdefault((int(s["gram"][j]), int(s["a"][j] - lo[j]), text[lo[j]:hi[j]]), []).append(int(s["a"][j]))
        out = [(1, g, r["shard"], len(m), _i64(np.array(m)), n, t) for (g, n, t), m in rows.items()]
        frame = pd.DataFrame(out, columns=empty.columns)
        keys = _string_keys(s, ends, text, many, length)[2]
        if len(keys):
            c = _counted(r["shard"], keys)
            frame = pd.concat([frame, pd.DataFrame({"kind": 2, "key": c["key"], "shard": c["shard"], "n": c["n"],
                                                    "rows": None, "left": 0, "around": None})])
        return frame

    out = parts.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(run, _FOUND)
    return written(out, "around")


def _string_keys(s: dict, ends: np.ndarray, text: bytes, grams: np.ndarray,
                 length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, string start, key) of every string of ``length`` bytes around the anchors of the given blocks."""
    j = np.flatnonzero(np.isin(s["gram"], grams))
    none = np.zeros(0, dtype=np.int64)
    if not len(j):
        return none, none, np.zeros(0, dtype=np.uint64)
    lo, hi = _around(s["a"][j], ends, length, sizes(length)[0])
    count = np.maximum(hi - lo - length + 1, 0)
    at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    anchor = np.repeat(s["a"][j], count)
    at = np.unique(at)                                            # a string around several anchors counts once
    c = Cut(text, ends, length)
    return anchor, at, mixed(c.hashes(at, length), 9)


def common(a: bytes, b: bytes, left_a: int, left_b: int) -> tuple[int, int]:
    """How far two surroundings of one gram agree to the left and to the right of its start."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    n = min(left_a, left_b)
    d = np.flatnonzero(x[left_a - n:left_a][::-1] != y[left_b - n:left_b][::-1])
    left = int(d[0]) if len(d) else n
    n = min(len(x) - left_a, len(y) - left_b)
    d = np.flatnonzero(x[left_a:left_a + n] != y[left_b:left_b + n])
    return left, int(d[0]) if len(d) else n


_EXTENT = "shard long, kind int, key long, rows binary, l long, r long"


def _extents(found: DataFrame, length: int) -> DataFrame:
    """How far around its members each surrounding repeats (strings of at least ``length`` bytes only)."""
    def settle(block: list) -> list:
        best = [[0, 0] for _ in block]
        for i, x in enumerate(block):
            if x.n > 1:
                best[i] = [x.left, len(x.around) - x.left]
        for i in range(len(block)):
            for j in range(i):
                x, y = block[i], block[j]
                l, r = common(x.around, y.around, x.left, y.left)
                if l + r >= length:
                    for k in (i, j):
                        best[k] = [max(best[k][0], l), max(best[k][1], r)]
        return [(x.shard, 1, x.key, x.rows, *b) for x, b in zip(block, best, strict=True) if sum(b) >= length]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list = []
        for b in batches:
            out = []
            for x in b.itertuples():
                if block and block[0].key != x.key:
                    out += settle(block)
                    block = []
                block.append(x)
            yield pd.DataFrame(out, columns=["shard", "kind", "key", "rows", "l", "r"])
        if block:
            yield pd.DataFrame(settle(block), columns=["shard", "kind", "key", "rows", "l", "r"])

    # a block has at most PAIRED rows, so the partitions are even
    small = found.filter("kind = 1").repartition("key").sortWithinPartitions("key")
    return small.mapInPandas(run, _EXTENT)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _removed(parts: DataFrame, results: DataFrame, length: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        if not len(left):
            return pd.DataFrame(columns=columns)
        r = left.iloc[0]
        s, ends, text = {"a": _from(r["anchors"]), "gram": _from(r["grams"])}, _from(r["ends"]), _unpacked(r["text"])
        loops, loops_end = _from(r["loops"]).reshape(2, -1)
        # runs that the merge proved, looping strings, and the ends of runs
        proven = right[right["kind"] == 0]
        lo, hi = [loops], [loops_end - 1 + length]
        for raw in proven["rows"]:
            a, e = _from(raw).reshape(2, -1)
            lo.append(a)
            hi.append(e)
        for x in right[right["kind"] == 1].itertuples():
            a = _from(x.rows)
            lo.append(a - x.l)
            hi.append(a + x.r)
        twice = np.sort(right["key"][right["kind"] == 2].to_numpy(dtype=np.int64))
        if len(twice):
            many = right["key"][right["kind"] == 3].to_numpy(dtype=np.int64)
            _, at, keys = _string_keys(s, ends, text, many, length)
            at = at[np.isin(keys.view(np.int64), twice)]
            lo.append(at)
            hi.append(at + length)
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        owner = np.searchsorted(ends, lo, "right")
        lengths = _from(r["bytes"])
        out = [(i, int(n), 0, 0, h, []) for i, n, h in zip(r["ids"], lengths, r["sha"], strict=True)]
        which = _from(r["which"])
        nothing = hashlib.sha256(b"").hexdigest()
        for k in _from(r["copies"]):
            n = int(lengths[k])
            out[k] = (r["ids"][k], n, n, 1, nothing, [{"start": 0, "end": n}])
        settled = set(_from(r["copies"]).tolist())
        for t in np.unique(owner):
            if int(which[t]) in settled:
                continue
            a, b = _merged(lo[owner == t], hi[owner == t])
            start, end = int(ends[t - 1]) if t else 0, int(ends[t])
            edge = np.concatenate([[start], np.ravel(np.column_stack([a, b])), [end]])
            kept = b"".join(text[edge[i]:edge[i + 1]] for i in range(0, len(edge), 2))
            k = int(which[t])
            out[k] = (r["ids"][k], end - start, int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(),
                      [{"start": int(x - start), "end": int(y - start)} for x, y in zip(a, b, strict=True)])
        frame = pd.DataFrame(out, columns=columns)
        frame["doc_id"] = pd.array([None if i is None else int(i) for i in frame["doc_id"]], dtype="Int64")
        return frame

    return parts.groupBy("shard").cogroup(results.groupBy("shard")).applyInPandas(run, _RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                   paired: int = PAIRED) -> DataFrame:
    """One row per row of ``docs``: which bytes a string of ``length`` bytes covers that also starts elsewhere.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (of the bytes that stay), spans (start, end in bytes).
    Elsewhere is any other place of any text, the same text included; strings
    never cross texts and overlap freely.

    Null and empty texts have no byte and keep their rows, as do null ids and
    repeated rows (copies of one another, and so removed when long enough); an
    empty table gives no rows; other columns are not read.  Runs and strings
    are compared by 64-bit hashes where they are only counted (n of them agree
    by chance with probability below n^2 / 2^65).
    """
    if length < 16:
        raise ValueError("strings of at least 16 bytes")
    prepare(docs.sparkSession)
    shards = _shards(docs, length, shard_bytes)
    copies = _copies(shards, length)
    hits = _repeated(_gram_keys(shards, copies), "grams")
    parts = _parts(shards, hits.select("shard", "key"), copies, length)
    proven = functools.reduce(DataFrame.unionByName, _refined(parts, length))
    open_keys = _open_keys(parts, proven, length).distinct()
    asked = written(hits.join(open_keys, "key", "left_semi"), "asked")
    found = _compared(parts.select("shard", "text", "ends", "anchors", "grams"), asked, length, paired)
    counted = _repeated(found.filter("kind = 2").select("key", "shard", "n"), "strings")
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    results = (_extents(found, length)
               .unionByName(proven.select("shard", F.lit(0).alias("kind"), zero.alias("key"), "rows",
                                          zero.alias("l"), zero.alias("r")))
               .unionByName(counted.select("shard", F.lit(2).alias("kind"), "key", none.alias("rows"),
                                           zero.alias("l"), zero.alias("r")))
               .unionByName(asked.filter(F.col("total") > paired).select(
                   "shard", F.lit(3).alias("kind"), "key", none.alias("rows"), zero.alias("l"), zero.alias("r"))))
    return _removed(parts.drop("live"), results, length)
