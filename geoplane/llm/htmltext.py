"""Main text of web pages: markup structure plus a suffix array over each host's token streams.

A page is read into blocks of text.  Elements that never hold article text
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) are left out by their tags, roles and class names.  The token
streams of a host's pages are concatenated, and the suffix array (by prefix
doubling) finds the substrings of at least RUN tokens that several distinct
pages repeat.  Blocks that such runs cover are the host's boilerplate: they go
unless they stand in the page's article, where only covered link lists go;
blocks made of unique runs stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoplane.llm.common import prepare

RUN = 8                       # tokens of a repeated substring
MIN_PAGES = 3                 # distinct pages that repeat it
COVERED = 0.5                 # a block of which repeated runs cover more than this share is boilerplate
PART_BYTES = 4 << 20          # html of one host in one task

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol optgroup option p "
    "pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
_NEVER = frozenset(
    "script style head title noscript template nav footer aside form button select textarea option svg math "
    "iframe object canvas audio video map dialog menu datalist".split())
_NEVER_ROLE = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_NEVER_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription "
    "signup paywall sidebar widget widgets related recommended recommendations share sharing social breadcrumb "
    "breadcrumbs menu nav navbar navigation navigate pagination pager footer masthead topbar toolbar comment comments "
    "commentlist disqus reply replies respond login skip skiplink".split())
_NEVER_OUTSIDE = frozenset("header banner head top hero".split())       # site headers; inside an article they hold its title
_MAIN = frozenset(("article", "main"))
_NAME = re.compile(r"[a-z]+")
_CLOSES_P = _BLOCK - {"option", "optgroup", "body", "html", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}


@dataclass
class Block:
    text: str
    never: bool                 # in an element that holds no article text
    main: bool                  # inside the article
    link: int                   # characters that are link text
    tokens: list = field(default_factory=list)


class _Reader(HTMLParser):
    """Collects blocks; tolerates unclosed and stray tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool, bool, bool]] = []      # tag, never, main, link, skip
        self.parts: list[str] = []
        self.linked = 0

    def _state(self) -> tuple[bool, bool, bool]:
        return self.open[-1][1:4] if self.open else (False, False, False)

    def _skips(self) -> bool:
        return bool(self.open) and self.open[-1][4]

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                never, main, _ = self._state()
                self.blocks.append(Block(text, never, main, self.linked))
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK and not self._skips():
            self._flush()
        if tag == "br" or tag == "hr":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag in _CLOSES_P and self.open and any(t[0] == "p" for t in self.open[-4:]):
            self._close("p")
        elif tag in ("li", "option", "tr", "td", "th", "dt", "dd") and self.open and self.open[-1][0] == tag:
            self._close(tag)
        never, main, link = self._state()
        if not never:
            never = tag in _NEVER or (bool(attrs) and self._named(attrs, main))
            if tag == "header" and not main:
                never = True
        main = not never and (main or tag in _MAIN or (bool(attrs) and any(
            k == "role" and v in ("main", "article") for k, v in attrs)))
        # inside a block, an element that never holds text is passed over and the block goes on
        skip = self._skips() or (never and not self._state()[0] and tag not in _BLOCK) or tag in ("script", "style")
        self.open.append((tag, never, main, link or tag == "a", skip))

    @staticmethod
    def _named(attrs: list, main: bool) -> bool:
        for k, v in attrs:
            if not v:
                if k == "hidden":
                    return True
                continue
            if k in ("class", "id"):
                names = set(_NAME.findall(v.lower()))
                if names & _NEVER_NAME or (not main and names & _NEVER_OUTSIDE):
                    return True
            elif k == "role" and v.lower() in _NEVER_ROLE:
                return True
            elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true"):
                return True
            elif k == "style" and "display:none" in v.replace(" ", "").lower():
                return True
        return False

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in _BLOCK:
                    self._flush()
                del self.open[i:]
                return
            if tag not in _BLOCK and self.open[i][0] in _BLOCK:
                return                      # a stray inline end tag does not close blocks
            if tag == "p" and self.open[i][0] in _BLOCK and self.open[i][0] != "p":
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if tag not in _VOID:
            self._close(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("p", "div", "script", "style", "title"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self._skips():
            self.parts.append(" ")
            return
        self.parts.append(data)
        if self.open and self.open[-1][3]:
            self.linked += len(data.strip())


def blocks(html: str | None) -> list[Block]:
    """The text blocks of one page in order, character references decoded and white space made single."""
    if not html:
        return []
    r = _Reader()
    r.feed(html)
    r.close()
    r._flush()
    return r.blocks


def run_classes(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The equal substrings of ``run`` tokens within a page: starts by class, each class's first, its distinct pages.

    ``tokens`` are ids of the concatenated streams (in page order), ``page``
    the page of each.  Prefix doubling ranks every suffix by its first 1, 2,
    4, ... tokens until ``run``; in the suffix array, suffixes of equal rank
    are neighbours with a common prefix of at least ``run`` tokens.
    """
    n = len(tokens)
    none = np.zeros(0, dtype=np.int64)
    if n < run:
        return none, none, none
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < run:
        step = min(length, run - length)
        following = np.zeros(n, dtype=np.int64)
        following[:n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + following
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        length += step
    suffixes = np.flatnonzero(page[:n - run + 1] == page[run - 1:])          # substrings within one page
    order = suffixes[np.argsort(rank[suffixes], kind="stable")]              # equal prefixes stay in page order
    if not len(order):
        return none, none, none
    r, p = rank[order], page[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    new_page = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
    return order, first, np.add.reduceat(new_page.astype(np.int64), first)


def _cover(start: np.ndarray, run: int, n: int) -> np.ndarray:
    """Which of ``n`` tokens the runs at ``start`` cover."""
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + run, -1)
    return np.cumsum(covered[:n]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN, min_pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens a substring of ``run`` tokens covers that ``min_pages`` distinct pages hold."""
    order, first, pages = run_classes(tokens, page, run)
    often = np.repeat(pages >= min_pages, np.diff(np.append(first, len(order))))
    return _cover(order[often], run, len(tokens))


def run_keys(words: list[str], tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """64-bit hash of the words of every substring of ``run`` tokens, the same in every part of a host."""
    hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                       for w in words], dtype=np.uint64)
    n = len(tokens) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h, out = hashes[tokens], np.zeros(n, dtype=np.uint64)
    for k in range(run):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def main_text(found: list[Block], cover: list[float]) -> str:
    """The article of one page: its blocks and the share of each that the host repeats."""
    inside = [(b, c) for b, c in zip(found, cover, strict=True) if b.main]
    if inside:
        kept = [b for b, c in inside if not (c > COVERED and b.link >= COVERED * len(b.text))]
    else:
        rest = [(b, c) for b, c in zip(found, cover, strict=True) if not b.never]
        kept = [b for b, c in rest if c <= COVERED and b.link < COVERED * len(b.text)]
        if not kept:                                   # a page that the host holds several times over
            kept = [b for b, _ in rest if b.link < COVERED * len(b.text)]
    return "\n\n".join(b.text for b in kept)


def undecided(found: list[Block]) -> list[bool]:
    """Which blocks of a page stay or go by the share of them that the host repeats (see :func:`main_text`)."""
    inside = any(b.main for b in found)
    return [b.main and b.link >= COVERED * len(b.text) if inside else
            not b.never and b.link < COVERED * len(b.text) for b in found]


def _streams(found: list[list[Block]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the token stream of all pages, the page of each token, and where blocks begin (and the end)."""
    ids: dict[str, int] = {}
    streams, owner, lengths = [], [], []
    for i, bs in enumerate(found):
        for b in bs:
            words = b.text.split(" ")
            streams.extend([ids.setdefault(w, len(ids)) for w in words])
            lengths.append(len(words))
            owner.append(i)
    n = np.array(lengths, dtype=np.int64)
    return (list(ids), np.array(streams, dtype=np.int64), np.repeat(np.array(owner, dtype=np.int64), n),
            np.concatenate([[0], np.cumsum(n)]))


def _texts(found: list[list[Block]], hit: np.ndarray, at: np.ndarray) -> list[str]:
    ends = np.concatenate([[0], np.cumsum(hit)])
    share = (ends[at[1:]] - ends[at[:-1]]) / np.maximum(np.diff(at), 1)
    out, k = [], 0
    for bs in found:
        out.append(main_text(bs, list(share[k:k + len(bs)])))
        k += len(bs)
    return out


def extract_group(pages: list[str | None], run: int = RUN, min_pages: int = MIN_PAGES) -> list[str]:
    """Main texts of all pages of one host."""
    found = [blocks(h) for h in pages]
    _, tokens, page, at = _streams(found)
    return _texts(found, repeated(tokens, page, run, min(min_pages, max(2, len(pages)))), at)


def part_runs(pages: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the runs of some pages of a host, the pages of each, and whether an undecided block touches it."""
    found = [blocks(h) for h in pages]
    words, tokens, page, at = _streams(found)
    order, first, n_pages = run_classes(tokens, page, run)
    if not len(order):
        return order, n_pages, np.zeros(0, dtype=bool)
    open_blocks = np.array([u for bs in found for u in undecided(bs)], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(np.repeat(open_blocks, np.diff(at)))])
    asks = ends[order + run] > ends[order]
    return run_keys(words, tokens, run)[order[first]], n_pages, np.logical_or.reduceat(asks, first)


def extract_part(pages: list[str | None], often: np.ndarray, run: int = RUN) -> list[str]:
    """Main texts of some pages of a host, of whose runs ``often`` are repeated on the host."""
    found = [blocks(h) for h in pages]
    words, tokens, page, at = _streams(found)
    keys = run_keys(words, tokens, run)
    start = np.flatnonzero(np.isin(keys, often) & (page[:len(keys)] == page[len(tokens) - len(keys):]))
    return _texts(found, _cover(start, run, len(tokens)), at)


def host(url: str = "url"):
    """Lower-cased host of a URL column, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def extract_text(pages: DataFrame, part_bytes: int = PART_BYTES, run: int = RUN,
                 min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    A host with more html than ``part_bytes`` (or than a tenth of a shuffle
    partition, if that is more) is looked at in parts of about that size, dealt
    by a hash of the page, so that no host is ever gathered in one task.  What
    the host repeats is counted over all its parts: where a block of any page
    depends on it, each part's runs are added up by their hash, and the parts
    take the sums, so the texts do not depend on the parts.  Null html reads as
    empty (empty text), pages without a URL share the host '', null ids and
    repeated rows keep their rows, an empty table gives none, other columns are
    not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"),
                       host().alias("__host"))
    size = F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes")
    by_host = src.groupBy("__host").agg(size, F.count(F.lit(1)).alias("pages"))
    total = src.agg(size).first()["bytes"] or 0
    limit = max(part_bytes, total // (10 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # At most total / limit <= 10 hosts a shuffle partition are above the limit.
    hot = by_host.filter(F.col("bytes") > limit).select(
        F.col("__host").alias("__hot"), F.ceil(F.col("bytes") / limit).cast("int").alias("__parts"),
        F.least(F.lit(min_pages), F.greatest(F.lit(2), F.col("pages"))).alias("__least"))
    dealt = src.join(F.broadcast(hot), F.col("__host") == F.col("__hot"), "left").withColumn(
        "__part", F.when(F.col("__parts").isNull(), 0).otherwise(
            F.pmod(F.xxhash64("page_id", "url", F.octet_length("html")), F.col("__parts"))).cast("int"))

    def texts_of(b: pd.DataFrame, texts) -> pd.DataFrame:
        order = np.lexsort((b["url"].fillna("").to_numpy(dtype=str), b["page_id"].fillna(-1).to_numpy()))
        b = b.iloc[order]
        out = texts(list(b["html"]))
        return pd.DataFrame({"page_id": b["page_id"].to_numpy(), "url": b["url"].to_numpy(), "text": out,
                             "n_chars": [len(t) for t in out]})

    def run_group(b: pd.DataFrame) -> pd.DataFrame:
        return texts_of(b, lambda h: extract_group(h, run, min_pages))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[any(undecided(blocks(h))) for h in b["html"]], ["__host"]].drop_duplicates()

    def count_runs(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        keys, n_pages, asks = part_runs(list(b["html"]), run)
        return pd.DataFrame({"__host": key[0], "__part": key[1], "__least": b["__least"].iloc[0], "key": keys,
                             "pages": n_pages, "asks": asks})

    def run_part(b: pd.DataFrame, often: pd.DataFrame) -> pd.DataFrame:
        return texts_of(b, lambda h: extract_part(h, often["key"].to_numpy(dtype=np.int64), run))

    schema = "page_id long, url string, text string, n_chars long"
    parts = dealt.filter(F.col("__parts") > 1)
    # hosts in parts with a block that waits for the count: at most 10 names a shuffle partition
    asking = [r["__host"] for r in parts.select("__host", "html").mapInPandas(ask, "__host string").distinct().collect()]
    kept = ("page_id", "url", "html", "__host", "__part")
    if not asking:
        return dealt.select(*kept).groupBy("__host", "__part").applyInPandas(run_group, schema)
    counted = F.col("__host").isin(asking)
    runs = parts.filter(counted).select("html", "__host", "__part", "__least").groupBy("__host", "__part").applyInPandas(
        count_runs, "__host string, __part int, __least long, key long, pages long, asks boolean")
    often = runs.withColumn("pages", F.sum("pages").over(Window.partitionBy("__host", "key"))).filter(
        F.col("asks") & (F.col("pages") >= F.col("__least"))).select("__host", "__part", "key")
    whole = dealt.filter(~counted).select(*kept).groupBy("__host", "__part").applyInPandas(run_group, schema)
    return whole.unionByName(parts.filter(counted).select(*kept).groupBy("__host", "__part").cogroup(
        often.groupBy("__host", "__part")).applyInPandas(run_part, schema))
