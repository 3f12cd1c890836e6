"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  When two
fingerprints differ in at most two bits, one of the segments differs in at
most one bit, so the two share a *one-wildcard variant* of that segment: the
segment with one bit position struck out.  Each distinct fingerprint is
indexed under its 64 variants, an equality join on the variants finds the
candidates, and the bit distance is verified.

A variant shared by very many fingerprints is not expanded into pairs: its
members are linked through one-flip codes instead.  Two fingerprints differ in
at most two bits exactly when one code is reached from both by flipping at
most one bit, so linking every member to the smallest one under each code
gives the same components with 65 rows per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoplane.llm.common import prepare, written
from geoplane.llm.components import connected_components

SEGMENT_BITS = 32
MAX_BITS = 2
# Ids dropped by broadcast up to this many (8 bytes each); beyond it the anti join shuffles.
BROADCAST_IDS = 1_000_000
# Variants with more members than this are linked through one-flip codes.
PAIRED_MEMBERS = 24


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text; zero when it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), dtype="<u8", count=len(grams))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):        # bounded memory for very long texts
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed long with the fingerprint's bits) for every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b["__t"]), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__t"))
    return src.mapInPandas(run, "doc_id long, fp long")


def _named_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, name, fp``: the name is the text's MD5, so that rows with one id and unlike texts stay apart."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b["__t"]), dtype=np.uint64, count=len(b))
            yield pd.DataFrame({"id": b["id"], "name": b["name"], "fp": fp.view(np.int64)})

    text = F.coalesce(F.col("text"), F.lit(""))
    # the id as text: an id column with nulls would reach pandas as floats
    src = docs.select(F.col("doc_id").cast("string").alias("id"), F.md5(text.cast("binary")).alias("name"), text.alias("__t"))
    return src.mapInPandas(run, "id string, name string, fp long").select(
        F.col("id").cast("long").alias("doc_id"), "name", "fp")


def variants(fps: DataFrame) -> DataFrame:
    """``key, fp``: the one-wildcard variants of both segments of each fingerprint."""
    v = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT_BITS - 1))).alias("v"))
    segment = F.when(F.col("v") < SEGMENT_BITS, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(
        F.shiftrightunsigned("fp", SEGMENT_BITS))
    wild = F.bitwise_not(F.expr("shiftleft(1L, v % 32)"))
    return v.select((F.expr("shiftleft(cast(v as bigint), 32)") + segment.bitwiseAND(wild)).alias("key"), "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS, paired: int = PAIRED_MEMBERS) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints whose components are those of distance <= ``max_bits``.

    Variants of at most ``paired`` members give verified pairs; the members of
    larger ones are linked through one-flip codes (see the module text).
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("two segments with one wildcard prove distances of at most two bits")
    w = Window.partitionBy("key")
    shared = (variants(fps).withColumn("n", F.count(F.lit(1)).over(w)).filter("n > 1"))
    shared = written(shared, "variants")
    small = shared.filter(F.col("n") <= paired).select("key", "fp")
    other = small.select("key", F.col("fp").alias("fp2"))
    pairs = (small.join(other, "key").filter("fp < fp2")
             .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits)
             .select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct())
    if max_bits < 2:
        return pairs.unionByName(_by_exact_neighbours(shared, paired, max_bits))
    crowd = shared.filter(F.col("n") > paired).select("fp").distinct()
    flips = crowd.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("v"))
    code = F.when(F.col("v") == 64, F.col("fp")).otherwise(
        F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, v % 64)")))
    codes = flips.select(code.alias("code"), "fp")
    low = F.min("fp").over(Window.partitionBy("code"))
    stars = codes.withColumn("low", low).filter("low < fp").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars.distinct())


def _by_exact_neighbours(shared: DataFrame, paired: int, max_bits: int) -> DataFrame:
    """Links of distance one (none for zero, as fingerprints are distinct) inside large variants."""
    crowd = shared.filter(F.col("n") > paired).select("fp").distinct()
    flips = crowd.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(
        "fp", F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, v % 64)")).alias("near"))
    out = flips.join(crowd.select(F.col("fp").alias("near")), "near").filter("fp < near")
    return out.select(F.col("fp").alias("a"), F.col("near").alias("b")).filter(F.lit(max_bits >= 1))


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest document id reachable over links of at
    most ``max_bits`` differing bits.  Identical fingerprints collapse before
    the index is built, so a group of copies of any size is one entry.

    Null or wordless texts have fingerprint zero and link like any other; a
    null id keeps its row (its component's id is the smallest non-null one, or
    null); repeated rows each return a row; an empty table returns no rows;
    other columns are not read.
    """
    prepare(docs.sparkSession)
    fps = written(fingerprints(docs, shingle, id_col, text_col), "simhash")
    return fps.join(_labels(fps, max_bits), "fp").select("doc_id", "fp", "component_id")


def _labels(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root, component_id`` of each distinct fingerprint."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    edges = links(classes.select("fp"), max_bits)
    comp = connected_components(edges, "a", "b")
    rooted = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def one_per_group(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest id of each group.

    Rows are named by (id, MD5 of the text): rows that share an id are judged by
    their own texts, of rows with the smallest id the one with the smallest name
    stays, and of equal rows one.  Null ids come last, so such a row stays only
    where its group has no id.
    """
    prepare(docs.sparkSession)
    fps = written(_named_fingerprints(docs, shingle), "simhash")
    rows = fps.join(_labels(fps, max_bits), "fp").groupBy("root", F.col("doc_id").alias("__id"), F.col("name").alias("__name")).agg(
        F.count(F.lit(1)).alias("__n"))
    rows = written(rows, "stay")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("a"), F.col("__id").alias("b"),
                                                   F.col("__name").alias("c"))).alias("best"))
    judged = written(rows.join(best, "root").select("__id", "__name", "__n", (
        F.col("__id").eqNullSafe(F.col("best.b")) & (F.col("__name") == F.col("best.c"))).alias("__stays")), "judged")
    gone = judged.filter("not __stays").select("__id", "__name")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    named = docs.withColumn("__key", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    kept = named.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__name")),
                      "left_anti")
    if not judged.filter("__stays and __n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__key"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
