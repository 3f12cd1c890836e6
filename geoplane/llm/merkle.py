"""Merkle dataset manifest by nested-struct rollup.

Leaves are ranked within their source.  The base-16 digits of a rank are
grouped away one after the other inside blocks of 16^3 leaves, each group's
rows nesting as an array of child structs beside their digest.  The blocks of a
source are leaves of the next rollup, until each source has one; the sources
are leaves of a last tree.  On the way back each block meets its place in the
tree above (one row a block, unioned and grouped by the block), and transforms
and explodes emit each leaf's siblings, proof and folded root without joins.

Ranks come from a range partitioning, so that a source with most of the rows
has no task of its own: one row a partition says where its first source starts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoplane.llm.common import fold, prepare, written

# Children of a node, and digits that are grouped away inside one block.
ARITY, DIGITS = 16, 3
BLOCK = ARITY ** DIGITS
# Leaves of one range partition.
RANGE_ROWS = 200_000

LEVEL = "struct<before:string,after:string>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaves(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id, source, leaf, other``: ``other`` is the leaf of the tampered row, null where nothing is changed.

    Tampering lower-cases the text's A-Z.
    """
    def leaf(text: Column) -> Column:
        return digest(F.concat(*[field(text if f == "text" else F.col(f)) for f in fields]))

    low = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    other = F.when(F.coalesce(tampered, F.lit(False)) & F.col("text").rlike("[A-Z]"), leaf(low))
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), other.alias("other"))


def ranked(rows: DataFrame, key: str, order: list[str], what: str) -> DataFrame:
    """``rows`` with ``no``, the rank from 0 within ``key`` by ``order``, and ``n``, the key's number of rows.

    Null keys are one key.  Rows are dealt by ranges of (key, order) and written;
    per partition at most two keys go on in another one, so the table of the
    keys' offsets has at most two rows a partition.
    """
    parts = max(1, -(-rows.count() // RANGE_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    dealt = written(rows.repartitionByRange(parts, *by).withColumn("__pid", F.spark_partition_id()), what)

    counts = dealt.groupBy(key, "__pid").agg(F.count(F.lit(1)).alias("__c"))
    along = Window.partitionBy(key).orderBy("__pid")
    sums = counts.withColumn("__from", F.sum("__c").over(along) - F.col("__c")).withColumn(
        "__all", F.sum("__c").over(Window.partitionBy(key)))
    spread = sums.filter(F.col("__all") > F.col("__c")).select(
        F.col("__pid").alias("__p"), F.col(key).alias("__k"), "__from", "__all")
    own = Window.partitionBy(key, "__pid")
    local = dealt.withColumn("__at", F.row_number().over(own.orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1) \
        .withColumn("__c", F.count(F.lit(1)).over(own))
    # bounded by two rows a partition, whatever the number of keys
    return local.join(F.broadcast(spread), (F.col("__pid") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k")), "left") \
        .withColumn("no", F.col("__at") + F.coalesce("__from", F.lit(0))) \
        .withColumn("n", F.coalesce("__all", "__c")).drop("__pid", "__p", "__k", "__at", "__c", "__from", "__all")


def rollup(nodes: DataFrame, key: str, payload: list[str], what: str) -> DataFrame:
    """Blocks of ``BLOCK`` consecutive nodes as nested structs: ``key, n, block, hash, kids``.

    ``nodes`` has ``key, n, no, hash`` and the payload columns.  A level that
    has one node in the whole tree is not hashed again, so a lone node goes up
    as it is.
    """
    kid = F.struct(F.col("no").alias("at"), "hash", *payload)
    block = F.floor(F.col("no") / BLOCK)
    at = nodes.select(key, "n", block.alias("block"), kid.alias("kid")).repartition(key, "n", "block")
    for level in range(DIGITS):
        up = F.floor(F.col("kid.at") / ARITY)
        hashed = digest(F.array_join(F.col("kids.hash"), ""))
        at = at.withColumn("at", up).groupBy(key, "n", "block", "at").agg(
            F.array_sort(F.collect_list("kid")).alias("kids")).select(
            key, "n", "block", F.struct(
                "at", F.when(F.col("n") > ARITY ** level, hashed).otherwise(F.col("kids")[0]["hash"]).alias("hash"),
                "kids").alias("kid"))
    return written(at.select(key, "n", "block", F.col("kid.hash").alias("hash"), F.col("kid.kids").alias("kids")), what)


def unroll(blocks: DataFrame, above: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """One row per node below ``blocks``: ``key, no, path, top, hash`` and the payload columns.

    ``above`` has ``key, no, path, top`` of each block (``no`` its number): the
    siblings on each level above it and the tree's uppermost digest.  ``path``
    gets this rollup's levels in front, the lowest first.
    """
    path_type = f"array<{LEVEL}>"
    rows = blocks.select(key, F.col("block").alias("no"), "n", "kids", F.lit(None).cast(path_type).alias("path"),
                         F.lit(None).cast("string").alias("top"))
    places = above.select(key, "no", F.lit(None).cast("long").alias("n"),
                          F.lit(None).cast(blocks.schema["kids"].dataType).alias("kids"), "path", "top")
    at = rows.unionByName(places).groupBy(key, "no").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "top")])
    hashes = F.col("kids.hash")

    def beside(kid: Column, i: Column) -> Column:
        return F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("before"),
                        F.array_join(F.slice(hashes, i + 2, F.lit(ARITY)), "").alias("after"), kid.alias("kid"))

    for level in range(DIGITS - 1, -1, -1):
        each = at.select(key, "n", "path", "top", F.explode(F.transform("kids", beside)).alias("e"))
        level_here = F.array(F.struct("e.before", "e.after")).cast(path_type)
        path = F.when(F.col("n") > ARITY ** level, F.concat(level_here, F.col("path"))).otherwise(F.col("path"))
        below = ["n", F.col("e.kid.kids").alias("kids")] if level else [
            F.col("e.kid.hash").alias("hash"), *[F.col("e.kid")[c].alias(c) for c in payload]]
        at = each.select(key, F.col("e.kid.at").alias("no"), path.alias("path"), "top", *below)
    return at


def tree(nodes: DataFrame, key: str, payload: list[str], what: str) -> tuple[list[DataFrame], DataFrame]:
    """All rollups of ``nodes``, and the uppermost digest of each key: ``key, hash``."""
    levels, own = [], payload
    while True:
        blocks = rollup(nodes, key, own, f"{what}{len(levels)}")
        levels.append(blocks)
        if (blocks.agg(F.max("n").alias("n")).first()["n"] or 0) <= BLOCK:
            return levels, blocks.select(key, "hash")
        nodes = blocks.select(key, F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("no"), "hash")
        own = []


def descend(levels: list[DataFrame], above: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Every node's path: ``above`` has ``key, path, top`` of each key, ``levels`` comes from ``tree``."""
    at = above.withColumn("no", F.lit(0).cast("long"))
    for i in range(len(levels) - 1, -1, -1):
        at = unroll(levels[i], at, key, payload if i == 0 else [])
    return at


def manifest(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, folded, folded_root, verified`` for every row of ``docs``.

    ``path`` holds, level by level from the leaf to the root, the concatenated
    siblings before and after the row's node; ``folded_root`` is recomputed from
    it and the tampered leaf (the original one where nothing is tampered with).
    Leaves ascend by doc_id within their source, null ids first; rows with equal
    ids by their digest, and equal rows are leaves side by side.  Null sources
    are one source.  An empty table gives no rows; other columns are not read;
    texts are whole.
    """
    prepare(docs.sparkSession)
    rows = leaves(docs, tampered, fields)
    # one row per leaf, in the order of its source
    nodes = ranked(rows, "source", ["doc_id", "leaf"], "merkle-leaves").withColumnRenamed("leaf", "hash")
    payload = ["doc_id", "other"]
    low, subroots = tree(nodes, "source", payload, "merkle-blocks")
    tops = ranked(subroots.select(F.lit(0).alias("tree"), "source", "hash"), "tree", ["source"], "merkle-sources")
    high, roots = tree(tops, "tree", ["source"], "merkle-tops")
    start = roots.select("tree", F.array().cast(f"array<{LEVEL}>").alias("path"), F.col("hash").alias("top"))
    places = descend(high, start, "tree", ["source"]).select(
        "source", "path", F.to_json(F.struct(F.col("hash").alias("s"), F.col("top").alias("r"))).alias("top"))
    at = descend(low, places, "source", payload)
    folded = F.aggregate("path", F.coalesce("other", "hash"),
                         lambda acc, lv: digest(F.concat(lv["before"], acc, lv["after"])))
    root = F.get_json_object("top", "$.r")
    return at.select("doc_id", "source", F.col("hash").alias("leaf"), F.get_json_object("top", "$.s").alias("subroot"),
                     root.alias("root"), "path", folded.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def one_in_five(doc_id: Column) -> Column:
    """The contract's tampered rows: 5 divides the crc32 of the decimal id."""
    return fold(doc_id, 5) == 0


def proof(path: Column) -> Column:
    """Digest of all siblings, from the leaf's level up to the root, left to right."""
    return digest(F.array_join(F.transform(path, lambda lv: F.concat(lv["before"], lv["after"])), ""))


def _sql(low: int = 6, high: int = 4) -> str:
    """DuckDB text of the contract's query, for sources of up to 16^low rows and up to 16^high sources."""
    def fields(text: str) -> str:
        return " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
                           for c in ("doc_id", "source", "lang", "n_chars", text))

    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
            lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
    parts = [f"""leaf AS (SELECT doc_id, source, sha256({fields('text')}) AS leaf,
        CASE WHEN {crc} % 5 = 0 THEN sha256({fields("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS other
        FROM documents)""",
             """a0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS no,
        count(*) OVER (PARTITION BY source) AS n FROM leaf)"""]

    def levels(t: str, key: str, depth: int) -> None:
        for k in range(depth):
            parts.append(f"""{t}g{k} AS (SELECT {key}, no // 16 AS no, any_value(n) AS n, list(h ORDER BY no) AS hs
                FROM {t}{k} GROUP BY {key}, no // 16)""")
            parts.append(f"""{t}{k + 1} AS (SELECT {key}, no, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n,
                CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {t}g{k})""")

    levels("a", "source", low)
    parts.append(f"""b0 AS (SELECT 0 AS tree, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS no,
        count(*) OVER () AS n FROM a{low})""")
    levels("b", "tree", high)
    parts.append("""f0 AS (SELECT a0.doc_id, a0.source, a0.leaf, a0.no AS a, b0.no AS b, b0.h AS subroot,
        coalesce(a0.other, a0.leaf) AS acc, '' AS sib FROM a0 JOIN b0 ON a0.source IS NOT DISTINCT FROM b0.source)""")
    at = 0
    for t, depth, same in (("a", low, "f.source IS NOT DISTINCT FROM g.source"), ("b", high, "true")):
        for k in range(depth):
            own = f"f.{t} // {16 ** k} % 16"
            parts.append(f"""f{at + 1} AS (SELECT f.doc_id, f.source, f.leaf, f.a, f.b, f.subroot,
                CASE WHEN g.n > 1 THEN sha256(array_to_string(list_slice(hs, 1, {own}), '') || acc
                    || array_to_string(list_slice(hs, {own} + 2, 16), '')) ELSE acc END AS acc,
                CASE WHEN g.n > 1 THEN sib || array_to_string(list_slice(hs, 1, {own}), '')
                    || array_to_string(list_slice(hs, {own} + 2, 16), '') ELSE sib END AS sib
                FROM f{at} f JOIN {t}g{k} g ON {same} AND f.{t} // {16 ** (k + 1)} = g.no)""")
            at += 1
    return f"""WITH {", ".join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256,
        acc AS folded_root, acc = h AS verified FROM f{at}, b{high}"""


SQL = _sql()
