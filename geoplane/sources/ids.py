"""Sequential feature ids in file order (ING-14) without a single-partition window.

``monotonically_increasing_id`` encodes (partition index, position in the
partition).  Rows of one piece of input -- a scan partition, or with
``order_by`` a (file, block) of a scan, whatever partition Spark packed it
into -- are neighbours there.  One aggregate counts the rows of each piece
(one row a piece), a window over those counts gives every piece its offset,
and every row gets ``offset + position in its piece``: the DataFrame form of
``zipWithIndex``.  The input must be deterministic (a file scan is).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_POS_BITS = 33
# Columns that name a row's piece of a file scan, in file order.
FILE_PIECE = ("__file", "__block")


def with_file_piece(df: DataFrame) -> DataFrame:
    """Add the file and block a scanned row comes from (``df`` is the scan itself)."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE_PIECE[0]),
                     F.col("_metadata.file_block_start").alias(FILE_PIECE[1]))


def with_sequential_id(df: DataFrame, name: str = "id", start: int = 1,
                       order_by: tuple[str, ...] | None = None) -> DataFrame:
    """Number the rows from ``start``: by scan partition, or by ``order_by`` (see :data:`FILE_PIECE`)."""
    tagged = df.withColumn("__mid", F.monotonically_increasing_id())
    if order_by is None:
        tagged = tagged.withColumn("__piece", F.shiftright(F.col("__mid"), _POS_BITS))
        order_by = ("__piece",)
    pieces = tagged.groupBy(*order_by).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    before = Window.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)     # one row a piece
    pieces = pieces.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).select(
        *[F.col(c).alias(f"__by_{c}") for c in order_by], "__off")
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in order_by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = tagged.join(pieces, on, "left").withColumn(name, F.col("__mid") + F.col("__off") + F.lit(start))
    return out.drop("__mid", "__off", "__piece", *[f"__by_{c}" for c in order_by])
