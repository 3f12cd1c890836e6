"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoplane.session import ensure_checkpoint_dir, ship_package

# One Arrow batch holds at most this many bytes, so that a run of very long
# texts cannot fill a Python worker.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, find the shared folder, bound Arrow batches by bytes."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the session's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends at files every executor sees."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    # rows may hold megabytes: look at the size of a row group more often than every hundred rows
    df.write.option("parquet.block.size.row.check.min", "8").option(
        "parquet.page.size.row.check.min", "8").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def sample_share(wanted: int, total: int) -> float:
    """Share of rows whose hash is kept so that about ``wanted`` of ``total`` rows stay."""
    return 1.0 if total <= wanted else wanted / total


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 7) -> DataFrame:
    """The rows whose key hashes below ``share``: the same rows on every run and partitioning."""
    if share >= 1.0:
        return df
    limit = int(share * (1 << 31))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 31)) < F.lit(limit))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of ``texts`` in one array, and the offsets of each text (len + 1)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, dtype=np.uint32), ends


def crc_mod(doc_id: object, folds: int) -> int:
    """Driver-side twin of :func:`fold` for tests."""
    return zlib.crc32(str(doc_id).encode()) % folds
