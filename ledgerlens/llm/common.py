"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Rows of text travel to Python in batches bounded in rows and in bytes.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

# Spark then removes the shuffle files of a query when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()

BITMAP_BITS = 1 << 24  # 2 MB, whatever the number of keys


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)
    return spark


def give_back() -> None:
    """Called at the end of a task: an idle worker does not hold on to the memory of its batches."""
    pa.default_memory_pool().release_unused()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the
    lineage ends there, and a lost executor costs nothing that was staged. The
    shuffle files behind it go with the write; nothing reads them again."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    staged = spark.read.schema(df.schema).parquet(path)
    _paths[staged] = path
    return staged


def drop_staged(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def least_hashed(df: DataFrame, keys: list[str], n: int, total: int) -> DataFrame:
    """About the ``n`` rows of ``df`` (which has ``total`` rows) with the smallest hash of ``keys``, at most ``n``.
    A threshold comes before the sort, so what the sort moves depends on ``n``, not on the number of partitions."""
    h = F.xxhash64(*keys)
    share = (1.25 * n + 100) / max(1, total)
    if share < 1:
        df = df.where(h < F.lit(int(-(1 << 63) + share * float(1 << 64))))
    return df.orderBy(h, *keys).limit(n)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def id_bitmap(ids: DataFrame, column: str) -> bytes:
    """A fixed-size bitmap of hashed ids (a one-hash Bloom filter): rows whose
    bit is unset are certainly not among ``ids``."""
    bit = F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(BITMAP_BITS)) + 1
    parts = (ids.select(bit.alias("b"))
             .groupBy(F.bitmap_bucket_number("b").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect())
    out = bytearray(BITMAP_BITS // 8)
    for r in parts:
        out[(r["part"] - 1) * 4096:r["part"] * 4096] = r["bits"]
    return bytes(out)


def bitmap_bit(column: str) -> Column:
    """The bit of :func:`id_bitmap` that belongs to an id."""
    return F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(BITMAP_BITS))
