"""Sinks and snapshot sources (A4-A11): versioned writes with a pointer switch.

Overwriting the directory a job reads, or ``mode("overwrite")`` on the live
location, leaves readers with nothing when the job fails half way. Every sink
here writes a *new* version directory ``<root>/v=<run id>`` and only then
moves the ``_CURRENT`` pointer; readers follow the pointer, or the newest
complete version (one with ``_SUCCESS``) when the pointer is missing. Paths
may be on any Hadoop file system (the cluster's shared storage).
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AGENT_SUMMARY_SCHEMA
from ..operators.serve import snapshot_rows

POINTER = "_CURRENT"


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file aside and rename it over ``path``, so that readers see the old or the new text."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    fs, target = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    rename = getattr(hadoop, "Options$Rename")
    options = sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def new_run_id() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]


def _complete_versions(spark: SparkSession, root: str) -> list[str]:
    fs, p = file_system(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(name)
    return sorted(out)


def current_version(spark: SparkSession, root: str) -> str | None:
    """Version named by the pointer, else the newest complete version."""
    named = get_text(spark, f"{root.rstrip('/')}/{POINTER}")
    if named and named.strip():
        return named.strip()
    versions = _complete_versions(spark, root)
    return versions[-1] if versions else None


# JSON text keeps a timestamp's microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_version(df: DataFrame, root: str, fmt: str = "parquet", run_id: str | None = None,
                  partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new version and switch the pointer to it."""
    spark = df.sparkSession
    version = f"v={run_id or new_run_id()}"
    writer = df.write.mode("errorifexists").format(fmt).options(**(_JSON if fmt == "json" else {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{root.rstrip('/')}/{version}")
    put_text(spark, f"{root.rstrip('/')}/{POINTER}", version)
    return version


def read_current(spark: SparkSession, root: str, fmt: str = "parquet", schema=None) -> DataFrame | None:
    version = current_version(spark, root)
    if version is None:
        return None
    reader = spark.read.format(fmt).options(**(_JSON if fmt == "json" else {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(f"{root.rstrip('/')}/{version}")


# ---------------------------------------------------------------------------
# Materialized table
# ---------------------------------------------------------------------------

def materialize_table(df: DataFrame, table: str, root: str, comment: str | None = None) -> str:
    """A4 + A5: create the schema if absent, write a new version, then point
    the (external) table at it; the old version stays readable until then."""
    spark = df.sparkSession
    if "." in table:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    version = write_version(df, root)
    location = f"{root.rstrip('/')}/{version}"
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
        spark.sql(f"REFRESH TABLE {table}")
    else:
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{location}'")
    if comment is not None:
        escaped = comment.replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('comment' = '{escaped}')")
    return version


def read_ranked(spark: SparkSession, table: str) -> DataFrame:
    """The full table in rank order."""
    return spark.table(table).orderBy("rank")


# ---------------------------------------------------------------------------
# JSON snapshot export and load
# ---------------------------------------------------------------------------

def export_snapshot(summary: DataFrame, root: str, sample_root: str | None = None, sample: int = 50,
                    run_id: str | None = None) -> str:
    """All rows as camelCase JSON (A12 + A7), plus the top-N sample."""
    rows = snapshot_rows(summary)
    version = write_version(rows.orderBy("rank"), root, fmt="json", run_id=run_id)
    if sample_root is not None:
        write_version(rows.orderBy("rank").limit(sample), sample_root, fmt="json", run_id=run_id)
    return version


def load_agents(spark: SparkSession, live_root: str, fixture_root: str):
    """The live snapshot if one exists, else the fixture sample.

    The rows have the export's columns and types, also where all values are null.
    Returns (rows with a ``source`` column, computed_at of the first row)."""
    schema = snapshot_rows(spark.createDataFrame([], AGENT_SUMMARY_SCHEMA)).schema
    live = read_current(spark, live_root, fmt="json", schema=schema)
    source, df = ("live", live) if live is not None else ("fixtures", read_current(spark, fixture_root, fmt="json", schema=schema))
    if df is None:
        return None, None
    first = df.orderBy("rank").select("computedAt").limit(1).collect()
    computed_at = first[0][0] if first else None
    return df.withColumn("source", F.lit(source)), computed_at


# ---------------------------------------------------------------------------
# Versioned caches
# ---------------------------------------------------------------------------

def upsert_cache(spark: SparkSession, root: str, new_rows: DataFrame, key: str) -> str:
    """Read the current cache version, replace rows by key, write the next
    version (never overwriting the directory being read)."""
    old = read_current(spark, root)
    merged = new_rows if old is None else old.join(new_rows.select(key), key, "left_anti").unionByName(new_rows)
    return write_version(merged, root)


# ---------------------------------------------------------------------------
# A cache in key buckets
# ---------------------------------------------------------------------------

CACHE_BUCKETS = 64
FEW_KEYS = 100_000  # the bound of a broadcast of new keys


def key_bucket(key: str, buckets: int = CACHE_BUCKETS):
    """The bucket of a key: four hexadecimal digits of its MD5, modulo the number of buckets."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(buckets))


def _bucket_folders(spark: SparkSession, path: str) -> list[int]:
    fs, p = file_system(spark, path)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[len("bucket="):]) for n in names if n.startswith("bucket="))


def read_buckets(spark: SparkSession, root: str) -> DataFrame | None:
    """The cache at ``root``, None before the first run that succeeds with rows; ``bucket`` is the partition column."""
    path = f"{root.rstrip('/')}/rows"
    return spark.read.parquet(path) if _bucket_folders(spark, path) else None


def upsert_buckets(spark: SparkSession, root: str, new_rows: DataFrame, key: str, fresh=None, buckets: int = CACHE_BUCKETS) -> list[int]:
    """Replace rows by key and rewrite only the buckets that hold a new key.

    ``new_rows`` (one row per key) are staged once, unless the cache is new; the buckets they fall into
    are read, rows with the same key and rows that are not ``fresh`` any more (a condition on the cache's
    columns) are left out, and Spark overwrites just these partitions when all tasks have succeeded. With
    at most ``FEW_KEYS`` new keys the old rows are written by the tasks that read them, without a shuffle.
    A run that fails before leaves the old rows. Returns the rewritten buckets."""
    base = root.rstrip("/")

    def put(rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{base}/rows")
    new, old = new_rows.withColumn("bucket", key_bucket(key, buckets)), read_buckets(spark, base)
    if old is None:
        put(new.repartition(buckets, "bucket"))
        return _bucket_folders(spark, f"{base}/rows")
    incoming = f"{base}/_incoming/{new_run_id()}"
    new.write.parquet(f"{incoming}/rows")
    new = spark.read.schema(new.schema).parquet(f"{incoming}/rows")
    new.select("bucket", key).write.parquet(f"{incoming}/keys")
    keys = spark.read.parquet(f"{incoming}/keys")
    touched = {r["bucket"]: r["count"] for r in keys.groupBy("bucket").count().collect()}  # at most ``buckets`` rows
    if touched:
        kept = old.where(F.col("bucket").isin(list(touched)))  # a partition filter: no other bucket is read
        kept = kept if fresh is None else kept.where(fresh)
        few = sum(touched.values()) <= FEW_KEYS
        rows = kept.join(F.broadcast(keys) if few else keys, ["bucket", key], "left_anti").select(*new.columns)
        put(rows.unionByName(new.repartition(buckets, "bucket")) if few else rows.unionByName(new).repartition(buckets, "bucket"))
    fs, p = file_system(spark, incoming)
    fs.delete(p, True)
    return sorted(touched)


# ---------------------------------------------------------------------------
# A summary laid out for point lookups
# ---------------------------------------------------------------------------

ROW_GROUP_BYTES = 1 << 20


def write_by_id(summary: DataFrame, root: str, row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    """A version of the summary in id order: small row groups, whose bounds and Bloom filters on the id tell a
    reader which of them can hold an agent."""
    version = f"v={new_run_id()}"
    (summary.repartitionByRange("agent_id").sortWithinPartitions("agent_id").write.mode("errorifexists")
     .option("parquet.bloom.filter.enabled#agent_id", "true").option("parquet.block.size", str(row_group_bytes))
     .option("parquet.block.size.row.check.min", "100").option("parquet.page.size.row.check.min", "100")
     .parquet(f"{root.rstrip('/')}/{version}"))
    put_text(summary.sparkSession, f"{root.rstrip('/')}/{POINTER}", version)
    return version


def read_by_id(spark: SparkSession, root: str, ids: list[int]) -> DataFrame:
    """The stored rows of some agents: the ids are a Parquet filter, so row groups without any of them are not read."""
    rows = read_current(spark, root, schema=AGENT_SUMMARY_SCHEMA)
    if rows is None:
        raise ValueError(f"nothing stored under {root}")
    return rows.where(F.col("agent_id").isin([int(i) for i in ids])) if ids else rows.limit(0)
