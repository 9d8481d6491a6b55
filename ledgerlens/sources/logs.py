"""Raw log table: bronze layout and the filtered scans every decoder starts from.

Bronze layout = the raw columns plus three derived top-level columns:
``topic0`` (so the event-type predicate is a pushed Parquet filter; a predicate
on ``topics[0]`` is not pushed), ``topic_count`` (so the arity guard is pushed
too) and ``block_date`` (a time floor prunes row groups by its bounds). There is
no directory per day: their number would grow with the history, not with the
bytes, and every reader would have to list them. Hex is stored lowercase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, TimestampType

LOG_SCHEMA = StructType([
    StructField("address", StringType(), True),
    StructField("topics", ArrayType(StringType(), True), True),
    StructField("data", StringType(), True),
    StructField("block_timestamp", TimestampType(), True),
    StructField("transaction_hash", StringType(), True),
    StructField("log_index", LongType(), True),
])
LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]
BRONZE_COLUMNS = LOG_COLUMNS + ["topic0", "topic_count", "block_date"]


def to_bronze(raw: DataFrame) -> DataFrame:
    """Raw logs -> bronze layout (lowercase hex, topic0, block_date)."""
    return raw.select(
        F.lower("address").alias("address"),
        F.transform("topics", F.lower).alias("topics"),
        F.lower("data").alias("data"),
        F.col("block_timestamp").cast("timestamp").alias("block_timestamp"),
        F.lower("transaction_hash").alias("transaction_hash"),
        F.col("log_index").cast("bigint").alias("log_index"),
    ).withColumns({
        "topic0": F.get(F.col("topics"), 0),
        "topic_count": F.size("topics"),
        "block_date": F.to_date("block_timestamp"),
    })


def write_bronze(logs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sink: bronze Parquet, one run of (address, topic0, time) per file.

    Rows are dealt by ranges of that order, so that a busy event or day spreads
    over as many tasks as its rows need. A file holds one stretch of time of one
    event (or a few small ones), so the bounds of its row groups let a scan skip
    other contracts, other events and what lies before a time floor. The files
    are as many as the write's tasks, however many days the logs span."""
    order = ["address", "topic0", "block_timestamp", "log_index"]
    logs.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_logs(logs: DataFrame, address: str, since: str | None = None,
              min_topics: int = 1, topic0: str | None = None) -> DataFrame:
    """A1 / A2 / B1 / B2: one contract's logs since a floor, optionally one event.

    Every predicate is on a top-level column so Parquet pushdown applies;
    the array-length guard is evaluated after."""
    cond: Column = F.col("address") == F.lit(address.lower())
    if since is not None:
        cond = cond & (F.col("block_timestamp") >= F.lit(since).cast("timestamp"))
        if "block_date" in logs.columns:
            cond = cond & (F.col("block_date") >= F.to_date(F.lit(since)))
    if topic0 is not None:
        col0 = F.col("topic0") if "topic0" in logs.columns else F.get(F.col("topics"), 0)
        cond = cond & (col0 == F.lit(topic0))
    arity = F.col("topic_count") if "topic_count" in logs.columns else F.size("topics")
    cond = cond & (arity >= min_topics)
    return logs.where(cond)
