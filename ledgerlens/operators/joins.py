"""Joins whose key is often null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_left_join(df: DataFrame, other: DataFrame, key: str, spread: str) -> DataFrame:
    """``df.join(other, key, "left")`` for a string key that is null in many rows.

    A null key matches nothing, yet a shuffle sends all null rows to one
    partition. Here their join key is a hash of ``spread`` behind a character
    that no key of ``other`` starts with, so they are dealt like the rest."""
    apart = F.concat(F.lit("\u0000"), F.xxhash64(spread).cast("string"))
    left = df.withColumn("_join_key", F.coalesce(F.col(key), apart))
    right = other.where(F.col(key).isNotNull()).withColumnRenamed(key, "_join_key")
    return left.join(right, "_join_key", "left").drop("_join_key")
