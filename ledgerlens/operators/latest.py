"""Latest / earliest row per key (W1, W2) as combinable aggregates.

``max_by`` / ``min_by`` over a (timestamp, log_index) struct is a partial
aggregate: each map task keeps one row per key before the shuffle, so a hot
key costs one row per task rather than one task holding all its rows. No sort
and no window are needed. A NULL value on the winning row still wins, as with
the ROW_NUMBER() = 1 form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: str, order: list[str], values: list[str], latest: bool) -> DataFrame:
    agg = F.max_by if latest else F.min_by
    payload = F.struct(*[F.col(v) for v in values])
    ordering = F.struct(*[F.col(o) for o in order])
    return (df.groupBy(key)
              .agg(agg(payload, ordering).alias("_row"))
              .select(key, *[F.col("_row")[v].alias(v) for v in values]))


def latest_per_key(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The row with the greatest ``order`` tuple for each ``key``."""
    return _pick(df, key, order, values, latest=True)


def earliest_per_key(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The row with the smallest ``order`` tuple for each ``key``."""
    return _pick(df, key, order, values, latest=False)
