"""Global rank (W3) without a single-partition window.

``rank_by_counting`` ranks a stored table. Agents fall into cells of equal
score, feedback count, registration time and block of ids, which follow each
other in rank order. A cell's base is the number of agents in the cells before
it, summed up in three steps (tenths of a score, days, times and blocks) from a
histogram of the cells, and a rank is base + position in the cell. Nothing is
sampled, checkpointed or collected, so building the plan runs no job.
Histograms add up: a changed agent moves a count from one cell to another
(``merge_cells``) and only these two cells are numbered again
(``refresh_positions``). The table must be stored, as it is read twice.

``rank_agents`` and ``global_row_number`` number a plan by any order. ``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row into
one task. Here the rows are range-partitioned on the sort keys and sorted
inside each partition; the sorted frame is checkpointed (reliable, in the
shared checkpoint folder) so both passes see identical partitions even if an
executor is lost; per-partition row counts (one row per partition) are
prefix-summed and broadcast back; rank = partition offset + position.
The broadcast side holds exactly one row per partition, a proven bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir



def rank_order() -> list[Column]:
    """Score desc, feedback count desc, newest registration first; agent_id
    makes the order total so ranks are deterministic."""
    return [
        F.col("reputation_score").desc(),
        F.col("feedback_count").desc(),
        F.col("registered_at").desc(),
        F.col("agent_id").asc_nulls_last(),
    ]


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank",
                      partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_dir(spark)
    # Without an explicit count AQE may coalesce adjacent range partitions,
    # which keeps them in key order; the partition id is read afterwards.
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    sorted_df = (ranged
                   .sortWithinPartitions(*order)
                   .withColumn("_pid", F.spark_partition_id())
                   .withColumn("_mid", F.monotonically_increasing_id())
                   .checkpoint(eager=True))
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (sorted_df.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_base") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_first", "_base"))


BLOCK_BITS = 16  # ids that share a block: bounds a cell where everything but the id is equal
_STEP, _DAY = ["_step"], ["_step", "reputation_score", "feedback_count", "_day"]
CELL = [*_DAY, "registered_at", "_block"]
_LAST = (1 << 63) - 1


def with_cells(scored: DataFrame) -> DataFrame:
    """The columns that name an agent's cell."""
    return scored.withColumns({
        "_step": F.floor(F.col("reputation_score") * 10),
        "_day": F.to_date("registered_at"),
        "_block": F.coalesce(F.shiftright("agent_id", BLOCK_BITS), F.lit(_LAST)),
    })


def cell_histogram(scored: DataFrame) -> DataFrame:
    """(cell, n): agents per cell."""
    return with_cells(scored).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


def merge_cells(*histograms: DataFrame) -> DataFrame:
    """The sum of histograms; counts of agents that left a cell are negative."""
    rows = histograms[0]
    for h in histograms[1:]:
        rows = rows.unionByName(h)
    return rows.groupBy(*CELL).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def cell_bases(histogram: DataFrame) -> DataFrame:
    """(cell, base): the number of agents in all cells before each one."""
    def before(over: list[str], *order: Column):
        return F.coalesce(F.sum("n").over(Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = histogram.groupBy(*_DAY).agg(F.sum("n").alias("n"))
    steps = days.groupBy(*_STEP).agg(F.sum("n").alias("n"))
    # Scores lie between 0 and 100: at most 1,001 steps.
    steps = steps.select("_step", before([], F.col("_step").desc()).alias("_before_step"))
    days = days.select(*_DAY, before(_STEP, F.col("reputation_score").desc(), F.col("feedback_count").desc(), F.col("_day").desc()).alias("_before_day"))
    cells = histogram.select(*CELL, before(_DAY, F.col("registered_at").desc(), F.col("_block").asc()).alias("_before_cell"))
    return (cells.join(days, _DAY).join(F.broadcast(steps), _STEP)
            .select(*CELL, (F.col("_before_step") + F.col("_before_day") + F.col("_before_cell")).alias("base")))


def positions(scored: DataFrame) -> DataFrame:
    """Agents with their cell and ``position`` in it, from 1."""
    here = Window.partitionBy(*CELL).orderBy(F.col("agent_id").asc_nulls_last())
    return with_cells(scored).withColumn("position", F.row_number().over(here))


def apply_bases(placed: DataFrame, bases: DataFrame) -> DataFrame:
    """``positions`` and ``cell_bases`` -> rows with their global rank."""
    return placed.join(bases, CELL).withColumn("rank", (F.col("base") + F.col("position")).cast("bigint")).drop("position", "base", "_step", "_day", "_block")


def refresh_positions(placed: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace agents in a stored ``positions`` table: ``changed`` has the new rows of some agents (both stored).

    Returns (rows of untouched cells, newly numbered rows of touched cells, histogram delta)."""
    ids = changed.select("agent_id")
    rows = placed.columns
    plain = [c for c in rows if c not in ("_step", "_day", "_block", "position")]
    gone = placed.join(ids, "agent_id", "left_semi")
    delta = merge_cells(gone.groupBy(*CELL).agg((-F.count(F.lit(1))).alias("n")), cell_histogram(changed))
    touched = gone.select(*CELL).unionByName(with_cells(changed).select(*CELL)).distinct()
    same = placed.join(touched, CELL, "left_anti").select(*rows)
    again = placed.join(touched, CELL, "left_semi").join(ids, "agent_id", "left_anti").select(*plain)
    return same, positions(again.unionByName(changed.select(*plain))).select(*rows), delta


def rank_by_counting(stored: DataFrame) -> DataFrame:
    """W3 over a stored table: 1-based global rank by ``rank_order``."""
    return apply_bases(positions(stored), cell_bases(cell_histogram(stored)))


def rank_agents(scored: DataFrame, partitions: int | None = None) -> DataFrame:
    """1-based global rank by ``rank_order``."""
    return global_row_number(scored, rank_order(), "rank", partitions)
