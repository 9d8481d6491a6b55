"""Recency-weighted, confidence-shrunk reputation score.

The per-agent aggregate runs in two combinable levels: first per
(agent, client), then per agent. Every measure is a sum / count / max, so both
levels aggregate map-side before their shuffle; the first shuffle is keyed by
(agent, client), which spreads a hot agent over its clients, and the second
sees at most one row per (agent, client, task). The exact distinct-client
count is simply the number of level-one groups. The same (agent, client)
partial state is what the incremental refresh keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG, ScoreConfig
from ..functions.scoring import (
    clamp01,
    decay_weight,
    is_negative,
    is_neutral,
    is_positive,
    round_half_up,
    shrunk_score,
)


def as_of_col(cfg: ScoreConfig):
    """The snapshot instant as a session-time-zone (UTC) timestamp literal.
    Built from text: a naive datetime literal would be read in the driver
    machine's local zone."""
    return F.lit(cfg.as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def score_feedback(feedback: DataFrame, cfg: ScoreConfig = DEFAULT_CONFIG) -> DataFrame:
    """Feedback -> (agent_id, client_address, created_at, q, w)."""
    return feedback.select(
        "agent_id", "client_address", "created_at",
        clamp01(F.col("score") / F.lit(100.0)).alias("q"),
        decay_weight(as_of_col(cfg), "created_at", cfg.half_life_days).alias("w"),
    )


def client_partials(scored: DataFrame) -> DataFrame:
    """Level one: mergeable measures per (agent, client)."""
    q = F.col("q")
    return scored.groupBy("agent_id", "client_address").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("sw"),
        F.sum(F.col("w") * q).alias("swq"),
        # cents and the like are exact decimals: their sum does not depend on the order
        F.sum((q * F.lit(100.0)).cast("decimal(20,9)")).alias("sq100"),
        F.count(q).alias("nq"),
        F.max("created_at").alias("last_at"),
        F.count_if(is_positive(q)).alias("pos"),
        F.count_if(is_neutral(q)).alias("neu"),
        F.count_if(is_negative(q)).alias("neg"),
    )


def agent_partials(partials: DataFrame) -> DataFrame:
    """Level two: fold client partials into one row per agent."""
    sw = F.sum("sw")
    return partials.groupBy("agent_id").agg(
        F.sum("n").cast("bigint").alias("feedback_count"),
        F.count("client_address").cast("bigint").alias("unique_clients"),
        sw.alias("eff_n"),
        F.try_divide(F.sum("swq"), F.nullif(sw, F.lit(0.0))).alias("wq"),
        F.max("last_at").alias("last_feedback_at"),
        F.sum("pos").cast("bigint").alias("positive_count"),
        F.sum("neu").cast("bigint").alias("neutral_count"),
        F.sum("neg").cast("bigint").alias("negative_count"),
        F.try_divide(F.sum("sq100"), F.sum("nq")).alias("avg_raw_score"),
    )


def aggregate_agents(scored: DataFrame) -> DataFrame:
    """G1: per-agent aggregate of scored feedback."""
    return agent_partials(client_partials(scored))


def score_agents(agents: DataFrame, agg: DataFrame, cfg: ScoreConfig = DEFAULT_CONFIG) -> DataFrame:
    """Registered agents (left) joined to their aggregate; feedback for
    unregistered ids is dropped, agents without feedback score exactly 50."""
    zero = F.lit(0).cast("bigint")
    return agents.join(agg, "agent_id", "left").select(
        "agent_id", "owner_address", "token_uri", "registered_at", "registered_tx",
        F.coalesce("feedback_count", zero).alias("feedback_count"),
        F.coalesce("unique_clients", zero).alias("unique_clients"),
        F.coalesce("positive_count", zero).alias("positive_count"),
        F.coalesce("neutral_count", zero).alias("neutral_count"),
        F.coalesce("negative_count", zero).alias("negative_count"),
        round_half_up("avg_raw_score", 2).alias("avg_raw_score"),
        shrunk_score("eff_n", "wq", cfg.k_prior, cfg.prior_q).alias("reputation_score"),
        round_half_up(F.coalesce(F.col("eff_n"), F.lit(0.0)), 4).alias("effective_feedback"),
        "last_feedback_at",
        F.greatest(F.col("registered_at"), F.coalesce(F.col("last_feedback_at"), F.col("registered_at"))).alias("last_activity_at"),
    )
