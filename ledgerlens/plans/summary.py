"""P5: raw logs -> the locked 18-column agent summary; A5 / P14 sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AGENT_SUMMARY_SCHEMA, DEFAULT_CONFIG, SUMMARY_COLUMNS, ScoreConfig
from ..operators.decode import decode_feedback, decode_identity, decode_revocations, drop_revoked
from ..operators.rank import rank_agents
from ..operators.score import aggregate_agents, as_of_col, score_agents, score_feedback


def scored_agents(logs: DataFrame, cfg: ScoreConfig = DEFAULT_CONFIG, revocations: bool = True) -> DataFrame:
    """P2 + P3 + C3 + P4 (unranked)."""
    agents = decode_identity(logs, cfg.since)
    feedback = decode_feedback(logs, cfg.since)
    if revocations:
        feedback = drop_revoked(feedback, decode_revocations(logs, cfg.since))
    agg = aggregate_agents(score_feedback(feedback, cfg))
    return score_agents(agents, agg, cfg)


def build_agent_summary(logs: DataFrame, cfg: ScoreConfig = DEFAULT_CONFIG, revocations: bool = True,
                        partitions: int | None = None) -> DataFrame:
    """P5: decode, dedupe, score, rank; x402 starts false (enrichment fills it);
    computed_at is the snapshot instant."""
    ranked = rank_agents(scored_agents(logs, cfg, revocations), partitions)
    out = ranked.select(
        *[c for c in SUMMARY_COLUMNS if c not in ("rank", "x402", "computed_at")],
        "rank",
        F.lit(False).alias("x402"),
        as_of_col(cfg).alias("computed_at"),
    ).select(*SUMMARY_COLUMNS)
    assert_summary_schema(out)
    return out


def assert_summary_schema(df: DataFrame) -> None:
    got = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in AGENT_SUMMARY_SCHEMA.fields]
    if got != want:
        raise ValueError(f"agent summary schema drifted: {got} != {want}")
