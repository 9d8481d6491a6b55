"""Decode -> score -> rank -> summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..operators import decode as D
from ..operators.score import aggregate_agents, score_feedback
from ..plans.summary import build_agent_summary, scored_agents
from . import oracle as O
from .catalog import logs, register

CFG = DEFAULT_CONFIG


@register("identity_decode", f"WITH {O.AGENTS} SELECT * FROM agents")
def identity_decode(spark, sf):
    """One row per registered agent with its resolved token URI."""
    return D.decode_identity(logs(spark, sf, mints=False))


@register("first_registration", f"""WITH {O.REG}
SELECT agent_id, owner_address, reg_uri, registered_at, registered_tx FROM reg""")
def first_registration(spark, sf):
    """Earliest Registered event per agent."""
    return D.first_registrations(logs(spark, sf, mints=False))


@register("latest_uri", f"WITH {O.LATEST} SELECT agent_id, new_uri FROM latest")
def latest_uri(spark, sf):
    """Newest URIUpdated per agent."""
    return D.latest_uris(logs(spark, sf, mints=False))


@register("feedback_decode", f"WITH {O.FEEDBACK} SELECT * FROM fb")
def feedback_decode(spark, sf):
    """Decoded NewFeedback rows."""
    return D.decode_feedback(logs(spark, sf, mints=False))


@register("feedback_decode_signed", f"""WITH fb AS (
  SELECT user_id AS agent_id, '0x' || sha1(event_type) AS client_address, event_id AS feedback_index,
         CASE WHEN event_type = 'error' THEN -round(value * 100) ELSE round(value * 100) END AS raw_value,
         CAST(2 AS BIGINT) AS value_decimals,
         CASE WHEN event_type = 'error' THEN -round(value * 100) ELSE round(value * 100) END / 100.0::DOUBLE AS score,
         CAST(ts AS TIMESTAMP) AS created_at, '0x' || sha256('fb:' || event_id) AS feedback_tx
  FROM events)
SELECT * FROM fb""")
def feedback_decode_signed(spark, sf):
    """int128 sign path - 'error' feedback carries negative values."""
    return D.decode_feedback(logs(spark, sf, signed=True, mints=False))


@register("feedback_scored", f"""WITH {O.VOTES}
SELECT voted_for AS agent_id, voter AS client_address, cast_at AS created_at, quality AS q, round(weight, 12) AS w FROM votes""")
def feedback_scored(spark, sf):
    """Normalised quality q and recency weight w per feedback."""
    s = score_feedback(D.decode_feedback(logs(spark, sf, mints=False)), CFG)
    return s.withColumn("w", F.round("w", 12))


@register("agent_agg", f"""WITH {O.TALLY}
SELECT voted_for AS agent_id, n AS feedback_count, voters AS unique_clients, total_weight AS eff_n,
       total_quality / total_weight AS wq, latest AS last_feedback_at, good AS positive_count,
       n - good - bad AS neutral_count, bad AS negative_count, total_cents / (100.0::DOUBLE * n) AS avg_raw_score
FROM tally""")
def agent_agg(spark, sf):
    """Per-agent aggregate of scored feedback."""
    agg = aggregate_agents(score_feedback(D.decode_feedback(logs(spark, sf, mints=False)), CFG))
    return agg.withColumn("avg_raw_score", F.col("avg_raw_score").cast("double"))


@register("agent_score", f"WITH {O.SCORED_AGENTS} SELECT * FROM scored")
def agent_score(spark, sf):
    """Every registered agent with its shrunk reputation score (unranked)."""
    return scored_agents(logs(spark, sf, mints=False), CFG)


@register("agent_summary", O.with_summary("SELECT * FROM summary"))
def agent_summary(spark, sf):
    """P5: the locked 18-column summary with global rank (flagship)."""
    return build_agent_summary(logs(spark, sf), CFG)


@register("agent_summary_revoked", O.SUMMARY_REVOKED)
def agent_summary_revoked(spark, sf):
    """Summary after FeedbackRevoked events remove every 50th feedback."""
    return build_agent_summary(logs(spark, sf, revocations=True), CFG)


@register("event_census", """SELECT contract, event, CAST(n AS BIGINT) AS n FROM (
  SELECT 'IdentityRegistry' AS contract, 'Registered' AS event, count(*) AS n FROM customer
  UNION ALL SELECT 'IdentityRegistry', 'Transfer', count(*) FROM customer WHERE c_custkey % 41 <> 7
  UNION ALL SELECT 'IdentityRegistry', 'URIUpdated', count(*) FROM pages
  UNION ALL SELECT 'ReputationRegistry', 'NewFeedback', count(*) FROM events
  UNION ALL SELECT 'ReputationRegistry', 'FeedbackRevoked', count(*) FROM events WHERE event_id % 50 = 0)""")
def event_census(spark, sf):
    """Logs per (contract, event) over the whole log table."""
    return D.event_census(spark, logs(spark, sf, revocations=True))


@register("mint_crosscheck", """SELECT c_custkey AS agent_id, true AS registered, (c_custkey % 41 <> 7) AS minted
FROM customer""")
def mint_crosscheck(spark, sf):
    """Registrations vs ERC-721 mints, per agent id."""
    return D.mint_crosscheck(logs(spark, sf))


@register("mint_crosscheck_counts", """SELECT CAST(count(*) AS BIGINT) AS registered,
  CAST(count(*) FILTER (WHERE c_custkey % 41 <> 7) AS BIGINT) AS minted,
  CAST(count(*) FILTER (WHERE c_custkey % 41 = 7) AS BIGINT) AS registered_not_minted,
  CAST(0 AS BIGINT) AS minted_not_registered
FROM customer""")
def mint_crosscheck_counts(spark, sf):
    """G18 summary counts."""
    return D.crosscheck_counts(D.mint_crosscheck(logs(spark, sf)))
