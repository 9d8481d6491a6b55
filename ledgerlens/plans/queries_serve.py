"""Serving queries over the summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF, DEFAULT_CONFIG
from ..operators import serve as S
from ..plans.summary import build_agent_summary, scored_agents
from . import oracle as O
from .catalog import logs, serving_query

CFG = DEFAULT_CONFIG


def summary(spark, sf):
    return build_agent_summary(logs(spark, sf), CFG)


def unranked(spark, sf):
    """The same rows without a rank, for statistics: no global sort, no checkpoint."""
    return (scored_agents(logs(spark, sf), CFG)
            .withColumn("x402", F.lit(False)).withColumn("computed_at", F.lit(AS_OF).cast("timestamp")))


@serving_query("list_rank_page", O.with_summary("SELECT * FROM summary ORDER BY rank LIMIT 50"), summary)
def list_rank_page(spark, s):
    """P6 default: first page (50) in rank order."""
    return S.list_agents(s, S.ListRequest())


@serving_query("list_rated_reputation", O.with_summary("""SELECT * FROM summary WHERE feedback_count > 0
ORDER BY reputation_score DESC, feedback_count DESC, rank LIMIT 200 OFFSET 10"""), summary)
def list_rated_reputation(spark, s):
    """Rated only, sort=reputation, limit=500 (clamped to 200), offset=10."""
    return S.list_agents(s, S.ListRequest(rated=True, sort="reputation", limit="500", offset="10"))


@serving_query("list_search_feedback", O.with_summary("""SELECT * FROM summary
WHERE CAST(agent_id AS VARCHAR) LIKE '%example.org/agent/1%'
   OR lower(owner_address) LIKE '%example.org/agent/1%'
   OR COALESCE(lower(token_uri) LIKE '%example.org/agent/1%', false)
ORDER BY feedback_count DESC, reputation_score DESC, rank LIMIT 50"""), summary)
def list_search_feedback(spark, s):
    """Search (trimmed, case-folded), sort=feedback, junk limit -> 50, offset -1 -> 0."""
    req = S.ListRequest(q="  Example.ORG/Agent/1 ", sort="feedback", limit="junk", offset="-1")
    return S.list_agents(s, req)


@serving_query("list_owner_search", O.with_summary("""SELECT * FROM summary
WHERE CAST(agent_id AS VARCHAR) LIKE '%0000000004%' OR lower(owner_address) LIKE '%0000000004%'
   OR COALESCE(lower(token_uri) LIKE '%0000000004%', false)
ORDER BY rank LIMIT 200"""), summary)
def list_owner_search(spark, s):
    """Search by owner-address fragment, limit 200."""
    return S.list_agents(s, S.ListRequest(q="0000000004", limit=200))


@serving_query("list_recent_page", O.with_summary("""SELECT * FROM summary
ORDER BY last_activity_at DESC, rank LIMIT 25 OFFSET 100"""), summary)
def list_recent_page(spark, s):
    """sort=recency (UI spelling, treated as recent), limit 25, offset 100."""
    return S.list_agents(s, S.ListRequest(sort="recency", limit=25, offset=100))


@serving_query("list_unknown_sort", O.with_summary("SELECT * FROM summary ORDER BY rank LIMIT 1 OFFSET 3"), summary)
def list_unknown_sort(spark, s):
    """S3: unknown sort mode falls back to rank; limit -5 -> 1."""
    return S.list_agents(s, S.ListRequest(sort="bogus", limit="-5", offset="3"))


@serving_query("list_x402_filter", O.with_summary("SELECT * FROM summary WHERE x402 ORDER BY rank LIMIT 50"), summary)
def list_x402_filter(spark, s):
    """x402 filter on the freshly built summary (placeholder false -> empty)."""
    return S.list_agents(s, S.ListRequest(x402=True))


@serving_query("list_envelope", O.with_summary("""SELECT 'live' AS source, max(computed_at) AS computed_at,
  CAST(count(*) AS BIGINT) AS total,
  CAST(greatest(0, least(50, count(*) - 100)) AS BIGINT) AS count,
  (100 + greatest(0, least(50, count(*) - 100)) < count(*)) AS has_more
FROM summary WHERE feedback_count > 0"""), summary)
def list_envelope(spark, s):
    """Total / count / has_more for rated agents, page 3 of 50."""
    return S.list_envelope(s, S.ListRequest(rated=True, limit=50, offset=100))


@serving_query("stats_kpis", O.with_summary("""SELECT CAST(count(*) AS BIGINT) AS total_agents,
  CAST(count(*) FILTER (WHERE feedback_count > 0) AS BIGINT) AS rated_agents,
  CAST(count(token_uri) AS BIGINT) AS with_token_uri,
  CAST(count(*) FILTER (WHERE x402) AS BIGINT) AS x402_count,
  CAST(COALESCE(sum(feedback_count), 0) AS BIGINT) AS total_feedback,
  COALESCE(greatest(max(reputation_score), 0.0), 0.0) AS top_score,
  COALESCE(CAST(round(CAST(avg(reputation_score) AS DECIMAL(38,9)), 2) AS DOUBLE), 0.0) AS avg_score
FROM summary"""), unranked)
def stats_kpis(spark, s):
    """Network KPIs."""
    return S.network_kpis(s)


HIST_SQL = """labels AS (
  SELECT CAST(b AS BIGINT) AS bucket, (b * 10) || '-' || (b * 10 + 10) AS label FROM range(10) t(b)),
counts AS (
  SELECT CAST(least(floor(reputation_score / 10), 9) AS BIGINT) AS bucket, count(*) AS n
  FROM summary WHERE reputation_score >= 0 AND reputation_score <= 100 GROUP BY 1)"""


@serving_query("stats_histogram", O.with_summary(f""", {HIST_SQL}
SELECT l.bucket, l.label, CAST(COALESCE(c.n, 0) AS BIGINT) AS agents
FROM labels l LEFT JOIN counts c USING (bucket)""").replace("summary AS (", "summary AS (", 1), unranked)
def stats_histogram(spark, s):
    """Score histogram, all ten buckets."""
    return S.score_histogram(s)


SERIES_SQL = """series AS (
  SELECT strftime(registered_at, '%Y-%m-%d') AS date, CAST(count(*) AS BIGINT) AS count
  FROM summary WHERE registered_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 90 DAY GROUP BY 1)"""


@serving_query("stats_series", O.with_summary(f", {SERIES_SQL}\nSELECT * FROM series"), unranked)
def stats_series(spark, s):
    """Daily registrations over the last 90 days."""
    return S.activity_series(s, AS_OF)


@serving_query("network_stats", O.with_summary(f""", {HIST_SQL}, {SERIES_SQL},
kpi AS (
  SELECT CAST(count(*) AS BIGINT) AS total_agents,
    CAST(count(*) FILTER (WHERE feedback_count > 0) AS BIGINT) AS rated_agents,
    CAST(count(token_uri) AS BIGINT) AS with_token_uri,
    CAST(count(*) FILTER (WHERE x402) AS BIGINT) AS x402_count,
    CAST(COALESCE(sum(feedback_count), 0) AS BIGINT) AS total_feedback,
    COALESCE(greatest(max(reputation_score), 0.0), 0.0) AS top_score,
    COALESCE(CAST(round(CAST(avg(reputation_score) AS DECIMAL(38,9)), 2) AS DOUBLE), 0.0) AS avg_score,
    max(computed_at) AS computed_at
  FROM summary),
hist AS (
  SELECT '{{' || string_agg('"' || l.label || '":' || COALESCE(c.n, 0), ',' ORDER BY l.bucket) || '}}' AS score_distribution
  FROM labels l LEFT JOIN counts c USING (bucket)),
ser AS (
  SELECT COALESCE('[' || string_agg('{{"date":"' || date || '","count":' || count || '}}', ',' ORDER BY date) || ']', '[]') AS activity_series
  FROM series)
SELECT 'live' AS source, kpi.*, hist.score_distribution, ser.activity_series FROM kpi, hist, ser"""), unranked)
def network_stats(spark, s):
    """The stats document (histogram and series as JSON text)."""
    return S.stats_document_json(s, AS_OF)


TIER_CASE = """CASE WHEN reputation_score >= 70 THEN 'high (>=70)'
            WHEN reputation_score >= 40 THEN 'medium (40-70)' ELSE 'low (<40)' END"""


@serving_query("tier_summary", O.with_summary(f"""SELECT {TIER_CASE} AS tier, CAST(count(*) AS BIGINT) AS agents,
  CAST(round(CAST(avg(feedback_count) AS DECIMAL(38,9)), 1) AS DOUBLE) AS avg_feedbacks FROM summary GROUP BY 1"""), unranked)
def tier_summary(spark, s):
    """Agents per score tier."""
    return S.tier_summary(s)


@serving_query("viz_sample", O.with_summary("""SELECT agent_id, rank, reputation_score, feedback_count, last_activity_at,
  round(d, 6) AS age_days, (feedback_count > 0 AND d < 7) AS recent,
  round(CASE WHEN feedback_count > 0 THEN least(2.0 + 4.0 * log10(feedback_count + 1), 12.0) ELSE 1.5 END, 6) AS size,
  round(CASE WHEN reputation_score >= 70 THEN 45.0 + (reputation_score - 70) * (165.0 / 30.0)
             WHEN reputation_score >= 40 THEN 10.0 + (reputation_score - 40) * (35.0 / 30.0)
             ELSE 350.0 + (reputation_score - 0) * (-340.0 / 40.0) END, 6) AS hue,
  CASE WHEN feedback_count > 0 THEN 90 ELSE 45 END AS saturation,
  CASE WHEN feedback_count > 0 THEN 95 ELSE 60 END AS brightness
FROM (SELECT *, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(last_activity_at)) / 86400000000.0 AS d
      FROM summary ORDER BY (feedback_count > 0) DESC, rank LIMIT 500)"""), summary)
def viz_sample(spark, s):
    """Rated-first sample of 500 with node features."""
    return S.viz_sample(s, AS_OF)


@serving_query("agent_cards", O.with_summary("""SELECT agent_id, rank,
  CASE WHEN reputation_score >= 70 THEN 'high (>=70)' WHEN reputation_score >= 40 THEN 'medium (40-70)' ELSE 'low (<40)' END AS tier,
  left(owner_address, 6) || '…' || right(owner_address, 4) AS owner_short,
  left(registered_tx, 10) || '…' || right(registered_tx, 8) AS tx_short,
  CASE WHEN t > 0 THEN CAST(floor((positive_count / t) * 100.0 + 0.5) AS BIGINT) END AS positive_pct,
  CASE WHEN t > 0 THEN CAST(floor((neutral_count / t) * 100.0 + 0.5) AS BIGINT) END AS neutral_pct,
  CASE WHEN t > 0 THEN CAST(floor((negative_count / t) * 100.0 + 0.5) AS BIGINT) END AS negative_pct,
  CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN '1d ago' WHEN d < 30 THEN CAST(d AS VARCHAR) || 'd ago'
       WHEN floor(d / 30) < 12 THEN CAST(CAST(floor(d / 30) AS BIGINT) AS VARCHAR) || 'mo ago'
       ELSE CAST(CAST(floor(floor(d / 30) / 12) AS BIGINT) AS VARCHAR) || 'y ago' END AS last_active,
  CASE WHEN starts_with(token_uri, 'ipfs://') THEN 'https://ipfs.io/ipfs/' || substr(token_uri, 8) ELSE token_uri END AS token_link,
  'https://etherscan.io/tx/' || registered_tx AS tx_link,
  'https://etherscan.io/address/' || owner_address AS owner_link
FROM (SELECT *, CAST(positive_count + neutral_count + negative_count AS DOUBLE) AS t,
             CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(last_activity_at)) / 86400000000.0) AS BIGINT) AS d
      FROM summary)"""), summary)
def agent_cards(spark, s):
    """Display fields for every agent."""
    return S.agent_cards(s, AS_OF)


SNAPSHOT_SQL = """SELECT agent_id AS agentId, lower(owner_address) AS ownerAddress, token_uri AS tokenURI,
  registered_at AS registeredAt, registered_tx AS registeredTx, feedback_count AS feedbackCount,
  unique_clients AS uniqueClients,
  '{"positive":' || positive_count || ',"neutral":' || neutral_count || ',"negative":' || negative_count || '}' AS scoreBreakdown,
  avg_raw_score AS avgRawScore, reputation_score AS reputationScore, effective_feedback AS effectiveFeedback,
  last_feedback_at AS lastFeedbackAt, last_activity_at AS lastActivityAt, rank, x402, computed_at AS computedAt
FROM summary"""


def _snapshot_json_breakdown(df):
    return df.withColumn("scoreBreakdown", F.to_json("scoreBreakdown"))


@serving_query("snapshot_rows", O.with_summary(SNAPSHOT_SQL), summary)
def snapshot_rows(spark, s):
    """camelCase API rows for the full snapshot (breakdown as JSON text)."""
    return _snapshot_json_breakdown(S.snapshot_rows(s))


@serving_query("snapshot_sample", O.with_summary(SNAPSHOT_SQL + " ORDER BY rank LIMIT 50"), summary)
def snapshot_sample(spark, s):
    """The top-50 sample file rows."""
    return _snapshot_json_breakdown(S.snapshot_rows(s).orderBy("rank").limit(50))


@serving_query("list_deep_page", O.with_summary("""SELECT * FROM summary
ORDER BY feedback_count DESC, reputation_score DESC, rank LIMIT 100 OFFSET 1000"""), summary)
def list_deep_page(spark, s):
    """S4 deep page, in order."""
    return S.list_agents(s, S.ListRequest(sort="feedback", limit=100, offset=1000))
