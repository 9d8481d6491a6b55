"""Metadata enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF, DEFAULT_CONFIG
from ..operators import decode as D
from ..operators import metadata as M
from ..plans.summary import build_agent_summary
from ..sources.fixtures import data_uris, metadata_documents
from . import oracle as O
from .catalog import logs, register

CFG = DEFAULT_CONFIG


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def identity(spark, sf):
    return D.decode_identity(logs(spark, sf, mints=False))


def summary(spark, sf):
    return build_agent_summary(logs(spark, sf), CFG)


def records(spark, sf, targets):
    return M.fetch_metadata(targets, metadata_documents(spark, sf), as_of()).drop("raw")


@register("metadata_records", f"""WITH {O.AGENTS}, {O.META}
SELECT token_uri, resolved_uri, x402, name, description, {O.AS_OF} AS fetched_at, error FROM meta""")
def metadata_records(spark, sf):
    """Metadata record for every distinct agent token URI."""
    return records(spark, sf, identity(spark, sf))


@register("metadata_batch", f"""WITH {O.AGENTS}, {O.META}
SELECT a.agent_id, COALESCE(a.token_uri, '') AS token_uri, COALESCE(m.x402, false) AS x402,
       CASE WHEN a.token_uri IS NULL THEN 'no tokenURI' ELSE m.error END AS error
FROM agents a LEFT JOIN meta m ON a.token_uri = m.token_uri""")
def metadata_batch(spark, sf):
    """K4: batch enrich over every agent, one result per agent."""
    items = identity(spark, sf).select("agent_id", "token_uri")
    return M.batch_enrich(items, metadata_documents(spark, sf), as_of())


@register("data_uri_metadata", f"""SELECT conv_id, turn,
  CASE WHEN turn % 7 = 6 THEN false ELSE ((conv_id * 1000 + turn) % 12 {O.X402_RULE} OR lower(text) LIKE '%x402%') END AS x402,
  CASE WHEN turn % 7 = 6 THEN NULL ELSE role || '-' || conv_id || '-' || turn END AS name,
  CASE WHEN turn % 7 = 6 THEN NULL ELSE NULLIF(trim(text), '') END AS description,
  CASE WHEN turn % 7 = 6 THEN 'Failed to parse data: URI' END AS error
FROM conversations""")
def data_uri_metadata(spark, sf):
    """Inline data: URIs (base64 and percent forms) for every conversation turn."""
    uris = data_uris(spark, sf)
    meta = M.fetch_metadata(uris.select(F.col("uri").alias("token_uri")), metadata_documents(spark, sf), as_of())
    return (uris.join(meta, uris.uri == meta.token_uri, "left")
            .select("conv_id", "turn", "x402", "name", "description", "error"))


TARGETS = """targets AS (SELECT s.agent_id, s.rank, s.token_uri FROM summary s
                WHERE s.token_uri IS NOT NULL)"""


def _summary_with_meta() -> str:
    return O.with_summary(f""", {O.DOCMETA.replace('docmeta AS', 'docmeta AS', 1)},
agents2 AS (SELECT * FROM agents),
{TARGETS},
tmeta AS (
  SELECT t.agent_id, t.rank, t.token_uri, COALESCE(m.x402, false) AS x402,
         CASE WHEN m.resolved_uri IS NULL THEN 'HTTP 404 Not Found' ELSE m.error END AS error
  FROM targets t LEFT JOIN docmeta m
    ON m.resolved_uri = CASE WHEN starts_with(t.token_uri, 'ipfs://') THEN 'https://ipfs.io/ipfs/' || substr(t.token_uri, 8)
                             ELSE t.token_uri END)""")


@register("enrich_top", _summary_with_meta() + """
SELECT s.agent_id, s.owner_address, s.token_uri, s.registered_at, s.registered_tx, s.feedback_count,
       s.unique_clients, s.positive_count, s.neutral_count, s.negative_count, s.avg_raw_score,
       s.reputation_score, s.effective_feedback, s.last_feedback_at, s.last_activity_at, s.rank,
       COALESCE(t.x402, s.x402) AS x402, s.computed_at
FROM summary s LEFT JOIN tmeta t USING (agent_id)""")
def enrich_top(spark, sf):
    """P9 + C4: enrich every agent (empty cache) and write the flags back."""
    s = summary(spark, sf)
    results, _ = M.enrich_metadata(s, metadata_documents(spark, sf), M.empty_cache(spark), as_of())
    return M.apply_x402(s, results)


@register("enrich_changes", _summary_with_meta() + """
SELECT CAST(count(*) AS BIGINT) AS changed FROM tmeta WHERE x402""")
def enrich_changes(spark, sf):
    """C4: how many flags the run changes."""
    s = summary(spark, sf)
    results, _ = M.enrich_metadata(s, metadata_documents(spark, sf), M.empty_cache(spark), as_of())
    return M.x402_changes(s, results)


@register("enrich_run_summary", _summary_with_meta() + """
SELECT CAST(count(*) AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE rank <= 100 AND error IS NULL) AS BIGINT) AS from_cache,
       CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS errors,
       CAST(count(*) FILTER (WHERE x402) AS BIGINT) AS x402_found
FROM tmeta""")
def enrich_run_summary(spark, sf):
    """A run over a cache warmed 30 minutes earlier for the
    top 100 (ok entries still fresh, error entries expired and refetched)."""
    s = summary(spark, sf)
    docs = metadata_documents(spark, sf)
    earlier = as_of() - F.expr("INTERVAL 30 MINUTES")
    warm = M.fetch_metadata(M.enrich_targets(s, 100), docs, earlier).select(*M.METADATA_COLUMNS)
    results, _ = M.enrich_metadata(s, docs, warm, as_of())
    return M.run_summary(results)


STAGGER = "(a.agent_id % 90)"


def _staggered_cache(spark, sf):
    """Metadata cache for every agent URI, fetched (agent_id % 90) minutes before as_of."""
    ident = identity(spark, sf).where(F.col("token_uri").isNotNull()).select("agent_id", "token_uri")
    meta = records(spark, sf, ident)
    return (ident.join(meta.drop("fetched_at"), "token_uri")
            .withColumn("fetched_at", as_of() - F.make_dt_interval(mins=F.col("agent_id") % 90)))


@register("metadata_freshness", f"""WITH {O.AGENTS}, {O.META}
SELECT a.agent_id, a.token_uri, m.error,
       {O.AS_OF} - to_minutes(CAST({STAGGER} AS INTEGER)) AS fetched_at,
       {O.AS_OF} - to_minutes(CAST({STAGGER} AS INTEGER))
         + to_seconds(CASE WHEN m.error IS NULL THEN 3600 ELSE 300 END) AS expires_at,
       ({STAGGER} * 60 <= CASE WHEN m.error IS NULL THEN 3600 ELSE 300 END) AS fresh
FROM agents a JOIN meta m ON a.token_uri = m.token_uri""")
def metadata_freshness(spark, sf):
    """K1: expiry and freshness of every cache entry at as_of."""
    c = _staggered_cache(spark, sf)
    return c.select("agent_id", "token_uri", "error", "fetched_at",
                    M.expires_at(F.col("fetched_at"), F.col("error")).alias("expires_at"),
                    M.is_fresh(c, as_of()).alias("fresh"))


@register("metadata_refetch", f"""WITH {O.AGENTS}, {O.META}
SELECT a.agent_id, a.token_uri
FROM agents a JOIN meta m ON a.token_uri = m.token_uri
WHERE {STAGGER} * 60 > CASE WHEN m.error IS NULL THEN 3600 ELSE 300 END""")
def metadata_refetch(spark, sf):
    """K2 / K3: agents whose cached metadata has expired and must be refetched."""
    c = _staggered_cache(spark, sf)
    targets = identity(spark, sf).where(F.col("token_uri").isNotNull()).select("agent_id", "token_uri")
    return M.refetch_candidates(targets, c.select("token_uri", "fetched_at", "error"), as_of())
