"""Whole runs: point lookup, materialized and exported summaries, caches over two runs, presentation order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import DEFAULT_CONFIG
from ..operators import decode as D
from ..operators import metadata as M
from ..operators import serve as S
from ..operators.rank import global_row_number
from ..session import checkpoint_dir
from ..sources import snapshot as SN
from ..sources.fixtures import metadata_documents
from ..sources.logs import read_bronze, write_bronze
from . import oracle as O
from .catalog import logs, register
from .queries_meta import _summary_with_meta, as_of, summary
from .queries_serve import SNAPSHOT_SQL

LOOKUPS = ["7", "0", "149", "12abc", "999999999", "9223372036854775808", "-1", "x", ""]
SUMMARY_LIST = """s.agent_id, s.owner_address, s.token_uri, s.registered_at, s.registered_tx, s.feedback_count,
       s.unique_clients, s.positive_count, s.neutral_count, s.negative_count, s.avg_raw_score,
       s.reputation_score, s.effective_feedback, s.last_feedback_at, s.last_activity_at, s.rank"""
ENRICHED = _summary_with_meta() + f""",
enriched AS (SELECT {SUMMARY_LIST}, COALESCE(t.x402, s.x402) AS x402, s.computed_at
             FROM summary s LEFT JOIN tmeta t USING (agent_id))"""


def _root(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


def enriched(spark, sf):
    s = summary(spark, sf)
    results, _ = M.enrich_metadata(s, metadata_documents(spark, sf), M.empty_cache(spark), as_of())
    return M.apply_x402(s, results)


@register("point_lookup", O.with_summary(f""",
asked(requested, id) AS (VALUES ('7', 7), ('0', 0), ('149', 149), ('12abc', 12), ('999999999', 999999999), ('9223372036854775808', -2),
                                ('-1', -1), ('x', -1), ('', -1))
SELECT a.requested, CASE WHEN a.id = -1 THEN 'invalid' WHEN s.agent_id IS NULL THEN 'missing' ELSE 'found' END AS status, s.*
FROM asked a LEFT JOIN summary s ON s.agent_id = a.id"""))
def point_lookup(spark, sf):
    """Found, missing (also an id beyond 64 bits) and invalid ids."""
    return S.lookup_agents(summary(spark, sf), LOOKUPS)


@register("list_x402_enriched", ENRICHED + " SELECT * FROM enriched WHERE x402 ORDER BY rank LIMIT 50 OFFSET 5")
def list_x402_enriched(spark, sf):
    """The x402 filter over the enriched summary."""
    return S.list_agents(enriched(spark, sf), S.ListRequest(x402=True, offset=5))


@register("tier_counts_enriched", ENRICHED + """ SELECT CAST(count(*) AS BIGINT) AS total_agents,
  CAST(count(*) FILTER (WHERE x402) AS BIGINT) AS x402_count FROM enriched""")
def tier_counts_enriched(spark, sf):
    """The payment count after enrichment."""
    return S.network_kpis(enriched(spark, sf)).select("total_agents", "x402_count")


@register("materialized_ranked", O.with_summary("SELECT *, rank AS position FROM summary"))
def materialized_ranked(spark, sf):
    """The summary written as a table and read back in rank order."""
    root = _root(spark, "summary")
    table = f"summary_{uuid.uuid4().hex[:8]}"
    SN.materialize_table(summary(spark, sf), table, root)
    return global_row_number(SN.read_ranked(spark, table), [F.col("rank").asc()], "position")


@register("snapshot_round_trip", O.with_summary(f"SELECT *, 'live' AS source FROM ({SNAPSHOT_SQL})"))
def snapshot_round_trip(spark, sf):
    """The exported snapshot read back with its columns and types."""
    root = _root(spark, "snapshot")
    SN.export_snapshot(summary(spark, sf), f"{root}/live")
    rows, _ = SN.load_agents(spark, f"{root}/live", f"{root}/fixtures")
    return rows.withColumn("scoreBreakdown", F.to_json("scoreBreakdown"))


@register("metadata_cache_runs", _summary_with_meta() + f""",
uris AS (SELECT token_uri, any_value(x402) AS x402, any_value(error) AS error, min(rank) AS best FROM tmeta GROUP BY token_uri)
SELECT token_uri, x402, error,
       CASE WHEN best <= 100 AND error IS NULL THEN {O.AS_OF} - INTERVAL 30 MINUTE ELSE {O.AS_OF} END AS fetched_at
FROM uris""")
def metadata_cache_runs(spark, sf):
    """A10 / K1-K2: two runs over a cache in files, 30 minutes apart; what is fresh stays, the rest is fetched anew."""
    s = summary(spark, sf)
    docs = metadata_documents(spark, sf)
    root = _root(spark, "cache")
    columns = [c for c in M.METADATA_COLUMNS if c != "raw"]
    earlier = as_of() - F.expr("INTERVAL 30 MINUTES")
    first = M.fetch_metadata(M.enrich_targets(s, 100), docs, earlier).select(*columns)
    SN.upsert_cache(spark, root, first, "token_uri")
    targets = M.enrich_targets(s).select("token_uri").distinct()
    missing = M.refetch_candidates(targets, SN.read_current(spark, root), as_of())
    SN.upsert_cache(spark, root, M.fetch_metadata(missing, docs, as_of()).select(*columns), "token_uri")
    return SN.read_current(spark, root).select("token_uri", "x402", "error", "fetched_at")


@register("identity_ordered", f"WITH {O.AGENTS} SELECT *, row_number() OVER (ORDER BY agent_id) AS position FROM agents")
def identity_ordered(spark, sf):
    """Registrations in agent order, each with its position."""
    return global_row_number(D.decode_identity(logs(spark, sf, mints=False)), [F.col("agent_id").asc()], "position")


@register("feedback_since", f"WITH {O.FEEDBACK} SELECT * FROM fb WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00'")
def feedback_since(spark, sf):
    """A1 / B1: bronze Parquet written to the shared folder, read with a time floor."""
    root = _root(spark, "bronze")
    write_bronze(logs(spark, sf, mints=False), root)
    return D.decode_feedback(read_bronze(spark, root), "2024-01-15")
