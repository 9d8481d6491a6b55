"""Name-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF, DEFAULT_CONFIG
from ..operators import metadata as M
from ..operators import names as N
from ..plans.summary import build_agent_summary
from ..sources.fixtures import lookup_inputs, metadata_documents, names_table, text_records
from . import oracle as O
from .catalog import logs, register

CFG = DEFAULT_CONFIG


def summary(spark, sf):
    return build_agent_summary(logs(spark, sf), CFG)


def identity(spark, sf):
    from ..operators.decode import decode_identity
    return decode_identity(logs(spark, sf, mints=False))


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def empty_name_cache(spark):
    return spark.createDataFrame([], "address string, name string, resolved boolean, fetched_at timestamp")


@register("owner_names", O.with_summary(f""", {O.NAMES}
SELECT s.agent_id, s.owner_address, g.name AS owner_name
FROM summary s LEFT JOIN good g ON lower(s.owner_address) = g.address"""))
def owner_names(spark, sf):
    """Every agent's owner with its primary name (owners come from the
    decoded registrations; no score or rank is needed)."""
    s = identity(spark, sf).select("agent_id", "owner_address")
    return N.owner_names(s, names_table(spark, sf))


LOOKUP_INPUTS = """inputs AS (
  SELECT CASE WHEN k % 2 = 0 THEN '0x' || upper(substr(address, 3)) ELSE address END AS input FROM nat
  UNION ALL SELECT CASE WHEN k % 4 = 0 THEN '  ' || nm || ' ' ELSE nm END FROM nat
  UNION ALL SELECT upper(replace(lower(s_name), '#', '-') || '.eth') FROM supplier
  UNION ALL SELECT s_name FROM supplier
  UNION ALL SELECT '   ' FROM nation WHERE n_nationkey = 0)"""


@register("name_lookup", f"""WITH {O.NAMES}, {O.RECORDS}, {LOOKUP_INPUTS},
q AS (
  SELECT trim(input) AS query,
         CASE WHEN trim(input) = '' THEN 'invalid'
              WHEN regexp_matches(trim(input), '^0x[0-9a-fA-F]{{40}}$') THEN 'address'
              WHEN contains(trim(input), '.') THEN 'name' ELSE 'invalid' END AS kind
  FROM inputs),
r AS (
  SELECT q.query, q.kind,
         CASE WHEN q.kind = 'address' THEN rv.name WHEN q.kind = 'name' AND fw.address IS NOT NULL THEN q.query END AS name,
         CASE WHEN q.kind = 'address' THEN q.query WHEN q.kind = 'name' THEN fw.address END AS address
  FROM q
  LEFT JOIN good rv ON q.kind = 'address' AND lower(q.query) = rv.address
  LEFT JOIN (SELECT lower(name) AS lname, address FROM good WHERE name IS NOT NULL) fw
    ON q.kind = 'name' AND lower(q.query) = fw.lname),
m AS (
  SELECT name, '{{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}}' AS records
  FROM recs WHERE key IN ('avatar', 'description', 'url', 'com.twitter', 'agent-context', 'agent-endpoint[web]')
    AND value IS NOT NULL AND value <> ''
  GROUP BY name)
SELECT r.query, r.kind, r.name, r.address,
       CASE WHEN r.name IS NOT NULL THEN COALESCE(m.records, '{{}}') ELSE '{{}}' END AS records
FROM r LEFT JOIN m ON r.name = m.name""")
def name_lookup(spark, sf):
    """Unified address-or-name lookup with sparse records."""
    out = N.name_lookup(lookup_inputs(spark, sf), names_table(spark, sf), text_records(spark, sf))
    return out.withColumn("records", F.to_json("records"))


@register("owner_profiles", f"""WITH {O.NAMES}, {O.RECORDS},
owners AS (SELECT DISTINCT '0x' || lpad(lower(hex(c_nationkey + 1)), 40, '0') AS address FROM customer)
SELECT o.address, g.name,
  max(CASE WHEN r.key = 'agent-context' THEN r.value END) AS agent_context,
  max(CASE WHEN r.key = 'agent-endpoint[mcp]' THEN r.value END) AS mcp_endpoint,
  max(CASE WHEN r.key = 'agent-endpoint[a2a]' THEN r.value END) AS a2a_endpoint,
  max(CASE WHEN r.key = 'agent-endpoint[web]' THEN r.value END) AS web_endpoint,
  max(CASE WHEN r.key = 'avatar' THEN r.value END) AS avatar,
  max(CASE WHEN r.key = 'url' THEN r.value END) AS url,
  max(CASE WHEN r.key = 'description' THEN r.value END) AS description
FROM owners o LEFT JOIN good g USING (address) LEFT JOIN recs r ON r.name = g.name
GROUP BY o.address, g.name""")
def owner_profiles(spark, sf):
    """Name + seven profile records for every owner."""
    s = identity(spark, sf).select(F.col("owner_address").alias("address"))
    return N.agent_profiles(s, names_table(spark, sf), text_records(spark, sf))


OWNERS_SQL = """owners AS (
  SELECT lower(owner_address) AS address, min(rank) AS best_rank FROM summary
  WHERE COALESCE(owner_address, '') <> '' GROUP BY 1)"""


@register("unique_owners", O.with_summary(f", {OWNERS_SQL}\nSELECT * FROM owners"))
def unique_owners(spark, sf):
    """Distinct owners with their best rank."""
    return N.unique_owners(summary(spark, sf))


@register("resolve_names_run", O.with_summary(f""", {OWNERS_SQL}, {O.NAMES},
top AS (SELECT o.address, o.best_rank, n.name, COALESCE(n.resolved, true) AS resolved
        FROM owners o LEFT JOIN names n USING (address)),
warm AS (SELECT address FROM (SELECT * FROM owners ORDER BY best_rank LIMIT 5) w
         LEFT JOIN names n USING (address) WHERE COALESCE(n.resolved, true))
SELECT CAST(count(*) AS BIGINT) AS processed,
  CAST(count(*) FILTER (WHERE address IN (SELECT address FROM warm)) AS BIGINT) AS from_cache,
  CAST(count(*) FILTER (WHERE address NOT IN (SELECT address FROM warm) AND resolved) AS BIGINT) AS fetched,
  CAST(count(*) FILTER (WHERE NOT resolved) AS BIGINT) AS errors,
  CAST(count(*) FILTER (WHERE resolved AND name IS NOT NULL) AS BIGINT) AS has_name,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE resolved AND name IS NOT NULL) * 100.0 / count(*) END, 1) AS has_name_pct
FROM top"""))
def resolve_names_run(spark, sf):
    """P10 + G16: warm names for all owners over a cache
    holding the top-10 owners, five of them fresh; failed lookups are reported, not cached."""
    s = summary(spark, sf)
    names = names_table(spark, sf)
    # the last five of the ten were fetched more than a day before, and count no more
    _, old = N.resolve_names(s, names, empty_name_cache(spark), as_of() - F.expr("INTERVAL 25 HOURS"), top=10)
    _, warm = N.resolve_names(s, names, empty_name_cache(spark), as_of() - F.expr("INTERVAL 23 HOURS"), top=5)
    cache = old.join(warm.select("address"), "address", "left_anti").unionByName(warm)
    results, _ = N.resolve_names(s, names, cache, as_of())
    return N.names_run_summary(results)


@register("name_sample", O.with_summary(f""", {OWNERS_SQL}, {O.NAMES}
SELECT o.address, n.name FROM owners o JOIN names n USING (address)
WHERE n.resolved AND n.name IS NOT NULL ORDER BY o.address LIMIT 15"""))
def name_sample(spark, sf):
    """First 15 resolved names of the warmed cache."""
    _, cache = N.resolve_names(summary(spark, sf), names_table(spark, sf), empty_name_cache(spark), as_of())
    return N.name_sample(cache)


@register("attestations", f"""WITH {O.NAMES}
SELECT c_custkey AS agent_id, g.name AS owner_name,
       (c_custkey % 5 = 0 AND g.name IS NOT NULL) AS verified
FROM customer LEFT JOIN good g ON '0x' || lpad(lower(hex(c_nationkey + 1)), 40, '0') = g.address""")
def attestations(spark, sf):
    """Registration attestation record present on the owner's name?"""
    return N.attestations(identity(spark, sf), names_table(spark, sf), text_records(spark, sf))


@register("agent_detail", O.with_summary(f""", {O.DOCMETA}, {O.NAMES},
uris AS (
  SELECT DISTINCT token_uri,
         CASE WHEN starts_with(token_uri, 'ipfs://') THEN 'https://ipfs.io/ipfs/' || substr(token_uri, 8)
              ELSE token_uri END AS resolved_uri
  FROM summary WHERE token_uri IS NOT NULL),
meta AS (
  SELECT u.token_uri, u.resolved_uri, COALESCE(m.x402, false) AS x402, m.name, m.description,
         CASE WHEN m.resolved_uri IS NULL THEN 'HTTP 404 Not Found' ELSE m.error END AS error
  FROM uris u LEFT JOIN docmeta m ON u.resolved_uri = m.resolved_uri)
SELECT s.agent_id, s.owner_address, s.token_uri, s.registered_at, s.registered_tx, s.feedback_count,
       s.unique_clients, s.positive_count, s.neutral_count, s.negative_count, s.avg_raw_score,
       s.reputation_score, s.effective_feedback, s.last_feedback_at, s.last_activity_at, s.rank,
       (s.x402 OR COALESCE(mt.x402, false)) AS x402, s.computed_at,
       mt.resolved_uri AS metadata_resolved_uri, mt.name AS metadata_name,
       mt.description AS metadata_description, mt.error AS metadata_error, g.name AS owner_name
FROM summary s LEFT JOIN meta mt ON s.token_uri = mt.token_uri
LEFT JOIN good g ON lower(s.owner_address) = g.address"""))
def agent_detail(spark, sf):
    """P7 / C5 / C6 (batch form): every agent with metadata and owner name."""
    s = summary(spark, sf)
    meta = M.fetch_metadata(s.select("token_uri"), metadata_documents(spark, sf), F.lit(AS_OF).cast("timestamp"))
    return N.owner_names(M.agent_detail(s, meta), names_table(spark, sf))
