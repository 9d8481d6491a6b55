"""Stored layouts and mergeable states: pages by position, trigram search, ranks by counting, cache buckets, lookups by id,
client sketches, additive statistics, bucketed documents; strings by offset words."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..config import AS_OF, DEFAULT_CONFIG
from ..operators import clients as C
from ..operators import decode as D
from ..operators import metadata as M
from ..operators import rank as R
from ..operators import serve as S
from ..operators.paging import PagedSummary, write_paged
from ..plans.summary import scored_agents
from ..sources import snapshot as SN
from ..sources.fixtures import feedback_text_logs, metadata_documents, table
from . import oracle as O
from .catalog import logs, register
from .queries_meta import _summary_with_meta, as_of, summary
from .queries_run import ENRICHED, LOOKUPS, _root, enriched
from .queries_serve import HIST_SQL, SERIES_SQL, unranked

ROWS_PER_FILE = 400  # small, so that the given tables make several files

PAGES = [
    ("first", S.ListRequest(), "true", "rank"),
    ("deep", S.ListRequest(sort="feedback", offset=1310, limit=100), "true", "feedback_count DESC, reputation_score DESC, rank"),
    ("across", S.ListRequest(sort="reputation", offset=350, limit=120), "true", "reputation_score DESC, feedback_count DESC, rank"),
    ("rated", S.ListRequest(rated=True, sort="recency", offset=30, limit=70), "feedback_count > 0", "last_activity_at DESC, rank"),
    ("paid", S.ListRequest(x402=True, offset=20, limit=40), "x402", "rank"),
    ("both", S.ListRequest(x402=True, rated=True, sort="feedback", offset=3, limit=25), "x402 AND feedback_count > 0", "feedback_count DESC, reputation_score DESC, rank"),
    ("beyond", S.ListRequest(offset=10**12), "true", "rank"),
]
SEARCHES = [("uri", "example.ORG/agent/12", False), ("owner", " 0000000004 ", False), ("short", "7", False), ("id", "123", False),
            ("nothing", "no such agent", False), ("rated", "agent/1", True), ("wide", "0x0", False)]


def _stored(spark, sf) -> PagedSummary:
    root = _root(spark, "paged")
    write_paged(enriched(spark, sf), root, ROWS_PER_FILE)
    return PagedSummary(spark, root)


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("paged_list", ENRICHED + " " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{name}' AS page, * FROM enriched WHERE {cond} ORDER BY {order} LIMIT {S.parse_limit(r.limit)} OFFSET {S.parse_offset(r.offset)})"
    for name, r, cond, order in PAGES))
def paged_list(spark, sf):
    """Pages of every sort mode and filter by position, from the files that hold them."""
    stored = _stored(spark, sf)
    return _union([stored.page(r).withColumn("page", F.lit(name)) for name, r, _, _ in PAGES])


@register("paged_envelope", ENRICHED + " " + " UNION ALL ".join(
    f"""SELECT '{name}' AS page, 'live' AS source, (SELECT max(computed_at) FROM enriched) AS computed_at, CAST(n AS BIGINT) AS total,
  CAST(greatest(0, least({S.parse_limit(r.limit)}, n - {S.parse_offset(r.offset)})) AS BIGINT) AS count,
  {S.parse_offset(r.offset)} + greatest(0, least({S.parse_limit(r.limit)}, n - {S.parse_offset(r.offset)})) < n AS has_more
FROM (SELECT count(*) AS n FROM enriched WHERE {cond})""" for name, r, cond, _ in PAGES))
def paged_envelope(spark, sf):
    """Totals of every filter from the index, without reading an agent."""
    stored = _stored(spark, sf)
    return _union([stored.envelope(r).withColumn("page", F.lit(name)) for name, r, _, _ in PAGES])


def _holds(q: str) -> str:
    q = q.strip().lower()
    return (f"(CAST(agent_id AS VARCHAR) LIKE '%{q}%' OR lower(owner_address) LIKE '%{q}%' OR COALESCE(lower(token_uri) LIKE '%{q}%', false))")


@register("search_trigrams", ENRICHED + " " + " UNION ALL ".join(
    f"SELECT '{name}' AS search, * FROM enriched WHERE {_holds(q)}{' AND feedback_count > 0' if rated else ''}" for name, q, rated in SEARCHES))
def search_trigrams(spark, sf):
    """All matches of several terms through the posting lists."""
    stored = _stored(spark, sf)
    return _union([S.filter_agents(stored.matches(q), None, False, rated).withColumn("search", F.lit(name)) for name, q, rated in SEARCHES])


@register("search_page", ENRICHED + f""" SELECT * FROM (SELECT * FROM enriched WHERE {_holds('agent/1')}
ORDER BY reputation_score DESC, feedback_count DESC, rank LIMIT 30 OFFSET 40)""")
def search_page(spark, sf):
    """The second page of a search."""
    return _stored(spark, sf).page(S.ListRequest(q="Agent/1", sort="reputation", limit=30, offset=40))


def _staged(spark, df, name):
    path = _root(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@register("rank_by_counting", O.with_summary("SELECT agent_id, rank FROM summary"))
def rank_by_counting(spark, sf):
    """Ranks of a stored table from a histogram of order cells."""
    return R.rank_by_counting(_staged(spark, scored_agents(logs(spark, sf), DEFAULT_CONFIG), "scored")).select("agent_id", "rank")


@register("rank_refresh", f"SELECT agent_id, reputation_score, rank FROM ({O.SUMMARY_REVOKED})")
def rank_refresh(spark, sf):
    """Ranks after revocations: changed agents move between cells, only touched cells are numbered again."""
    before = _staged(spark, scored_agents(logs(spark, sf), DEFAULT_CONFIG), "scored")
    placed, cells = _staged(spark, R.positions(before), "placed"), _staged(spark, R.cell_histogram(before), "cells")
    after = scored_agents(logs(spark, sf, revocations=True), DEFAULT_CONFIG)
    hit = D.decode_revocations(logs(spark, sf, revocations=True), None).select("agent_id").distinct()
    changed = _staged(spark, after.join(hit, "agent_id", "left_semi").select(*before.columns), "changed")
    same, again, delta = R.refresh_positions(placed, changed)
    return R.apply_bases(same.unionByName(again), R.cell_bases(R.merge_cells(cells, delta))).select("agent_id", "reputation_score", "rank")


URIS = _summary_with_meta() + """,
uris AS (SELECT token_uri, any_value(x402) AS x402, any_value(error) AS error FROM tmeta GROUP BY token_uri),
keyed AS (SELECT *, CAST(('0x' || substr(md5(token_uri), 1, 4))::BIGINT % 64 AS INTEGER) AS bucket FROM uris),
again AS (SELECT * FROM keyed WHERE CAST(('0x' || substr(md5(token_uri), 5, 4))::BIGINT % 100 AS INTEGER) = 7)"""


@register("cache_buckets", URIS + f""" SELECT token_uri, x402, error, bucket,
  CASE WHEN token_uri IN (SELECT token_uri FROM again) THEN {O.AS_OF} ELSE {O.AS_OF} - INTERVAL 4 MINUTE END AS fetched_at,
  bucket IN (SELECT bucket FROM again) AS rewritten FROM keyed""")
def cache_buckets(spark, sf):
    """A second run that fetches one key of a hundred rewrites only the buckets of these keys."""
    uris = M.enrich_targets(summary(spark, sf)).select("token_uri").distinct()
    columns = [c for c in M.METADATA_COLUMNS if c != "raw"]
    docs, root = metadata_documents(spark, sf), _root(spark, "buckets")
    earlier = as_of() - F.expr("INTERVAL 4 MINUTES")
    SN.upsert_buckets(spark, root, M.fetch_metadata(uris, docs, earlier).select(*columns), "token_uri")
    files = SN.read_buckets(spark, root).select("bucket", F.col("_metadata.file_path").alias("path")).distinct()
    files = _staged(spark, files, "files")
    some = F.pmod(F.conv(F.substring(F.md5(F.col("token_uri").cast("binary")), 5, 4), 16, 10).cast("int"), F.lit(100)) == 7
    alive = as_of() <= M.expires_at(F.col("fetched_at"), F.col("error"))
    SN.upsert_buckets(spark, root, M.fetch_metadata(uris.where(some), docs, as_of()).select(*columns), "token_uri", alive)
    now = SN.read_buckets(spark, root).select("*", F.col("_metadata.file_path").alias("path"))
    old = files.select("path", F.lit(False).alias("new"))
    return now.join(old, "path", "left").select("token_uri", "x402", "error", "bucket", "fetched_at", F.coalesce("new", F.lit(True)).alias("rewritten"))


@register("point_lookup_stored", O.with_summary("""
, asked(requested, id) AS (VALUES ('7', 7), ('0', 0), ('149', 149), ('12abc', 12), ('999999999', 999999999), ('9223372036854775808', -2),
                                ('-1', -1), ('x', -1), ('', -1))
SELECT a.requested, CASE WHEN a.id = -1 THEN 'invalid' WHEN s.agent_id IS NULL THEN 'missing' ELSE 'found' END AS status, s.*
FROM asked a LEFT JOIN summary s ON s.agent_id = a.id"""))
def point_lookup_stored(spark, sf):
    """The point lookup over the layout by id, whose row groups tell which ids they can hold."""
    root = _root(spark, "by-id")
    SN.write_by_id(summary(spark, sf), root)
    return S.lookup_agents(SN.read_by_id(spark, root, S.requested_ids(LOOKUPS)), LOOKUPS)


WINDOWS = [(None, None), ("2024-01-10", "2024-01-20"), ("2024-01-25", None)]


@register("clients_by_window", f"WITH {O.FEEDBACK} " + " UNION ALL ".join(
    f"SELECT {i} AS part, agent_id, CAST(count(*) AS BIGINT) AS votes, CAST(count(DISTINCT client_address) AS BIGINT) AS unique_clients FROM fb "
    f"WHERE {'true' if a is None else f'''CAST(created_at AS DATE) >= DATE '{a}' '''} AND {'true' if b is None else f'''CAST(created_at AS DATE) <= DATE '{b}' '''} GROUP BY agent_id"
    for i, (a, b) in enumerate(WINDOWS)))
def clients_by_window(spark, sf):
    """Distinct clients of any window from daily states."""
    states = _staged(spark, C.client_states(D.decode_feedback(logs(spark, sf, mints=False))), "clients")
    return _union([C.clients_between(states, a, b).select(F.lit(i).alias("part"), "*") for i, (a, b) in enumerate(WINDOWS)])


@register("feedback_texts", f"""WITH {O.FEEDBACK}
SELECT agent_id, client_address, feedback_index, '0x' || sha256('ft:' || feedback_index) AS feedback_tx, created_at,
  CASE WHEN feedback_index % 10 NOT IN (4, 6) THEN event_type END AS tag1,
  CASE WHEN feedback_index % 10 NOT IN (2, 7) THEN 't' || feedback_index END AS tag2,
  CASE WHEN feedback_index % 10 NOT IN (3, 4) THEN 'https://agents.example.org/feedback/endpoint/' || feedback_index END AS endpoint,
  CASE WHEN feedback_index % 10 NOT IN (5, 8) THEN 'ipfs://' || sha256(feedback_index::VARCHAR) END AS feedback_uri
FROM fb JOIN (SELECT event_id AS feedback_index, event_type FROM events) USING (feedback_index)""")
def feedback_texts(spark, sf):
    """The four strings of a feedback by their offset words, odd and hostile ones among them."""
    return D.decode_feedback_texts(feedback_text_logs(table(spark, sf, "events")))


REVOKED = O.SUMMARY.replace("FROM events)", "FROM events WHERE event_id % 50 <> 0)")


@register("stats_from_parts", f"""WITH {REVOKED}, {HIST_SQL}, {SERIES_SQL}
SELECT 'live' AS source, CAST(count(*) AS BIGINT) AS total_agents, CAST(count(*) FILTER (WHERE feedback_count > 0) AS BIGINT) AS rated_agents,
  CAST(count(token_uri) AS BIGINT) AS with_token_uri, CAST(count(*) FILTER (WHERE x402) AS BIGINT) AS x402_count,
  CAST(COALESCE(sum(feedback_count), 0) AS BIGINT) AS total_feedback, COALESCE(greatest(max(reputation_score), 0.0), 0.0) AS top_score,
  COALESCE(CAST(round(CAST(avg(reputation_score) AS DECIMAL(38,9)), 2) AS DOUBLE), 0.0) AS avg_score, max(computed_at) AS computed_at,
  (SELECT '{{' || string_agg('"' || l.label || '":' || COALESCE(c.n, 0), ',' ORDER BY l.bucket) || '}}'
   FROM labels l LEFT JOIN counts c USING (bucket)) AS score_distribution,
  (SELECT COALESCE('[' || string_agg('{{"date":"' || date || '","count":' || count || '}}', ',' ORDER BY date) || ']', '[]') FROM series) AS activity_series
FROM summary""")
def stats_from_parts(spark, sf):
    """The statistics after revocations, from the parts of all agents and those of the changed ones."""
    before = _staged(spark, unranked(spark, sf), "before")
    parts = _staged(spark, S.stats_parts(before), "parts")
    revoked = logs(spark, sf, revocations=True)
    hit = D.decode_revocations(revoked).select("agent_id").distinct()
    after = (scored_agents(revoked, DEFAULT_CONFIG).join(hit, "agent_id", "left_semi")
             .withColumn("x402", F.lit(False)).withColumn("computed_at", as_of()))
    after = _staged(spark, after, "after")
    gone = before.join(after.select("agent_id"), "agent_id", "left_semi")
    return S.stats_from_parts(S.merge_parts(parts, S.stats_parts(gone, -1), S.stats_parts(after)), AS_OF, as_of())


@register("enrichment_runs", _summary_with_meta() + """,
uris AS (SELECT token_uri, any_value(error) AS error, min(rank) AS best FROM tmeta GROUP BY token_uri)
SELECT t.agent_id, t.token_uri, t.x402, t.error, u.best <= 100 AND u.error IS NULL AS from_cache FROM tmeta t JOIN uris u USING (token_uri)""")
def enrichment_runs(spark, sf):
    """Two runs over documents in buckets and a cache in buckets, half an hour apart."""
    s = _staged(spark, summary(spark, sf), "summary")
    name, cache = f"documents_{uuid.uuid4().hex[:8]}", _root(spark, "metadata")
    M.store_documents(metadata_documents(spark, sf), name, 16)
    M.enrichment_run(s, name, cache, as_of() - F.expr("INTERVAL 30 MINUTES"), 100)
    return M.enrichment_run(s, name, cache, as_of())
