"""Registration-metadata enrichment.

Network fetches are replaced by a join to a documents table (uri -> body).
Everything is keyed by the *distinct* token URI: agents sharing one URI (a
hot key) cost one parse; the results are joined back to agents, where a hot
URI is handled by AQE's skew-join split (the metadata side has one row per URI).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    DATA_URI_ERROR,
    DESCRIPTION_KEYS,
    NAME_KEYS,
    NO_URI_ERROR,
    TTL_METADATA,
    TTL_METADATA_ERROR,
)
from .joins import spread_left_join
from ..functions.uri import data_uri_text, is_data_uri, resolve_uri
from ..functions.variant import (
    as_array,
    as_object,
    parse_json_or_null,
    sql_detect_x402,
    sql_first_string,
    sql_is_truthy_root,
)

NOT_FOUND_ERROR = "HTTP 404 Not Found"
INVALID_JSON_ERROR = "Invalid JSON"

METADATA_COLUMNS = ["token_uri", "resolved_uri", "raw", "x402", "name", "description", "fetched_at", "error"]


def fetch_metadata(uris: DataFrame, documents: DataFrame, as_of: Column) -> DataFrame:
    """K4 core: distinct token URIs -> metadata records.

    * data: URIs decode inline (F15) and never touch the documents table; an
      unparseable or falsy result is an error entry.
    * other URIs resolve through the gateway (F14) and take their body from
      ``documents``; a missing body is a 404 entry, a body that is not JSON
      under a '.json' URI is an invalid-JSON entry, any other non-JSON body
      is a document without metadata (no error).

    Documents are first semi-joined to the URIs actually needed, so only
    those bodies are read into the join (a small target set is broadcast by
    Spark's size check and the documents are filtered without a shuffle).
    """
    # Distinct first (map-side combined, so a URI shared by many agents is one
    # row per task), then spread the distinct URIs over every shuffle
    # partition: parsing and walking documents is CPU-heavy per byte, and a
    # byte-sized AQE coalesce would otherwise squeeze it onto a few cores.
    width = int(uris.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = (uris.select(F.col("token_uri")).where(F.col("token_uri").isNotNull()).distinct()
         .repartition(width, "token_uri"))
    inline = (u.where(is_data_uri("token_uri"))
              .select("token_uri", F.col("token_uri").alias("resolved_uri"),
                      data_uri_text("token_uri").alias("_text"), F.lit(True).alias("_inline"),
                      F.lit(True).alias("_found")))
    remote = u.where(~is_data_uri("token_uri")).withColumn("resolved_uri", resolve_uri("token_uri"))
    needed = remote.select(F.col("resolved_uri").alias("uri")).distinct()
    bodies = documents.select("uri", "body").join(needed, "uri", "left_semi")
    fetched = (remote.join(bodies.select(F.col("uri").alias("resolved_uri"), F.col("body").alias("_text"),
                                         F.lit(True).alias("_found")), "resolved_uri", "left")
               .select("token_uri", "resolved_uri", "_text", F.lit(False).alias("_inline"),
                       F.coalesce("_found", F.lit(False)).alias("_found")))
    return _records(inline.unionByName(fetched), as_of)


def _records(found: DataFrame, as_of: Column) -> DataFrame:
    """(token_uri, resolved_uri, _text, _inline, _found) -> metadata records."""
    parsed = (found
              .withColumn("_v", parse_json_or_null(F.col("_text")))
              .withColumns({"_obj": as_object(F.col("_v")), "_arr": as_array(F.col("_v"))})
              .withColumn("_truthy", F.expr(sql_is_truthy_root("_v", "_obj", "_arr"))))
    v = F.col("_v")
    truthy = F.col("_truthy")
    is_inline = F.col("_inline")
    error = (F.when(is_inline, F.when(~truthy, F.lit(DATA_URI_ERROR)))
             .when(~F.col("_found"), F.lit(NOT_FOUND_ERROR))
             .when(v.isNull() & F.col("resolved_uri").endswith(".json"), F.lit(INVALID_JSON_ERROR)))
    raw = F.when(is_inline & ~truthy, F.lit(None).cast("variant")).otherwise(v)
    return parsed.select(
        "token_uri", "resolved_uri",
        raw.alias("raw"),
        F.expr(sql_detect_x402("_v", "_obj", "_arr")).alias("x402"),
        F.when(truthy, F.expr(sql_first_string("_v", NAME_KEYS))).alias("name"),
        F.when(truthy, F.expr(sql_first_string("_v", DESCRIPTION_KEYS))).alias("description"),
        as_of.alias("fetched_at"),
        error.alias("error"),
    )


# ---------------------------------------------------------------------------
# Documents stored in buckets: enrichment without a shuffle of bodies
# ---------------------------------------------------------------------------

DOCUMENT_BUCKETS = 64


def store_documents(documents: DataFrame, table: str, buckets: int = DOCUMENT_BUCKETS) -> None:
    """Write (uri, body) as a table in buckets of ``uri_key`` (SHA-256 of the URI), sorted by it: the one shuffle of
    bodies, paid when documents arrive. ``buckets`` should fit the table's size; a join has as many tasks."""
    (documents.select(F.sha2("uri", 256).alias("uri_key"), "uri", "body").repartition(buckets, "uri_key")
     .write.mode("overwrite").bucketBy(buckets, "uri_key").sortBy("uri_key").saveAsTable(table))


def fetch_stored(uris: DataFrame, table: str, as_of: Column) -> DataFrame:
    """``fetch_metadata`` from a table of ``store_documents``: the URIs go to the documents' buckets by hash, bodies
    are read where they lie. A URI shared by many agents is one row per task before it moves."""
    u = uris.select("token_uri").where(F.col("token_uri").isNotNull()).distinct()
    inline = u.where(is_data_uri("token_uri")).select(
        "token_uri", F.col("token_uri").alias("resolved_uri"), data_uri_text("token_uri").alias("_text"),
        F.lit(True).alias("_inline"), F.lit(True).alias("_found"))
    resolved = resolve_uri("token_uri")
    remote = u.where(~is_data_uri("token_uri")).select("token_uri", resolved.alias("resolved_uri"), F.sha2(resolved, 256).alias("uri_key"))
    bodies = uris.sparkSession.table(table).select("uri_key", F.col("body").alias("_text"), F.lit(True).alias("_found"))
    # Merge keeps both sides in place; a broadcast of URIs is Spark's choice where they are few.
    found = remote.hint("merge").join(bodies, "uri_key", "left").select(
        "token_uri", "resolved_uri", "_text", F.lit(False).alias("_inline"), F.coalesce("_found", F.lit(False)).alias("_found"))
    return _records(inline.unionByName(found), as_of)


def enrichment_run(summary: DataFrame, table: str, cache_root: str, as_of: Column, top: int | None = None) -> DataFrame:
    """P9 through files: returns the results (agent_id, token_uri, x402, error, from_cache) and brings the cache in
    ``cache_root`` up to date. What is fetched is parsed once and staged for both."""
    from ..session import checkpoint_dir
    from ..sources.snapshot import new_run_id, read_buckets, upsert_buckets
    spark = summary.sparkSession
    cache = read_buckets(spark, cache_root)
    targets = enrich_targets(summary, top)
    uris = targets.select("token_uri").distinct()
    columns = [c for c in METADATA_COLUMNS if c != "raw"]
    hits = None
    if cache is not None:
        hits = fresh_entries(cache, as_of).join(uris, "token_uri", "left_semi").select(*columns)
        uris = refetch_candidates(uris, cache, as_of)
    base = f"{checkpoint_dir(spark).rstrip('/')}/enrichment-{new_run_id()}"
    fetch_stored(uris, table, as_of).select(*columns).write.parquet(f"{base}/fetched")
    fetched = spark.read.parquet(f"{base}/fetched")
    known = fetched.withColumn("from_cache", F.lit(False))
    if hits is not None:  # before the cache's files change
        hits.write.parquet(f"{base}/hits")
        known = known.unionByName(spark.read.parquet(f"{base}/hits").withColumn("from_cache", F.lit(True)))
    alive = as_of <= expires_at(F.col("fetched_at"), F.col("error"))
    upsert_buckets(spark, cache_root, fetched, "token_uri", alive)
    return targets.join(known.select("token_uri", "x402", "error", "from_cache"), "token_uri", "left").select(
        "agent_id", "token_uri", "x402", "error", "from_cache")


def batch_enrich(items: DataFrame, documents: DataFrame, as_of: Column) -> DataFrame:
    """K4: (agent_id, token_uri) -> (agent_id, token_uri, x402, error), one
    output row per input; a missing URI gives ('', false, 'no tokenURI')."""
    meta = fetch_metadata(items, documents, as_of).select("token_uri", "x402", "error")
    return spread_left_join(items, meta, "token_uri", "agent_id").select(
        "agent_id",
        F.coalesce(F.col("token_uri"), F.lit("")).alias("token_uri"),
        F.coalesce(F.col("x402"), F.lit(False)).alias("x402"),
        F.when(F.col("token_uri").isNull(), F.lit(NO_URI_ERROR)).otherwise(F.col("error")).alias("error"),
    )


# ---------------------------------------------------------------------------
# Cache freshness (K1-K3) and upsert (A10)
# ---------------------------------------------------------------------------

def expires_at(fetched_at: Column, error: Column) -> Column:
    """K1: ok entries live 1 h, error entries 5 min."""
    ttl = F.when(error.isNull(), F.lit(TTL_METADATA)).otherwise(F.lit(TTL_METADATA_ERROR))
    return F.timestamp_seconds(F.unix_seconds(fetched_at) + ttl)


def is_fresh(cache: DataFrame, as_of: Column) -> Column:
    """An entry expires strictly after its TTL (now > expiresAt)."""
    return as_of <= expires_at(cache["fetched_at"], cache["error"])


def fresh_entries(cache: DataFrame, as_of: Column) -> DataFrame:
    """K3: the entries still valid at ``as_of``."""
    return cache.where(is_fresh(cache, as_of))


def refetch_candidates(targets: DataFrame, cache: DataFrame, as_of: Column, key: str = "token_uri") -> DataFrame:
    """Targets not covered by a fresh cache entry (anti join)."""
    return targets.join(fresh_entries(cache, as_of).select(key), key, "left_anti")


def cache_hits(targets: DataFrame, cache: DataFrame, as_of: Column, key: str = "token_uri") -> DataFrame:
    """Targets served from a fresh cache entry (semi join)."""
    return targets.join(fresh_entries(cache, as_of).select(key), key, "left_semi")


def upsert(cache: DataFrame, new: DataFrame, key: str = "token_uri") -> DataFrame:
    """New rows replace old rows with the same key."""
    return cache.join(new.select(key), key, "left_anti").unionByName(new)


def empty_cache(spark) -> DataFrame:
    return spark.createDataFrame([], "token_uri string, resolved_uri string, raw variant, x402 boolean, "
                                     "name string, description string, fetched_at timestamp, error string")


# ---------------------------------------------------------------------------
# Enrichment run (P9), summary update (C4), detail view
# ---------------------------------------------------------------------------

def enrich_targets(summary: DataFrame, top: int | None = None) -> DataFrame:
    """S6 + B6: the top-N agents by rank, then those with a token URI (the
    URI filter comes after the limit). ``top=None`` enriches every agent."""
    ranked = summary.select("agent_id", "rank", "token_uri")
    if top is not None:
        ranked = ranked.orderBy("rank").limit(int(top))
    return ranked.where(F.col("token_uri").isNotNull()).select("agent_id", "token_uri")


def enrich_metadata(summary: DataFrame, documents: DataFrame, cache: DataFrame, as_of: Column,
                    top: int | None = None):
    """Returns (results, new_cache). ``results`` has one row per target:
    (agent_id, token_uri, x402, error, from_cache)."""
    targets = enrich_targets(summary, top)
    uris = targets.select("token_uri").distinct()
    misses = refetch_candidates(uris, cache, as_of)
    fetched = fetch_metadata(misses, documents, as_of).select(*METADATA_COLUMNS)
    hits = fresh_entries(cache, as_of).join(uris, "token_uri", "left_semi").select(
        "token_uri", "x402", "error", F.lit(True).alias("from_cache"))
    fresh = fetched.select("token_uri", "x402", "error", F.lit(False).alias("from_cache")).unionByName(hits)
    results = targets.join(fresh, "token_uri", "left").select("agent_id", "token_uri", "x402", "error", "from_cache")
    return results, upsert(cache, fetched)


def apply_x402(summary: DataFrame, results: DataFrame) -> DataFrame:
    """C4: set x402 from the run's results where present (true or false)."""
    r = results.select("agent_id", F.col("x402").alias("_new"))
    return summary.join(r, "agent_id", "left").withColumn(
        "x402", F.coalesce(F.col("_new"), F.col("x402"))).drop("_new").select(*summary.columns)


def x402_changes(summary: DataFrame, results: DataFrame) -> DataFrame:
    """C4: number of rows whose flag the run changes."""
    r = results.select("agent_id", F.col("x402").alias("_new"))
    return (summary.join(r, "agent_id").where(F.col("_new") != F.col("x402"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("changed")))


def run_summary(results: DataFrame) -> DataFrame:
    """Processed / served from cache / errors / x402 found."""
    return results.agg(
        F.count(F.lit(1)).cast("bigint").alias("processed"),
        F.count_if(F.col("from_cache")).cast("bigint").alias("from_cache"),
        F.count_if(F.col("error").isNotNull()).cast("bigint").alias("errors"),
        F.count_if(F.col("x402")).cast("bigint").alias("x402_found"),
    )


def agent_detail(summary: DataFrame, metadata: DataFrame) -> DataFrame:
    """C5 / P7 (batch form): every agent with its metadata; the flag only
    moves towards true (a confirmed hit overrides the snapshot)."""
    m = metadata.select(
        "token_uri",
        F.col("x402").alias("_m_x402"),
        F.col("resolved_uri").alias("metadata_resolved_uri"),
        F.col("name").alias("metadata_name"),
        F.col("description").alias("metadata_description"),
        F.col("error").alias("metadata_error"),
    )
    return (spread_left_join(summary, m, "token_uri", "agent_id")
            .withColumn("x402", F.col("x402") | F.coalesce(F.col("_m_x402"), F.lit(False)))
            .drop("_m_x402"))
