"""Name records.

Chain RPC is replaced by two tables: ``names`` (address -> name-or-null,
``resolved`` false for a failed lookup) and long ``text_records``
(name, key, value). Every operation is an equi-join or a keyed aggregate;
no table is broadcast by hint - Spark's size check decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOOKUP_KEYS, NAME_SAMPLE, PROFILE_KEYS, TTL_NAMES
from ..functions.names import attestation_key, classify_identifier
from .joins import spread_left_join

PROFILE_COLUMNS = {
    "agent-context": "agent_context",
    "agent-endpoint[mcp]": "mcp_endpoint",
    "agent-endpoint[a2a]": "a2a_endpoint",
    "agent-endpoint[web]": "web_endpoint",
    "avatar": "avatar",
    "url": "url",
    "description": "description",
}


def resolved_names(names: DataFrame) -> DataFrame:
    """Successful reverse lookups only (a failed lookup is no answer)."""
    return names.where(F.col("resolved")).select(F.lower("address").alias("address"), "name")


def owner_names(df: DataFrame, names: DataFrame, address_col: str = "owner_address") -> DataFrame:
    """Attach the owner's primary name (case-insensitive address)."""
    n = resolved_names(names).select(F.col("address").alias("_addr"), F.col("name").alias("owner_name"))
    return df.join(n, F.lower(df[address_col]) == n["_addr"], "left").drop("_addr")


def forward(names: DataFrame) -> DataFrame:
    """Lowercase name -> address (the inverse of the name table)."""
    # two addresses may claim one name: the first in address order answers
    return (resolved_names(names).where(F.col("name").isNotNull())
            .groupBy(F.lower("name").alias("_name")).agg(F.min("address").alias("fwd_address")))


def lookup_records(records: DataFrame, keys: list[str] = LOOKUP_KEYS) -> DataFrame:
    """Per name, a map of the truthy values among ``keys`` (key-sorted)."""
    r = (records.where(F.col("key").isin(*keys) & F.col("value").isNotNull() & (F.col("value") != ""))
         .groupBy("name", "key").agg(F.max("value").alias("value")))
    # at most len(keys) entries per name after the (name, key) dedupe
    return (r.groupBy("name")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("records")))


def name_lookup(inputs: DataFrame, names: DataFrame, records: DataFrame, col: str = "input") -> DataFrame:
    """Classify each input (B16); addresses reverse-resolve, names
    forward-resolve (the name is dropped when it resolves to nothing); known
    names get their sparse record map."""
    q = inputs.select(F.trim(F.col(col)).alias("query")).withColumn("kind", classify_identifier(F.col("query")))
    rev = resolved_names(names).select(F.col("address").alias("_raddr"), F.col("name").alias("_rname"))
    fwd = forward(names)
    j = (q.join(rev, (F.col("kind") == "address") & (F.lower("query") == F.col("_raddr")), "left")
          .join(fwd, (F.col("kind") == "name") & (F.lower("query") == F.col("_name")), "left"))
    name = (F.when(F.col("kind") == "address", F.col("_rname"))
            .when((F.col("kind") == "name") & F.col("fwd_address").isNotNull(), F.col("query")))
    address = (F.when(F.col("kind") == "address", F.col("query"))
               .when(F.col("kind") == "name", F.col("fwd_address")))
    base = j.select("query", "kind", name.alias("name"), address.alias("address"))
    recs = lookup_records(records)
    empty = F.create_map().cast("map<string,string>")
    return (spread_left_join(base, recs, "name", "query")
            .select("query", "kind", "name", "address",
                    F.when(F.col("name").isNotNull(), F.coalesce("records", empty)).otherwise(empty).alias("records")))


def agent_profiles(owners: DataFrame, names: DataFrame, records: DataFrame, col: str = "address") -> DataFrame:
    """Owner address -> name + the seven profile records, wide.

    Explicit pivot values keep it a single aggregation; records of names not
    owned by anyone never leave the join."""
    o = owners.select(F.lower(F.col(col)).alias("address")).distinct()
    with_name = o.join(resolved_names(names), "address", "left")
    r = records.where(F.col("key").isin(*PROFILE_KEYS))
    wide = r.groupBy("name").pivot("key", PROFILE_KEYS).agg(F.max("value"))
    for key, alias in PROFILE_COLUMNS.items():
        wide = wide.withColumnRenamed(key, alias)
    return spread_left_join(with_name, wide, "name", "address").select("address", "name", *PROFILE_COLUMNS.values())


def unique_owners(summary: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct lowercase owners in best-rank order (blank owners dropped)."""
    owners = (summary.where(F.coalesce(F.col("owner_address"), F.lit("")) != "")
              .groupBy(F.lower("owner_address").alias("address"))
              .agg(F.min("rank").alias("best_rank")))
    if top is not None:
        owners = owners.orderBy("best_rank").limit(int(top))
    return owners


def fresh_names(cache: DataFrame, as_of: Column) -> DataFrame:
    """K1: successful lookups at most a day old at ``as_of``."""
    limit = F.timestamp_seconds(F.unix_seconds("fetched_at") + F.lit(TTL_NAMES))
    return cache.where(F.col("resolved") & (as_of <= limit))


def resolve_names(summary: DataFrame, names: DataFrame, cache: DataFrame, as_of: Column, top: int | None = None):
    """P10: warm the name cache for the top owners.

    Returns (results, new_cache). Fresh entries (including a stored "no name")
    are reused; failed lookups are not cached, so they stay candidates."""
    targets = unique_owners(summary, top).select("address")
    good_cache = fresh_names(cache, as_of)
    misses = targets.join(good_cache.select("address"), "address", "left_anti")
    hits = good_cache.join(targets, "address", "left_semi").select("address", "name", "resolved",
                                                                   F.lit(True).alias("from_cache"))
    chain = names.select(F.lower("address").alias("address"), F.col("name").alias("_n"), F.col("resolved").alias("_ok"))
    fetched = (misses.join(chain, "address", "left")
               .select("address",
                       F.when(F.coalesce("_ok", F.lit(True)), F.col("_n")).alias("name"),
                       F.coalesce("_ok", F.lit(True)).alias("resolved"),
                       F.lit(False).alias("from_cache")))
    results = fetched.unionByName(hits)
    new_entries = fetched.where(F.col("resolved")).select("address", "name", "resolved", as_of.alias("fetched_at"))
    new_cache = cache.where(F.col("resolved")).select("address", "name", "resolved", "fetched_at").join(new_entries.select("address"), "address", "left_anti").unionByName(new_entries)
    return results, new_cache


def names_run_summary(results: DataFrame) -> DataFrame:
    """G16 for names: processed / from cache / newly fetched / errors / has name (%)."""
    processed = F.count(F.lit(1))
    has_name = F.count_if(F.col("name").isNotNull())
    return results.agg(
        processed.cast("bigint").alias("processed"),
        F.count_if(F.col("from_cache")).cast("bigint").alias("from_cache"),
        F.count_if(~F.col("from_cache") & F.col("resolved")).cast("bigint").alias("fetched"),
        F.count_if(~F.col("resolved")).cast("bigint").alias("errors"),
        has_name.cast("bigint").alias("has_name"),
        F.round(F.when(processed > 0, has_name * 100.0 / processed), 1).alias("has_name_pct"),
    )


def name_sample(cache: DataFrame, n: int = NAME_SAMPLE) -> DataFrame:
    """First n resolved names (address order, so it is stable)."""
    return cache.where(F.col("name").isNotNull()).orderBy("address").limit(n).select("address", "name")


def attestations(agents: DataFrame, names: DataFrame, records: DataFrame) -> DataFrame:
    """Does the owner's name carry the registration record for the agent?"""
    with_name = owner_names(agents.select("agent_id", "owner_address"), names)
    keyed = with_name.withColumn("_key", attestation_key(F.col("agent_id")))
    att = (records.where(F.col("key").startswith("agent-registration[") & F.col("value").isNotNull())
           .select(F.col("name").alias("_rn"), F.col("key").alias("_rk"), F.lit(True).alias("_has")).distinct())
    return (keyed.join(att, (F.col("owner_name") == F.col("_rn")) & (F.col("_key") == F.col("_rk")), "left")
            .select("agent_id", "owner_name", F.coalesce("_has", F.lit(False)).alias("verified")))
