"""Benchmark the headline queries.

Two sets, both on $BENCH_SF_DIR with local[$BENCH_CPUS]:

* build queries run end to end from the raw driver tables (fixture logs ->
  decode -> score -> rank, enrichment, names) exactly as registered;
* serve queries run over the agent summary materialized once as a table
  (how the serving layer runs: build once, query many times).

Every query executes fully into a no-op sink (nothing is collected). All
queries are first run once on sf0.001 to warm the JVM. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

BUILD = [
    "agent_summary", "agent_summary_revoked", "event_census",
    "metadata_records", "data_uri_metadata", "enrich_top", "agent_detail", "name_lookup", "owner_profiles",
]
SERVE = [
    "list_rank_page", "list_rated_reputation", "list_search_feedback", "list_recent_page", "list_deep_page",
    "list_envelope", "network_stats", "tier_summary", "viz_sample", "agent_cards", "snapshot_rows",
]
# Extension (not a reference query): measured and reported, not in the total.
EXTRAS = ["incremental_summary"]
HEADLINE = BUILD + SERVE


def timed(df_fn):
    t0 = time.perf_counter()
    df_fn().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def run_all(spark, sf_dir, scratch):
    from ledgerlens.config import DEFAULT_CONFIG
    from ledgerlens.plans.catalog import REGISTRY, logs
    from ledgerlens.plans.summary import build_agent_summary
    from ledgerlens.session import prepare
    from ledgerlens.sources.snapshot import materialize_table

    prepare(spark)
    times = {}
    for name in BUILD:
        times[name] = timed(lambda: REGISTRY[name].fn(spark, sf_dir))
    t0 = time.perf_counter()
    table = f"bench_{abs(hash(sf_dir)) % 10**6}"
    materialize_table(build_agent_summary(logs(spark, sf_dir), DEFAULT_CONFIG), table,
                      os.path.join(scratch, table))
    times["materialize_summary"] = time.perf_counter() - t0
    summary = spark.table(table)
    for name in SERVE:
        times[name] = timed(lambda: REGISTRY[name].serve(spark, summary))
    extras = {name: timed(lambda: REGISTRY[name].fn(spark, sf_dir)) for name in EXTRAS}
    return {k: round(v, 3) for k, v in times.items()}, {k: round(v, 3) for k, v in extras.items()}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ledgerlens.session import checkpoint_dir, local_session

    spark = local_session("ledgerlens-bench", cores=cpus, partitions=max(8, int(cpus) * 2))
    checkpoint_dir(spark)
    scratch = tempfile.mkdtemp(prefix="ledgerlens-bench-")
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        run_all(spark, warm, scratch)
    times, extras = run_all(spark, sf_dir, scratch)
    build = round(sum(times[n] for n in BUILD), 3)
    serve = round(sum(times[n] for n in SERVE), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "build_total": build,
        "serve_total": serve,
        "extras": extras,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
