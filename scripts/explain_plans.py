"""Print the physical plans of the key queries over a bronze Parquet table.

Usage: python scripts/explain_plans.py [sf_dir]
Writes the bronze layout of the fixture to a scratch folder, then explains the
decode/score plan, a serving page, the stats document and the metadata fetch.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarize(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
    bhj = plan.count("BroadcastHashJoin")
    smj = plan.count("SortMergeJoin")
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)))
    windows = plan.count("Window ")
    print(f"== {name}: shuffle exchanges={exchanges} broadcast joins={bhj} sort-merge joins={smj} windows={windows}")
    for p in pushed:
        if p:
            print(f"   pushed: {p[:200]}")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    from ledgerlens.config import AS_OF
    from ledgerlens.operators import metadata as M
    from ledgerlens.operators import serve as S
    from ledgerlens.operators.decode import decode_feedback
    from ledgerlens.plans.summary import scored_agents
    from ledgerlens.session import checkpoint_dir, local_session, prepare
    from ledgerlens.sources.fixtures import fixture_logs, metadata_documents
    from ledgerlens.sources.logs import read_bronze, write_bronze

    spark = prepare(local_session("explain"))
    checkpoint_dir(spark)
    root = tempfile.mkdtemp(prefix="ledgerlens-explain-")
    write_bronze(fixture_logs(spark, sf, revocations=True), f"{root}/logs")
    logs = read_bronze(spark, f"{root}/logs")
    summarize("decode_feedback since 2024-01-15", decode_feedback(logs, "2024-01-15"))
    scored = scored_agents(logs)
    summarize("scored_agents (P2+P3+C3+P4)", scored)
    scored.write.mode("overwrite").parquet(f"{root}/summary")
    summary = spark.read.parquet(f"{root}/summary").withColumn("rank", F.lit(1).cast("bigint")) \
        .withColumn("x402", F.lit(False)).withColumn("computed_at", F.lit(AS_OF).cast("timestamp"))
    summarize("list page (rated, reputation)", S.list_agents(summary, S.ListRequest(rated=True, sort="reputation")))
    summarize("stats document", S.stats_document(summary, AS_OF))
    summarize("metadata fetch", M.fetch_metadata(summary.select("token_uri"), metadata_documents(spark, sf),
                                                 F.lit(AS_OF).cast("timestamp")))
    print("\n--- scored_agents formatted plan ---")
    scored.explain("formatted")


if __name__ == "__main__":
    main()
