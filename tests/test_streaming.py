"""The refreshed state equals the batch rebuild, whatever order logs come in."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT_CONFIG
from ledgerlens.plans.summary import build_agent_summary
from ledgerlens.sources.fixtures import fixture_logs
from ledgerlens.streaming.incremental import feedback_parts, latest_agents, merge_batch, read_events, read_parts, start_refresh, summary_from_state

from .conftest import SF_SMALL


def test_late_duplicate_and_revoked_logs(spark):
    root = tempfile.mkdtemp(prefix="e1-", dir="/tmp")
    bronze, state = os.path.join(root, "bronze"), os.path.join(root, "state")
    logs = fixture_logs(spark, SF_SMALL, revocations=True)
    at = F.col("block_timestamp")
    cut = F.lit("2024-01-16").cast("timestamp")
    for part in (logs.where(at >= cut), logs.where(at < cut), logs.where(at >= cut).sample(0.2, 1)):  # newest first, then some again
        part.coalesce(2).write.mode("append").parquet(bronze)
        start_refresh(spark, bronze, state, os.path.join(root, "ckpt"), files_per_batch=1).awaitTermination()
    want = sorted(build_agent_summary(logs).collect())
    assert sorted(summary_from_state(latest_agents(spark, state)).collect()) == want
    assert read_events(spark, state).groupBy("transaction_hash", "log_index").count().where("count > 1").isEmpty()
    before = set(glob.glob(f"{state}/**/*.parquet", recursive=True))
    # a stream that starts anew on the old state merges everything once more: nothing counts twice
    start_refresh(spark, bronze, state, os.path.join(root, "ckpt2")).awaitTermination()
    assert sorted(summary_from_state(latest_agents(spark, state)).collect()) == want
    assert before <= set(glob.glob(f"{state}/**/*.parquet", recursive=True))  # a batch rewrites nothing of others


def test_a_batch_that_runs_again_and_a_late_revocation(spark):
    state = tempfile.mkdtemp(prefix="e1-", dir="/tmp")
    logs = fixture_logs(spark, SF_SMALL, revocations=True)
    first, second = (logs.where(F.pmod("log_index", F.lit(2)) == i) for i in (0, 1))
    for part, name in ((first, "a"), (second, "b"), (second, "b"), (first.unionByName(first), "c")):
        merge_batch(part, state, DEFAULT_CONFIG, name)
    assert sorted(summary_from_state(latest_agents(spark, state)).collect()) == sorted(build_agent_summary(logs).collect())
    parts = {r["batch"]: r["n"] for r in read_parts(spark, state).groupBy("batch").agg(F.sum("n").alias("n")).collect()}
    assert not parts.get("c")  # nothing of the last batch was new


def test_parts_of_revoked_feedback_cancel(spark):
    votes = spark.sql("SELECT 1L AS agent_id, 'c' AS client_address, 80 AS score, timestamp'2024-01-05 10:00:00' AS at")
    both = feedback_parts(votes, DEFAULT_CONFIG).unionByName(feedback_parts(votes, DEFAULT_CONFIG, -1))
    r = both.groupBy("agent_id").agg(*[F.sum(c).alias(c) for c in ("n", "sw0", "swq0", "sq100", "nq", "pos")]).first()
    assert [float(x) for x in r[1:]] == [0.0] * 6


def test_empty_batch_leaves_the_state(spark):
    root = tempfile.mkdtemp(prefix="e1-", dir="/tmp")
    merge_batch(fixture_logs(spark, SF_SMALL).limit(0), root, DEFAULT_CONFIG, "a")
    assert os.listdir(root) == []
    assert latest_agents(spark, root).count() == 0
