"""A hot key: one agent receives a third of all feedback.

The aggregate must stay exact, and every exchange in its plan must follow a
partial aggregate (so the hot agent reaches the reducer as one row per task
and client, never as a third of the raw rows)."""

import re

from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT_CONFIG
from ledgerlens.operators.decode import decode_feedback
from ledgerlens.operators.score import aggregate_agents, score_feedback
from ledgerlens.sources.fixtures import feedback_logs, table

from .conftest import SF_ORACLE


def test_hot_agent_aggregate(spark):
    ev = table(spark, SF_ORACLE, "events").withColumn(
        "user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))
    fb = decode_feedback(feedback_logs(ev))
    agg = aggregate_agents(score_feedback(fb, DEFAULT_CONFIG))
    plan = agg._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    assert sum("Exchange hashpartitioning(agent_id" in x for x in lines) == 2
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(agent_id" in line:
            below = "\n".join(lines[i + 1:i + 4])
            assert "HashAggregate" in below and "partial_" in below, below
    got = {r["agent_id"]: r for r in agg.collect()}
    want = (ev.groupBy(F.col("user_id").alias("agent_id"))
              .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("c"),
                   F.max(F.col("ts").cast("timestamp")).alias("last")).collect())
    assert len(got) == len(want)
    for w in want:
        g = got[w["agent_id"]]
        assert g["feedback_count"] == w["n"] and g["unique_clients"] == w["c"] and g["last_feedback_at"] == w["last"]
    hot = got[7]
    assert hot["feedback_count"] >= ev.count() // 3


def test_null_keys_are_spread(spark):
    from ledgerlens.operators.joins import spread_left_join
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(4000).select(F.col("id").alias("agent_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("u"), F.col("id"))).alias("k"))
        right = spark.range(0, 4000, 4).select(F.concat(F.lit("u"), F.col("id")).alias("k"), F.lit(1).alias("hit"))
        out = spread_left_join(left, right.unionByName(spark.createDataFrame([(None, 1)], "k string, hit int")), "k", "agent_id")
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 4000 and max(sizes) < 3 * sum(sizes) / len(sizes)
        assert out.where("hit = 1").count() == 1000
        assert out.columns == ["agent_id", "k", "hit"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
